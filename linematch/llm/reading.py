"""Reading band of each document from the vocabulary that covers it.

Words are ranked by grade and, within a grade, by their frequency in all
documents. A document's coverage rank is the smallest rank whose vocabulary
covers COVERED of its graded words. A word counts with the inverse of the
usual sentence length of its grade, so that one long sentence of another grade
weighs as one sentence. Cuts between the bands are calibrated on the ratings.
All of it is SQL; the graded vocabulary is the only thing that is broadcast,
and only below a checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linematch.plans.lineage import checkpointed

BANDS = ("basic", "middle", "advanced")
#: Share of a document's graded words that the vocabulary must cover.
COVERED = 0.5
#: Share of a word's uses, at equal amounts of text, that must fall to a grade.
PURE = 0.55
LEAST_WORDS = 8
#: Words of the graded vocabulary that may be broadcast (about 50 bytes each).
BROADCAST_WORDS = 500_000
_SCALE = 10_000


def words_of(text: Column) -> Column:
    """Runs of letters and their marks, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{M}]+)"), 1)


def has_words(text: Column, least: int = LEAST_WORDS) -> Column:
    """Whether a text has so many words separated by white space. NULL counts as false."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\s\\p{Z}]+"), lambda w: w != "")) >= least, F.lit(False))


def sentence_length(text: Column) -> Column:
    """Words a sentence; sentences end at . ! ? danda or a line's end."""
    parts = F.filter(F.split(text, "[.!?।\\r\\n]+"), lambda s: s.rlike("\\p{L}"))
    return F.size(words_of(text)) / F.greatest(F.size(parts), F.lit(1))


def cleaned_ratings(labels: DataFrame) -> DataFrame:
    """doc_id, band, votes: each rater's rating once, odd spellings read, others and NULLs left out."""
    band = F.lower(F.trim(F.regexp_replace("band", "[\\s\\p{Z}]+", " ")))
    return (
        labels.select("doc_id", "rater", band.alias("band"))
        .filter(F.col("band").isin(*BANDS) & F.col("doc_id").isNotNull())
        .distinct()
        .groupBy("doc_id", "band")
        .agg(F.count("*").alias("votes"))
    )


def _number(band: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BANDS)), band).cast("int")


def graded_vocabulary(docs: DataFrame, rated: DataFrame, ratings: DataFrame) -> DataFrame:
    """word, rank, weight: by grade, then by frequency in all documents; words of no clear grade are left out.

    rated is the part of docs that has ratings.
    """
    rated = rated.join(ratings, "doc_id")
    usual = rated.groupBy("band").agg(F.percentile("sentence", F.lit(0.5), F.col("votes")).alias("usual"))
    used = rated.select("band", "votes", F.explode("words").alias("word")).groupBy("word", "band").agg(F.sum("votes").alias("uses"))
    totals = used.groupBy("band").agg(F.sum("uses").alias("total"))
    rates = used.join(F.broadcast(totals), "band").withColumn("rate", F.col("uses") / F.col("total"))
    sums = rates.groupBy("word").agg(F.max_by("band", "rate").alias("band"), (F.max("rate") / F.sum("rate")).alias("pure"))
    counts = docs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    graded = sums.filter(F.col("pure") >= PURE).join(counts, "word").join(F.broadcast(usual), "band")
    # Ranks over ranges of the sort: no window holds the whole vocabulary in one task.
    graded = graded.withColumn("grade", _number(F.col("band")))
    steps = graded.groupBy("grade", "n").agg(F.count("*").alias("many"))
    before = steps.withColumn(
        "before", F.sum("many").over(Window.orderBy("grade", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    )
    place = F.row_number().over(Window.partitionBy("grade", "n").orderBy("word"))
    return (
        graded.withColumn("place", place)
        .join(before.drop("many"), ["grade", "n"])
        .select("word", (F.coalesce("before", F.lit(0)) + F.col("place")).alias("rank"), (F.lit(1.0) / F.col("usual")).alias("weight"))
    )


def coverage_ranks(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, text_key, coverage: the smallest rank that covers COVERED of the document's graded words, NULL if it has none."""
    small = vocabulary.count() <= BROADCAST_WORDS
    tokens = docs.select("doc_id", "text_key", F.explode_outer("words").alias("word"))
    found = tokens.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left")
    weight = F.greatest(F.round(F.col("weight") * _SCALE).cast("bigint"), F.lit(1))
    return found.groupBy("doc_id", "text_key").agg(F.percentile("rank", F.lit(COVERED), weight).alias("coverage"))


def calibrated_cuts(covered: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row (low, high): the ranks after which a document is no longer basic, and advanced, with the most votes right."""
    votes = covered.filter("coverage IS NOT NULL").join(ratings, "doc_id").groupBy("coverage").pivot("band", list(BANDS)).agg(F.sum("votes")).fillna(0)
    # One row for each distinct coverage rank of the rated documents: at most the size of the vocabulary.
    up = Window.orderBy("coverage").rowsBetween(Window.unboundedPreceding, 0)
    basic, middle, advanced = (F.sum(b).over(up) for b in BANDS)
    sums = votes.select("coverage", (basic - middle - advanced).alias("easy"), (basic + middle - advanced).alias("not_hard"))
    return sums.agg(F.max_by("coverage", "easy").alias("low"), F.max_by("coverage", "not_hard").alias("high"))


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_key, words, sentence of documents with at least LEAST_WORDS words."""
    return docs.filter(has_words(F.col(text))).select(
        "doc_id", F.xxhash64(text).alias("text_key"), words_of(F.col(text)).alias("words"), sentence_length(F.col(text)).alias("sentence")
    )


def reading_bands(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, band of every document whose text has at least eight words.

    The language is not asked for: each word carries its grade. NULL, empty and
    shorter texts give no row; texts are taken whole; rows that repeat doc_id
    and text give one row; further columns are dropped. A text without any
    graded word is middle, as is every text where no rating can be read.
    """
    ratings = checkpointed(cleaned_ratings(labels))
    # The few rated documents are found before their words are taken apart, and kept.
    rated = checkpointed(prepared(docs.join(ratings.select("doc_id").distinct(), "doc_id", "left_semi"), text))
    docs = prepared(docs, text)
    vocabulary = checkpointed(graded_vocabulary(docs, rated, ratings))
    low, high = calibrated_cuts(coverage_ranks(rated, vocabulary), ratings).first()  # two numbers
    coverage = F.col("coverage")
    band = F.when(coverage.isNull() | F.lit(low is None), BANDS[1]).when(coverage <= F.lit(low), BANDS[0])
    band = band.when(coverage <= F.lit(high), BANDS[1]).otherwise(BANDS[2])
    return coverage_ranks(docs, vocabulary).select("doc_id", band.alias("band"))
