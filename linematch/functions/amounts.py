"""Amounts that a text states with units, in base units.

What a text states is read by one compiled pattern; factors come from
unit_reference. Numbers may be decimal (point or comma), fractions, mixed, in
native digits, or the words of NUMBERS; counts multiply by an x. Where neither
text nor row names a unit, that of the source counts. What no source settles is
for review, with the guess of the classifier of missing_units.
"""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from linematch.functions.missing_units import CONFIDENT, UnitModel
from linematch.functions.segments import field_values
from linematch.functions.text import DEVANAGARI_DIGITS, GUJARATI_DIGITS
from linematch.functions.units import AMOUNT_UNITS
from linematch.plans.lineage import checkpointed

NUMBERS = {
    "1/4": "quarter|a quarter|pa|પા",
    "1/2": "half|half a|aadha|adha|aadho|adho|અડધો|અડધી|અડધું|आधा|आधी",
    "3/4": "pona|pauna|paun|પોણો|પોણા|પોણી|पौना|पौन|पौने",
    "1": "a|one|ek|એક|एक",
    "5/4": "sava|savva|સવા|सवा",
    "3/2": "one and a half|dedh|dodh|દોઢ|डेढ़|डेढ",
    "2": "two|do|be|બે|दो",
    "5/2": "two and a half|adhi|dhai|અઢી|ढाई",
    "3": "three|teen|tran|ત્રણ|तीन",
    "4": "four|char|ચાર|चार",
    "5": "five|panch|પાંચ|पांच|पाँच",
    "6": "six|છ|छह",
    "10": "ten|દસ|दस",
    "12": "twelve|બાર|बारह",
}
#: Catalog names that may be broadcast to find categories.
CATEGORY_NAMES = 500_000
_TO_ASCII = str.maketrans(GUJARATI_DIGITS + DEVANAGARI_DIGITS, "0123456789" * 2)
_CYRILLIC = str.maketrans("аеорсхуіјѕкԁԛԝһӏьмтвнг", "aeopcxyijskdqwhlbmtbhr")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


def _plain(text: str) -> str:
    """Lower case, compatible forms, ASCII digits, fractions as n/d, no unseen characters."""
    if text.isascii():
        return text.lower()
    text = "".join(
        " " + unicodedata.normalize("NFKC", c) if unicodedata.decomposition(c).startswith("<fraction>") else c for c in text
    )
    text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text)).replace("⁄", "/")
    return text.translate(_TO_ASCII).lower().translate(_CYRILLIC)


def _any(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


UNITS = {_plain(word): unit for word, unit in AMOUNT_UNITS.items()}
WORDS = {_plain(w): Fraction(n) for n, words in NUMBERS.items() for w in words.split("|")}
_LETTER = "\\w\u0900-\u0aff"
_NUMBER = r"(?:\d+\s+)?\d+\s?/\s?\d+|\d+(?:[.,]\d+)?"
_AMOUNT = re.compile(
    rf"(?<![{_LETTER}])(?<!\d[.,/])(?:(\d+)\s*[x×]\s*)?(?:({_NUMBER})\s*|({_any(WORDS)})\s+)({_any(UNITS)})(?![{_LETTER}])"
    rf"(?:\s*[x×]\s*(\d+)(?![{_LETTER}]))?"
)


def _value(number: str) -> Fraction:
    if "/" not in number:
        return Fraction(number.replace(",", "."))
    *whole, top, bottom = re.findall(r"\d+", number)
    return Fraction(int(top), int(bottom) or 1) + sum(map(int, whole))


def stated_amount(text: str | None, factors: dict[str, tuple[str, Fraction]]) -> tuple[str | None, int | None, bool]:
    """Base unit, whole amount and whether any unit is named; amounts in the first base unit add up."""
    base, total, named = None, Fraction(0), False
    for times, number, word, unit, by in _AMOUNT.findall(_plain(text or "")):
        named = True
        if UNITS[unit] not in factors:
            continue
        to, factor = factors[UNITS[unit]]
        base = base or to
        if to == base:
            total += (_value(number) if number else WORDS[word]) * factor * int(times or 1) * int(by or 1)
    return (base, round(total), named) if base and total > 0 else (None, None, named)


def _stated(units: DataFrame):
    factors = {
        r.unit: (r.base_unit, Fraction(r.factor))
        for r in units.filter("base_unit IS NOT NULL AND factor IS NOT NULL").collect()  # a fixed table of 14 rows
    }
    kind = StructType(
        [StructField("base_unit", StringType()), StructField("base_amount", LongType()), StructField("named", BooleanType())]
    )

    @F.pandas_udf(kind)
    def stated(texts: pd.Series) -> pd.DataFrame:
        rows = [stated_amount(t, factors) for t in texts]
        return pd.DataFrame(
            {
                "base_unit": pd.Series([r[0] for r in rows], dtype=object),
                "base_amount": pd.Series([r[1] for r in rows], dtype="Int64"),
                "named": pd.Series([r[2] for r in rows], dtype=bool),
            }
        )

    return stated


def categories_of(items: DataFrame, products: DataFrame) -> DataFrame:
    """items with category, that of the catalog entry whose name or alias product_text is, in any case; else NULL."""
    lists = [F.split(F.coalesce(F.col(c), F.lit("")), r"\|") for c in ("aliases_en", "aliases_gu", "aliases_hi")]
    names = products.select("category", F.explode(F.concat(F.array("canonical_name"), *lists)).alias("_name"))
    names = names.select(F.lower(F.trim("_name")).alias("_name"), "category").filter("_name <> ''")
    names = names.groupBy("_name").agg(F.min("category").alias("category"))
    if names.count() <= CATEGORY_NAMES:
        names = F.broadcast(names)
    return items.drop("category").join(names, F.lower(F.trim("product_text")) == F.col("_name"), "left").drop("_name")


def known_and_missing(items: DataFrame, sources: DataFrame, units: DataFrame) -> DataFrame:
    """item_id, quantity, unit, source_code, product_text, lang, what raw_text states (s), own, default_unit and state of each item.

    own is the unit that the column unit spells. state is stated where raw_text
    names a unit or the row has one, missing where neither does and a quantity
    is given, else nothing.
    """
    more = [F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in ("product_text", "lang")]
    items = items.select("item_id", "raw_text", "quantity", "unit", "source_code", *more)
    words = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    state = F.when(F.col("s.named") | F.col("unit").isNotNull(), "stated").when(F.col("quantity") > 0, "missing")
    return (
        items.withColumn("s", _stated(units)(F.col("raw_text")))
        .join(F.broadcast(sources.select("source_code", "default_unit").dropDuplicates(["source_code"])), "source_code", "left")
        .withColumn("own", F.try_element_at(words, F.lower("unit")))
        .withColumn("state", state)
        .select("item_id", "quantity", "unit", "source_code", "product_text", "lang", "s", "own", "default_unit", "state")
    )


def fitted_units(rows: DataFrame, units: DataFrame) -> UnitModel:
    """A model of units, from rows that state one and rows whose source means one.

    rows: known_and_missing() with category. A stated unit is the row's own, or else the base
    unit of what raw_text states; a source's default is the unit of its rows
    without one.
    """
    own = F.coalesce("own", "s.base_unit")
    labelled = rows.select(
        F.when(F.col("state") == "stated", own).when(F.col("state") == "missing", F.col("default_unit")).alias("label"),
        "quantity", "source_code", "category", "lang", F.col("state").alias("stated"), "item_id",
    )
    known = F.broadcast(units.select(F.col("unit").alias("label")))
    return UnitModel(labelled.filter("quantity > 0").join(known, "label", "left_semi"))


def unsettled_units(rows: DataFrame, model: UnitModel) -> DataFrame:
    """The rows of state missing whose source means no unit, or one that a confident guess is against, with guess and confidence."""
    missing = rows.filter("state = 'missing'").withColumn("stated", F.col("state"))
    against = (F.col("confidence") >= CONFIDENT) & (F.col("guess") != F.col("default_unit"))
    return model.predict(missing).filter(F.col("default_unit").isNull() | against)


def item_amounts(items: DataFrame, sources: DataFrame, units: DataFrame) -> DataFrame:
    """item_id, base_unit, base_amount of every item with a convertible amount, and quantity and unit as they were.

    A quantity beside a text that names no unit counts in the row's unit or,
    without one, in that of the source; no guess can change that. NULL and empty
    texts state nothing; repeated rows each give a row; further columns are
    dropped.
    """
    rows = known_and_missing(items, sources, units)
    meant = F.when(F.col("unit").isNotNull(), F.col("own")).otherwise(F.col("default_unit"))
    rows = rows.withColumn("meant", F.when(~F.col("s.named") & (F.col("quantity") > 0), meant))
    by_unit = units.filter("base_unit IS NOT NULL AND factor IS NOT NULL").select(F.col("unit").alias("meant"), F.col("base_unit").alias("to"), "factor")
    amount = F.round(F.col("quantity").cast("decimal(38,9)") * F.col("factor").cast("decimal(38,9)")).cast("bigint")
    amount = F.when(F.col("to").isNotNull(), amount).otherwise(F.col("s.base_amount"))
    return (
        rows.join(F.broadcast(by_unit), "meant", "left")
        .withColumn("base_amount", amount)
        .filter("s.base_unit IS NOT NULL OR base_amount > 0")
        .select("item_id", F.coalesce("to", "s.base_unit").alias("base_unit"), "base_amount", "quantity", "unit")
    )


def units_for_review(items: DataFrame, sources: DataFrame, units: DataFrame, products: DataFrame) -> DataFrame:
    """item_id, guess, confidence of every quantity without a unit whose source means none, or one that a confident guess is against.

    The texts are read once: what is kept of them is written to the checkpoint
    folder, as the model and the result both need it.
    """
    rows = checkpointed(categories_of(known_and_missing(items, sources, units), products).drop("product_text"))
    return unsettled_units(rows, fitted_units(rows, units)).select("item_id", "guess", F.round("confidence", 4).alias("confidence"))


def amounts_to_convert(
    items: DataFrame, entries: DataFrame, sources: DataFrame, units: DataFrame, products: DataFrame | None = None
) -> DataFrame:
    """src_table, rec_id, pos, base_unit, base_amount of every amount that is not yet in its base unit."""
    held = (F.col("unit") == F.col("base_unit")) & (F.col("quantity") == F.col("base_amount").cast("double"))
    of_items = item_amounts(items, sources, units).filter(~F.coalesce(held, F.lit(False)))
    stated = _stated(units)
    of_values = (
        field_values(entries, ("units",), products)
        .filter(~F.col("item_value").rlike("^[0-9]+ (g|ml|piece)$"))
        .withColumn("s", stated(F.col("item_value")))
        .filter("s.base_unit IS NOT NULL")
    )
    return of_items.select(
        F.lit("list_items").alias("src_table"), F.col("item_id").alias("rec_id"), F.lit(0).alias("pos"), "base_unit", "base_amount"
    ).unionByName(
        of_values.select(
            F.lit("vendor_catalog").alias("src_table"), F.col("entry_id").alias("rec_id"), "pos", "s.base_unit", "s.base_amount"
        )
    )
