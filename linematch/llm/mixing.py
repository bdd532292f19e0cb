"""Sources mixed to target shares by thresholds on a hash.

Each row has a hash. A source that must give k times its size and a part more
gives every row k times, and the rows under a threshold once more. The
threshold comes from sums by source and hash bucket: where the running sum
passes the budget, only that bucket is split further. Nothing is sorted, and
the rows of a smaller budget are among those of a larger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linematch.llm.tokens import RANKS, with_tokens
from linematch.plans.lineage import checkpointed

BITS, LEVELS = 9, 7  # 63 bits of hash
_BUCKETS = 1 << BITS


def planned(sizes: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """source, target_share, max_repeats, total, wanted: how many tokens each source is to give.

    Without a budget the mix is the largest in which every source that has
    tokens meets its share. A source gives at most max_repeats times its size.
    """
    totals = sizes.groupBy("source").agg(F.sum("tokens").alias("total"))
    plan = targets.filter("source IS NOT NULL AND target_share > 0").dropDuplicates(["source"]).join(totals, "source", "left").fillna(0, ["total"])
    cap = F.col("total") * F.col("max_repeats")
    size = float(budget) if budget is not None else _largest(plan.filter("total > 0 AND max_repeats > 0").withColumn("cap", cap))
    wanted = F.least(F.floor(F.col("target_share") * F.lit(size)), cap)
    return plan.select("source", "target_share", "max_repeats", "total", wanted.cast("bigint").alias("wanted"))


def _largest(plan: DataFrame) -> float:
    """Tokens of the largest mix in which every source can meet its share."""
    return float(plan.agg(F.min(F.col("cap") / F.col("target_share"))).first()[0] or 0.0)


def thresholds(sizes: DataFrame, parts: DataFrame) -> DataFrame:
    """source, limit: rows with a hash below limit hold about `part` tokens; off by half of one row at most.

    sizes: source, hash (0 to 2^63 - 1), tokens; parts: source, part.
    """
    found = parts.select("source", F.col("part").alias("open"), F.lit(0).cast("bigint").alias("low"))
    for level in range(LEVELS):
        shift = 63 - BITS * (level + 1)
        inside = sizes.join(F.broadcast(found), "source").filter(
            F.shiftright("hash", shift + BITS) == F.shiftright("low", shift + BITS) if level else F.lit(True)
        )
        sums = inside.groupBy("source", "open", F.shiftleft(F.shiftright("hash", shift), shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        # At most 2^BITS rows of a source.
        up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        passed = sums.withColumn("sum", F.sum("tokens").over(up)).filter(F.col("sum") > F.col("open"))
        first = passed.groupBy("source").agg(F.min(F.struct("bucket", (F.col("open") - F.col("sum") + F.col("tokens")).alias("open"), "tokens")).alias("b"))
        found = checkpointed(first.select("source", "b.open", F.col("b.bucket").alias("low"), F.col("b.tokens").alias("tokens")))
        if level + 1 < LEVELS:
            found = found.drop("tokens")
    # The last bucket is one hash: it is taken if that comes nearer.
    limit = F.col("low") + (F.col("open") * 2 > F.col("tokens")).cast("bigint")
    return parts.join(found.select("source", limit.alias("limit")), "source", "left").select(
        "source", F.when(F.col("part") > 0, F.coalesce("limit", F.lit((1 << 63) - 1))).otherwise(F.lit(0)).alias("limit")
    )


def mixed(docs: DataFrame, targets: DataFrame, budget: int | None = None, ranks: str = RANKS) -> DataFrame:
    """doc_id, source, tokens, repeats, target_share, actual_share of every chosen document.

    NULL and empty texts, sources without a target and documents that are not
    chosen give no row; repeated rows are chosen one by one; a target without
    documents is not met. actual_share is the source's share of all chosen
    tokens, repeats counted.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text"), 1)
    wanted_sources = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source").distinct()
    texts = docs.select("doc_id", "source", "text", hashed.alias("hash")).join(F.broadcast(wanted_sources), "source", "left_semi")
    sizes = checkpointed(with_tokens(texts, ranks=ranks).filter("tokens > 0"))
    plan = checkpointed(planned(sizes, targets, budget))
    times = plan.filter("total > 0").select(
        "source", "target_share", F.expr("wanted div total").cast("int").alias("times"), F.expr("wanted % total").alias("part")
    )
    limits = times.join(thresholds(sizes, times.select("source", "part")), "source")
    chosen = sizes.join(F.broadcast(limits), "source").withColumn("repeats", F.col("times") + (F.col("hash") < F.col("limit")).cast("int"))
    chosen = chosen.filter("repeats > 0").select("doc_id", "source", "tokens", "repeats", "target_share")
    given = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("given"))
    share = given.withColumn("actual_share", F.col("given") / F.sum("given").over(Window.partitionBy(F.lit(1)))).drop("given")
    return chosen.join(F.broadcast(share), "source").select("doc_id", "source", "tokens", "repeats", "target_share", "actual_share")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Of every target: source, target_share, max_repeats, documents, tokens, most_repeats, actual_share."""
    given = mix.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"),
        F.max("repeats").alias("most_repeats"),
        F.first("actual_share").alias("actual_share"),
    )
    return targets.join(given, "source", "left").fillna(0, ["documents", "tokens", "most_repeats", "actual_share"])
