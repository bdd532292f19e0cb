"""Items packed into containers of fixed capacity, first-fit decreasing.

Items fall into groups by a hash, so that a group is a random sample of all
sizes and has a bounded number of items; each group is packed by itself. The
first container with room is found in a tournament tree whose inner nodes hold
the most room below them, in time logarithmic in the number of containers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linematch.llm.tokens import RANKS, with_tokens
from linematch.plans.lineage import checkpointed

#: Items of a group, on average.
GROUP_ITEMS = 20_000
#: Kinds of containers; each packs every item once.
MOST_KINDS = 100


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """Container of each item. Equal sizes keep their order; sizes must not exceed capacity; size 0 goes into the first container."""
    n = len(sizes)
    leaves = 1 << max(n - 1, 0).bit_length()
    room = [capacity] * (2 * leaves)
    place = np.zeros(n, np.int64)
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:  # the left side first: the first container with room
            node *= 2
            if room[node] < size:
                node += 1
        place[i] = node - leaves
        room[node] -= size
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            most = left if left >= right else right
            if room[node] == most:
                break
            room[node] = most
    return place


def pack(items: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "tokens", group_items: int = GROUP_ITEMS) -> DataFrame:
    """Every item placed in containers of each kind of containers (container, capacity_tokens).

    Result: key, container, capacity_tokens, piece, piece_tokens, container_no,
    fill_tokens. Only an item beyond the capacity is divided: its whole pieces
    fill a container each, and the rest is packed like any other item. NULL
    sizes give no row, size 0 takes no room, repeated rows are placed one by
    one. Kinds without a positive capacity are left out. Container numbers are
    unique within a kind: the upper 32 bits are the group.
    """
    items = items.select(key, F.col(size).cast("bigint").alias("tokens")).filter("tokens >= 0")
    n = items.count()
    groups = -(-n // group_items) or 1
    kinds = containers.filter("capacity_tokens > 0").select("container", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    each = [F.struct(F.lit(k.container).alias("container"), F.lit(k.capacity_tokens).cast("bigint").alias("capacity_tokens")) for k in kinds]
    if not each:
        items, each = items.limit(0), [F.struct(F.lit("").alias("container"), F.lit(1).cast("bigint").alias("capacity_tokens"))]
    keys = items.schema[key].dataType.simpleString()

    def place(group: pd.DataFrame) -> pd.DataFrame:
        capacity, number = int(group["capacity_tokens"].iloc[0]), int(group["grp"].iloc[0])
        # A defined order makes the result the same whenever the group is packed again.
        group = group.sort_values(["tokens", key], ascending=[False, True], kind="stable", na_position="last")
        tokens = group["tokens"].to_numpy(np.int64)
        whole = np.where(tokens > capacity, tokens // capacity, 0)
        rest = tokens - whole * capacity
        open_ = (rest > 0) | (whole == 0)
        at = np.flatnonzero(open_)
        no = first_fit_decreasing(rest[at], capacity)
        fill = np.bincount(no, rest[at], minlength=int(no.max(initial=-1)) + 1).astype(np.int64)
        full = np.repeat(np.arange(len(tokens)), whole)
        first = np.cumsum(whole) - whole
        piece = np.concatenate([np.arange(len(full)) - np.repeat(first, whole) + 1, whole[at] + 1])
        row = np.concatenate([full, at])
        return pd.DataFrame(
            {
                key: group[key].to_numpy()[row],
                "container": group["container"].iloc[0],
                "capacity_tokens": capacity,
                "piece": piece,
                "piece_tokens": np.concatenate([np.full(len(full), capacity), rest[at]]),
                "container_no": (number << 32) + np.concatenate([len(fill) + np.arange(len(full)), no]),
                "fill_tokens": np.concatenate([np.full(len(full), capacity), fill[no]]),
            }
        )

    grouped = items.withColumn("grp", F.pmod(F.xxhash64(F.lit("containers"), key, F.rand(17)), F.lit(groups)))
    return (
        grouped.select("*", F.inline(F.array(*each)))
        .groupBy("container", "grp")
        .applyInPandas(
            place,
            f"{key} {keys}, container string, capacity_tokens bigint, piece int, piece_tokens bigint, container_no bigint, fill_tokens bigint",
        )
    )


def packed_documents(docs: DataFrame, containers: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The documents' texts, sized in tokens, in containers of every kind."""
    return pack(checkpointed(with_tokens(docs.select("doc_id", "text"), ranks=ranks)), containers)


def unused_space(packed: DataFrame) -> DataFrame:
    """container, containers, least (the fewest that could hold all tokens), unused share of all space."""
    each = packed.groupBy("container", "capacity_tokens").agg(
        F.count_distinct("container_no").alias("containers"), F.sum("piece_tokens").alias("tokens")
    )
    space = F.col("containers") * F.col("capacity_tokens")
    return each.select(
        "container",
        "containers",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"),
        (1 - F.col("tokens") / space).alias("unused"),
    )
