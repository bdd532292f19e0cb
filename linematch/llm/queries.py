"""Queries of this subpackage, by name, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linematch.llm.canonical import inexact_values
from linematch.llm.consistent import inconsistent_fields
from linematch.llm.mixing import mixed, shares
from linematch.llm.packing import packed_documents, unused_space
from linematch.llm.reading import reading_bands

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(tables: str, name: str):
    def add(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()])
        return make

    return add


_query("list_items catalog_products", "p1_found")(inexact_values)
_query("list_items", "p2_found")(inconsistent_fields)
_query("documents container_sizes", "p6_containers")(packed_documents)
_query("documents container_sizes", "p6_unused_space")(lambda docs, kinds: unused_space(packed_documents(docs, kinds)))
_query("documents mix_targets", "p7_mix")(mixed)
_query("documents mix_targets", "p7_shares")(lambda docs, targets: shares(mixed(docs, targets), targets))
_query("documents reading_labels", "p8_found")(reading_bands)
