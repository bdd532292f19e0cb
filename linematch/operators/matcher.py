"""Items scored against a catalog, best candidates first.

Every item is compared with every product, as the score is defined; each
distinct query is compared once. A block of products under a checked size
travels with the tasks, which score a batch of queries as matrices and keep the
best candidates, so that no pair is ever a row and nothing but candidates
leaves a task. A catalog beyond the bound comes in blocks whose candidates merge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linematch.functions.similarity import confidence_band
from linematch.functions.text import normalize_text
from linematch.operators.scoring import Block, Product, best_columns, catalog_evidence, total_score
from linematch.plans.lineage import checkpointed

DEFAULT_OCR = 0.70
TOP_K = 5

#: Bytes of catalog text that one block may hold.
MAX_BROADCAST_BYTES = 16 << 20
#: Cells of a query-by-term matrix.
_CELLS = 1 << 20
_SCORES = ["score", "text_score", "token_score", "embedding_score", "exact_alias_score", "brand_score", "unit_score", "catalog_evidence"]
_CANDIDATE = "q string, unit string, ocr double, catalog_pos bigint, sku string, canonical_name string, " + ", ".join(
    f"{s} double" for s in _SCORES
)


def queries_of(items: DataFrame) -> DataFrame:
    """Distinct (q, unit, ocr) of items with product_text, unit, ocr_confidence."""
    ocr = F.col("ocr_confidence")
    return items.select(
        normalize_text(F.col("product_text")).alias("q"),
        "unit",
        F.when(ocr > 0, ocr).otherwise(DEFAULT_OCR).alias("ocr"),
    ).distinct()


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _normalized(products: DataFrame) -> DataFrame:
    """The fields of Product; NULL names and lists count as empty."""
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    each = lambda name: F.transform(_list(name), lambda x: normalize_text(x))
    return products.select(
        F.col("catalog_pos").cast("bigint").alias("catalog_pos"),
        text("sku").alias("sku"),
        text("canonical_name").alias("canonical_name"),
        normalize_text(F.col("canonical_name")).alias("name"),
        each("aliases").alias("aliases"),
        each("ocr_errors").alias("errors"),
        text("brand").alias("brand"),
        normalize_text(F.col("brand")).alias("brand_norm"),
        each("units").alias("units"),
    )


def _size(products: DataFrame) -> int:
    text = F.concat_ws("|", "sku", "canonical_name", "canonical_name", "brand", "brand", "aliases", "ocr_errors", "units")
    return int(products.agg(F.sum(F.lit(64) + F.octet_length(text))).first()[0] or 0)


def catalog_blocks(products: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> list[DataFrame]:
    """The catalog in blocks under the bound (one small aggregate decides)."""
    n = _size(products) // max_broadcast_bytes + 1
    if n == 1:
        return [products]
    return [products.filter(F.pmod(F.xxhash64("catalog_pos", "sku"), F.lit(n)) == i) for i in range(n)]


def _candidates(queries: DataFrame, block: DataFrame, k: int | None) -> DataFrame:
    """The k best products of a block for every query, all of them if k is None."""
    products = [Product(*r) for r in _normalized(block).collect()]  # under the bound
    spark = queries.sparkSession
    named = F.when(F.col("unit").isNotNull(), normalize_text(F.col("unit"))).alias("unit_norm")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Equal texts come together, as only unit and confidence tell them apart; being distinct, none of them has many rows.
    spread = queries.select("q", "unit", "ocr", named).repartition(n, "q").sortWithinPartitions("q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Block | None = None
        for batch in batches:
            if not products or not batch.num_rows:
                continue
            held = held or Block(products)
            step = max(1, _CELLS // max(len(held.number), len(products)))
            for a in range(0, batch.num_rows, step):
                yield _scored(held, batch.slice(a, step), k)

    return spread.mapInArrow(run, _CANDIDATE)


def _scored(block: Block, queries: pa.RecordBatch, k: int | None) -> pa.RecordBatch:
    texts, units, ocr = (queries.column(i) for i in range(3))  # the fourth is the normalised unit
    coded = texts.dictionary_encode()
    distinct, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    none = np.zeros(len(block.products))
    unit = np.array([none if u is None else block.units.get(u, none) for u in queries.column(3).to_pylist()])
    certain = ocr.to_numpy(zero_copy_only=False)[:, None]
    compared = block.compare(distinct)

    def scores() -> tuple[dict[str, np.ndarray], np.ndarray]:
        c = {name: x[of] for name, x in block.components(distinct, compared).items()}
        return c, total_score(c, certain, unit)

    def settle(products: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Exact scores of the marked products (row, product)."""
        by_text = np.zeros((len(distinct), products.shape[1]), bool)
        np.logical_or.at(by_text, of, products)
        compared.exact(block.using(by_text))
        return scores()

    if k is None or k >= len(block.products):
        components, score = settle(np.ones((len(of), len(block.products)), bool))
    else:
        _, highest = scores()
        first = np.zeros(highest.shape, bool)
        first[best_columns(highest, k)] = True
        _, score = settle(first)
        least = np.where(first, score, np.inf).min(axis=1, keepdims=True)  # k products have at least this
        able = highest >= least - 1e-9
        components, score = settle(able)
        score = np.where(able, score, -np.inf)
    row, column = best_columns(score, k or score.shape[1])
    at = pa.array(row)
    columns = [score, components["best"], components["tok"], np.zeros(score.shape), components["exact"], components["brand"], unit, catalog_evidence(components, unit)]
    chosen = [block.products[j] for j in column.tolist()]
    arrays = [
        texts.take(at).cast(pa.string()), units.take(at).cast(pa.string()), ocr.take(at),
        pa.array([p.catalog_pos for p in chosen], pa.int64()), pa.array([p.sku for p in chosen], pa.string()),
        pa.array([p.canonical_name for p in chosen], pa.string()), *(pa.array(x[row, column]) for x in columns),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["q", "unit", "ocr", "catalog_pos", "sku", "canonical_name", *_SCORES])


def _top(scored: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("q", "unit", "ocr").orderBy(F.col("score").desc(), F.col("catalog_pos"), F.col("sku"))
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def match_items(
    items: DataFrame,
    products: DataFrame,
    k: int = TOP_K,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    embedding: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """The k best candidates of every distinct query of items.

    items: product_text, unit, ocr_confidence (others are ignored; join back on
    q = normalize_text(product_text), unit and ocr, null-safe). Equal scores
    are ranked by catalog_pos, then sku. NULL and empty product_text are the
    empty query. An empty catalog or no items give no rows. embedding, a
    function of q and canonical_name, fills embedding_score of the candidates;
    that column has no weight in the score.
    """
    queries = queries_of(items)
    blocks = catalog_blocks(products, max_broadcast_bytes)
    if len(blocks) > 1:
        queries = checkpointed(queries)  # each block reads them
    best = _candidates(queries, blocks[0], k)
    for block in blocks[1:]:
        best = best.unionByName(_candidates(queries, block, k))
    best = _top(best, k).withColumn("confidence_band", confidence_band(F.col("score")))
    return best if embedding is None else best.withColumn("embedding_score", embedding(F.col("q"), F.col("canonical_name")))


def score_components(items: DataFrame, products: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """All scores of every distinct query of items and every product; for reports, not for matching."""
    queries = queries_of(items)
    parts = [_candidates(queries, block, None) for block in catalog_blocks(products, max_broadcast_bytes)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.withColumn("confidence_band", confidence_band(F.col("score")))
