"""Streams of documents through the batch pipeline, once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linematch.plans.pipeline import match_parsed, parse_items, split_lines


def match_stream(docs: DataFrame, products: DataFrame, out: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Writes matched items to out/batch_id=N as Parquet; a replayed batch replaces its own folder.

    Items are stateless, so nothing is kept between batches; the catalog is
    static. (key, line_no) identifies a row.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_items(split_lines(batch, "text", (key,))).persist()  # read for the queries and for the join
        try:
            match_parsed(parsed, products).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            parsed.unpersist()

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
