"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: A file of ranks: base64 of a token's bytes, a blank, its number.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(2)
def _encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", ranks: str = RANKS, drop_text: bool = True) -> DataFrame:
    """df with tokens, the size of each text; NULL text has NULL. The text itself is dropped unless asked for."""
    if "tokens" in df.columns:
        raise ValueError("a column tokens exists already")
    keep = [f for f in df.schema.fields if not (drop_text and f.name == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            sizes = pa.array([None if t is None else len(encode(t)) for t in (x.as_py() for x in texts)], pa.int64())
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, sizes], [*(f.name for f in keep), "tokens"])

    return df.mapInArrow(run, StructType([*keep, StructField("tokens", LongType())]))
