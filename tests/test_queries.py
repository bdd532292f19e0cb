"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(entry.oracle_sql()[name])
    frame = entry.queries()[name](spark, DATA)
    assert frame.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_entry(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert entry.entry(spark).count() == lines > 0
