"""Catalog lines as the reference splits them."""

from pyspark.sql import functions as F

from linematch.sources.catalog import products_from_lines, split_csv

CASES = {
    'AB123,name,cat,al"ias': ["AB123", "name", "cat", 'al"ias'],
    'A,B,C,D,E,F,G"x,H,I,J': ["A", "B", "C", "D", "E", "F", 'G"x,H,I,J'],
    'a,"b, ""c"", d" ,e,': ["a", '"b, ""c"", d" ', "e", ""],
    "a\\b,\\c,\\": ["a\\b", "\\c", "\\"],
    ",".join("abcdefghijklmn"): list("abcdefghijkl"),
    ",".join(['"x,y"'] * 20000): ['"x,y"'] * 12,
}


def test_split_csv(spark):
    lines = spark.createDataFrame([(x,) for x in [*CASES, None]], "line string")
    got = {r.line: r.f for r in lines.select("line", split_csv(F.col("line")).alias("f")).collect()}
    assert got.pop(None) is None
    assert got == CASES


def test_stray_quote_is_loaded(spark):
    lines = spark.createDataFrame([(0, "sku,canonical_name,category,aliases"), (1, 'AB123,name,cat,al"ias')], "line_no int, line string")
    (row,) = products_from_lines(lines).collect()
    assert (row.sku, row.canonical_name, row.category, row.aliases) == ("AB123", "name", "cat", ['al"ias'])


def test_caps_are_off_by_default(spark):
    from linematch.sources.catalog import PARITY_CAPS

    many = "|".join(f"a{i}" for i in range(40))
    lines = spark.createDataFrame([(1, f"S1,n,b,c,{many},,,{many},{many},{many},,,x")], "line_no int, line string")
    (row,) = products_from_lines(lines).collect()
    assert (len(row.aliases), len(row.ocr_errors), len(row.units)) == (40, 40, 80)
    (row,) = products_from_lines(lines, **PARITY_CAPS).collect()
    assert (len(row.aliases), len(row.ocr_errors), len(row.units)) == (32, 32, 16)


def test_files_in_blocks(spark, tmp_path):
    from linematch.sources.catalog import read_catalog_csv

    for name, n in (("b", 300), ("a", 200)):
        rows = "".join(f"{name.upper()}{i:04d},Name {i},Cat,{'x' * (i % 50)}\n" for i in range(n))
        (tmp_path / f"{name}.csv").write_text("sku,canonical_name,category,aliases\n" + rows)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = read_catalog_csv(spark, str(tmp_path)).orderBy("catalog_pos").collect()
        assert [r.sku for r in got] == [f"A{i:04d}" for i in range(200)] + [f"B{i:04d}" for i in range(300)]
        assert [r.catalog_pos for r in got[:3]] == [1, 2, 3]
        assert [r.sku for r in read_catalog_csv(spark, str(tmp_path), max_products=2).collect()] == ["A0000", "A0001"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_short_lines(spark):
    from linematch.sources.catalog import short_lines

    lines = spark.createDataFrame([(1, "a,b,c,d"), (2, 'a,"b,c",d'), (3, "# a"), (4, ""), (5, None), (6, "a")], "line_no int, line string")
    assert sorted((r.line_no, r.reason) for r in short_lines(lines).collect()) == [(2, "column_count"), (6, "column_count")]
    assert [r.sku for r in products_from_lines(lines).collect()] == ["a"]
