"""Lines of FIXTURES.md section 3."""

from pyspark.sql import functions as F

from linematch.functions.parser import parse_line

GOLDENS = {
    "2 kg rice": (2.0, "kg", "rice"),
    "rice 2kg": (2.0, "kg", "rice"),
    "Soap x 4": (4.0, "piece", "Soap"),
    "ચોખા પ કિલો": (5.0, "kg", "ચોખા"),
    "ચોખા": (None, None, "ચોખા"),
    "10 રૂ. ની ધાણાદાળ": (10.0, "rupee", "ધાણાદાળ"),
    "સોપારી 10 સુંઘારી": (10.0, None, "સોપારી સુંઘારી"),
    "rice 5 kg basmati": (5.0, "kg", "rice basmati"),
    "rice - 2kg": (2.0, "kg", "rice -"),
    "0 kg rice": (None, None, "0 kg rice"),
    "2 kg soap x 4": (4.0, "piece", "soap"),
    "5 kg": (5.0, "kg", ""),
}


def test_goldens(spark):
    lines = spark.createDataFrame([(x,) for x in [*GOLDENS, None, " "]], "line string")
    got = {r.line: r.p for r in lines.select("line", parse_line(F.col("line")).alias("p")).collect()}
    assert got.pop(None) is None and got.pop(" ") is None
    assert {k: (p.quantity, p.unit, p.product_text) for k, p in got.items()} == GOLDENS
