"""Each lm_* function against its DataFrame form."""

from pyspark.sql import functions as F

from linematch.functions import similarity, sql
from linematch.functions.parser import parse_line

TEXTS = ["  Rice, 2 KG! ", "ચોખા ૫ કિલો", "rice - 2 kg", "it's \\ \"5\"", "Soap x 4", "सोपारी 10 x", "", " ", None]


def test_every_function(spark):
    assert len(sql.register(spark)) == 10
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("n", F.length("a") / 10.0)
    forms = {f"{name}(a)": make(F.col("a")) for name, (make, _) in sql._STRING.items()}
    forms["lm_parse_line(a)"] = parse_line(F.col("a"))
    forms |= {f"{name}(a, b)": make(F.col("a"), F.col("b")) for name, make in sql._PAIR.items()}
    forms["lm_confidence_band(n)"] = similarity.confidence_band(F.col("n"))
    for text, column in forms.items():
        got = rows.select("a", "b", F.expr(text).alias("s"), column.alias("d")).collect()
        assert [r.s for r in got] == [r.d for r in got], text
