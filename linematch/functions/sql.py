"""The scalar functions as SQL functions that Catalyst inlines; lm_parse_line is an Arrow function."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from linematch.functions import similarity, text
from linematch.functions.parser import PARSERS

_STRING = {
    "lm_trim": (text.trim, "string"),
    "lm_normalize_digits": (text.normalize_digits, "string"),
    "lm_normalize_text": (text.normalize_text, "string"),
    "lm_detect_language": (text.detect_language, "string"),
    "lm_has_content": (text.has_content, "boolean"),
}
_PAIR = {
    "lm_char_similarity": similarity.char_similarity,
    "lm_token_overlap": similarity.token_overlap,
    "lm_hybrid_similarity": similarity.hybrid_similarity,
}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _text(node) -> str:
    """SQL of a column's node; operators are called by their quoted function names."""
    kind = node.getClass().getSimpleName()
    if kind in ("Literal", "UnresolvedAttribute", "UnresolvedNamedLambdaVariable"):
        return node.sql()
    if kind == "UnresolvedFunction":
        name = node.functionName()
        name = name if name == "struct" else f"`{name}`"  # only the keyword takes named arguments
        return f"{name}({', '.join(map(_text, _items(node.arguments())))})"
    if kind == "CaseWhenOtherwise":
        cases = "".join(f" WHEN {_text(b._1())} THEN {_text(b._2())}" for b in _items(node.branches()))
        last = node.otherwise()
        return f"CASE{cases}{f' ELSE {_text(last.get())}' if last.isDefined() else ''} END"
    if kind == "Cast":
        mode = node.evalMode()
        tried = mode.isDefined() and "Try" in mode.get().getClass().getSimpleName()
        return f"{'TRY_CAST' if tried else 'CAST'}({_text(node.child())} AS {node.dataType().sql()})"
    if kind == "Alias":
        return f"{_text(node.child())} AS `{node.name().head()}`"
    if kind == "LambdaFunction":
        names = [_text(x) for x in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else f'({", ".join(names)})'} -> {_text(node.function())}"
    if kind == "UnresolvedExtractValue":
        return f"{_text(node.child())}[{_text(node.extraction())}]"
    raise TypeError(f"no SQL for {kind}")


def _sql(spark: SparkSession, column: Column) -> str:
    return _text(column._jc.node())


def register(spark: SparkSession) -> list[str]:
    """Registers lm_* for SQL text; the names registered."""
    names = []
    for name, (make, kind) in _STRING.items():
        names.append(_create(spark, name, {"a": "string"}, kind, make(F.col("a"))))
    for name, make in _PAIR.items():
        names.append(_create(spark, name, {"a": "string", "b": "string"}, "double", make(F.col("a"), F.col("b"))))
    names.append(_create(spark, "lm_confidence_band", {"a": "double"}, "string", similarity.confidence_band(F.col("a"))))
    spark.udf.register("lm_parse_line", PARSERS[True])
    return [*names, "lm_parse_line"]


def _create(spark: SparkSession, name: str, args: dict[str, str], kind: str, body: Column) -> str:
    signature = ", ".join(f"{k} {v}" for k, v in args.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS {kind} RETURN {_sql(spark, body)}")
    return name
