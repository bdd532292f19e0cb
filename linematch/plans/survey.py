"""More queries over whole tables, each with its SQL where SQL can say it.

Lines are built from known parts, so that the SQL selects the parts and is
independent of the parser; scores are computed in SQL from their definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linematch.functions import similarity, text
from linematch.functions.parser import parse_line
from linematch.functions.units import PARSER_UNITS
from linematch.operators.decision import decide
from linematch.operators.matcher import match_items, score_components
from linematch.plans.checks import _BUILT, _parsed, _query, _table, listed_catalog, part_catalog
from linematch.plans.lineage import checkpointed, shared_folder
from linematch.plans.pipeline import process_uploads, split_lines
from linematch.sources.catalog import products_from_lines, terms_of
from linematch.sources.ocr import MockOcr, NAME_RULES, DEFAULT_TEXT
from linematch.streaming.match_stream import match_stream

# Text -------------------------------------------------------------------------------------------

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_COUNT = "length(regexp_replace(text, '[^\\x{{{}}}-\\x{{{}}}]', '', 'g'))"
_GUJ, _DEV = _COUNT.format("0A80", "0AFF"), _COUNT.format("0900", "097F")


@_query(
    f"SELECT doc_id, CASE WHEN {_GUJ} > 0 AND {_GUJ} >= {_DEV} THEN 'guj' WHEN {_DEV} > 0 THEN 'hin' "
    "WHEN regexp_matches(text, '[A-Za-z]') THEN 'eng' ELSE 'unknown' END AS language FROM documents"
)
def detect_language_docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


def _language_of(make):
    def query(spark, sf_dir):
        return _table(spark, sf_dir, "part").select("p_partkey", text.detect_language(make()).alias("language"))

    return query


for _name, _language, _make in (
    ("detect_language_guj", "guj", lambda: F.concat_ws(" ", "p_name", F.lit("ચોખા"))),
    ("detect_language_hin", "hin", lambda: F.concat_ws(" ", "p_name", F.lit("चावल"))),
    ("detect_language_unknown", "unknown", lambda: F.col("p_partkey").cast("string")),
):
    _made = _language_of(_make)
    _made.__name__ = _name
    _query(f"SELECT p_partkey, '{_language}' AS language FROM part")(_made)


def _lines_sql(table: str, key: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex(text, '[\\r\\n]+'), lambda x: trim(x, {_BLANK})), lambda x: x <> '')"
    return f"WITH l AS (SELECT {key}, {lines} AS l FROM {table}) SELECT {key}, unnest(l) AS raw_text, unnest(range(1, len(l) + 1)) AS line_no FROM l"


@_query(_lines_sql("documents", "doc_id"))
def split_lines_documents(spark, sf_dir):
    return split_lines(_table(spark, sf_dir, "documents")).select("doc_id", "raw_text", "line_no")


@_query(_lines_sql("scan_docs", "scan_id"))
def split_lines_scans(spark, sf_dir):
    return split_lines(_table(spark, sf_dir, "scan_docs"), keep=("scan_id",)).select("scan_id", "raw_text", "line_no")


@_query(
    f"WITH l AS ({_lines_sql('documents', 'doc_id')}) SELECT doc_id, line_no, trim(regexp_replace(translate(translate(replace(raw_text, chr(65279), ''), "
    f"'{text.GUJARATI_DIGITS}{text.DEVANAGARI_DIGITS}', '01234567890123456789'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F\\xA0]+', ' ', 'g'), ' ') AS normalized_text FROM l"
)
def normalize_lines(spark, sf_dir):
    lines = split_lines(_table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "line_no", text.normalize_text(F.col("raw_text")).alias("normalized_text"))


# Similarity -------------------------------------------------------------------------------------


def _char(a: str, b: str) -> str:
    longer = f"greatest(length({a}), length({b}))"
    bound = f"(1.0::DOUBLE - abs(length({a}) - length({b}))::DOUBLE / {longer})"
    return (
        f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {bound} < 0.2::DOUBLE THEN {bound} "
        f"ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / {longer} END)"
    )


def _tok(a: str, b: str) -> str:
    shared = f"len(list_filter(string_split({a}, ' '), lambda x: list_contains(string_split({b}, ' '), x)))::DOUBLE"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE {shared} / len(string_split({a}, ' ')) END)"


def _hyb(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 0.65::DOUBLE * {_char(a, b)} + 0.35::DOUBLE * {_tok(a, b)} END)"


_PAIRS = (
    "WITH p AS (SELECT a.p_partkey, a.p_name AS a, b.p_type || ' ' || b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), "
    "n AS (SELECT p_partkey, a, lower(b) AS nb FROM p) "
)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name beside type and name of the part that follows it."""
    part = _table(spark, sf_dir, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_type", "p_name").alias("b"))
    return part.select("p_partkey", F.col("p_name").alias("a")).join(after, "p_partkey")


@_query(_PAIRS + f"SELECT p_partkey, round({_tok('a', 'nb')}, 10) AS similarity FROM n")
def token_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(similarity.token_overlap(F.col("a"), F.col("b")), 10).alias("similarity"))


@_query(_PAIRS + f"SELECT p_partkey, round({_hyb('a', 'nb')}, 10) AS similarity FROM n")
def hybrid_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(similarity.hybrid_similarity(F.col("a"), F.col("b")), 10).alias("similarity"))


_BAND = "CASE WHEN {0} >= 0.8 THEN 'HIGH' WHEN {0} >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"


@_query(_PAIRS + f", s AS (SELECT p_partkey, {_hyb('a', 'nb')} AS h FROM n) SELECT p_partkey, {_BAND.format('h')} AS band FROM s")
def band(spark, sf_dir):
    score = similarity.hybrid_similarity(F.col("a"), F.col("b"))
    return _pairs(spark, sf_dir).select("p_partkey", similarity.confidence_band(score).alias("band"))


@_query(
    "WITH p AS (SELECT p_partkey, left(p_name, 1) AS a, repeat(p_name, 2) AS b FROM part) "
    f"SELECT p_partkey, round({_char('a', 'b')}, 10) AS similarity FROM p"
)
def char_similarity_length_bound(spark, sf_dir):
    short, long = F.left("p_name", F.lit(1)), F.repeat("p_name", 2)
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(similarity.char_similarity(short, long), 10).alias("similarity"))


# Parser -----------------------------------------------------------------------------------------

_MADE = "SELECT l_orderkey, l_linenumber, {} AS product_text, {} AS quantity, {} AS unit FROM lineitem JOIN part ON l_partkey = p_partkey"
_N = "CAST(CAST(l_quantity AS INTEGER) AS DOUBLE)"


@_query(_MADE.format("p_name || ' fresh'", _N, "'kg'"))
def parse_embedded(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda name, n: F.concat_ws(" ", name, n, F.lit("kg fresh")))


@_query(_MADE.format("p_name", "5.0::DOUBLE", "'kg'"))
def parse_five_recovery(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda name, n: F.concat_ws(" ", name, F.lit("પ કિલો")))


@_query(_BUILT.format("'kg'"))
def parse_suffix(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda name, n: F.concat(n, F.lit(" kg "), name, F.lit("wali")))


@_query(_BUILT.format("'rupee'"))
def parse_postposition(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda name, n: F.concat_ws(" ", n, F.lit("રૂ. ની"), name))


@_query(_MADE.format("p_name", f"{_N} + 0.5", "'kg'"))
def parse_decimal_comma(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda name, n: F.concat_ws(" ", name, F.concat(n, F.lit(",5")), F.lit("kg")))


@_query(_MADE.format("'0 kg ' || p_name", "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"))
def parse_zero_rejected(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda name, n: F.concat(F.lit("0 kg "), name))


_SPELLINGS = ", ".join(f"('{w}', '{u}')" for w, u in PARSER_UNITS.items())


@_query(f"SELECT p_partkey, w AS spelling, p_name AS product_text, 3.0::DOUBLE AS quantity, u AS unit FROM part, (VALUES {_SPELLINGS}) AS s(w, u)")
def parse_unit_synonyms(spark, sf_dir):
    words = F.explode(F.array(*map(F.lit, PARSER_UNITS))).alias("spelling")
    lines = _table(spark, sf_dir, "part").select("p_partkey", "p_name", words)
    item = lines.withColumn("i", parse_line(F.concat_ws(" ", "p_name", F.lit("3"), "spelling")))
    return item.select("p_partkey", "spelling", "i.product_text", "i.quantity", "i.unit")


# Catalog ----------------------------------------------------------------------------------------


def _quoted(name: str) -> Column:
    return F.concat(F.lit('"'), F.coalesce(F.col(name), F.lit("")), F.lit('"'))


_LISTS = (
    "concat_ws('|', aliases_en, aliases_gu, aliases_hi) AS aliases, coalesce(ocr_errors, '') AS ocr_errors, concat_ws('|', units, pack_sizes) AS units"
)


@_query(f"SELECT sku, canonical_name, coalesce(brand, '') AS brand, coalesce(category, '') AS category, {_LISTS} FROM catalog_products")
def csv_catalog_roundtrip(spark, sf_dir):
    """The catalog rendered to lines of the full layout and read back."""
    names = ["sku", "canonical_name", "brand", "category", "aliases_en", "aliases_gu", "aliases_hi", "ocr_errors", "units", "pack_sizes"]
    catalog = _table(spark, sf_dir, "catalog_products")
    lines = catalog.select(F.concat_ws(",", *map(_quoted, names)).alias("line"), (F.col("catalog_pos") + 1).alias("line_no"))
    header = spark.createDataFrame([(",".join(names), 0)], "line string, line_no int")
    read = products_from_lines(lines.unionByName(header))
    flat = [F.array_join(c, "|").alias(c) for c in ("aliases", "ocr_errors", "units")]
    return read.select("sku", "canonical_name", "brand", "category", *flat)


@_query("SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS canonical_name, p_type AS category, p_brand AS alias FROM part")
def csv_short_layout(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    line = F.concat_ws(",", "p_partkey", "p_name", F.concat(F.lit('"'), "p_type", F.lit('"')), "p_brand")
    read = products_from_lines(part.select(line.alias("line"), F.col("p_partkey").alias("line_no")))
    return read.select("sku", "canonical_name", "category", F.array_join("aliases", "|").alias("alias"))


_AL = "list_filter(string_split(concat_ws('|', aliases_en, aliases_gu, aliases_hi), '|'), lambda x: x <> '')"
_OE = "string_split(ocr_errors, '|')"


@_query(
    "SELECT catalog_pos, 'canonical' AS kind, 0 AS ord, canonical_name AS term FROM catalog_products "
    "UNION ALL SELECT catalog_pos, 'brand', 0, brand FROM catalog_products WHERE brand <> '' "
    f"UNION ALL SELECT catalog_pos, 'alias', unnest(range(1, len({_AL}) + 1)), unnest({_AL}) FROM catalog_products "
    f"UNION ALL SELECT catalog_pos, 'ocr_error', unnest(range(1, len({_OE}) + 1)), unnest({_OE}) FROM catalog_products WHERE ocr_errors IS NOT NULL"
)
def catalog_terms_explode(spark, sf_dir):
    return terms_of(listed_catalog(spark, sf_dir))


# Matching ---------------------------------------------------------------------------------------


def _scored(queries: str, name: str = "p_name", alias: str = "''", error: str = "''", source: str = "part") -> str:
    """CTEs up to s (q, unit, catalog_pos, sku, best, tok, exact, brand, unit_score, score) of queries (q, unit) and part."""
    alias_fits = "alias <> '' AND length(q) <= 3 * length(alias) AND length(alias) <= 3 * length(q)"
    return (
        f"WITH q AS ({queries}), c AS (SELECT p_partkey AS catalog_pos, CAST(p_partkey AS VARCHAR) AS sku, {name} AS name, {alias} AS alias, "
        f"{error} AS error, p_brand AS raw_brand, replace(lower(p_brand), '#', ' ') AS brand FROM {source} part), "
        "e AS (SELECT *, q = name AS by_name, q <> name AND alias <> '' AND q = alias AS by_alias, "
        "CASE WHEN unit = 'kg' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS unit_score FROM q, c), "
        f"b AS (SELECT *, CASE WHEN by_name OR by_alias THEN 1.0::DOUBLE ELSE greatest({_hyb('q', 'name')}, "
        f"CASE WHEN {alias_fits} THEN {_hyb('q', 'alias')} ELSE 0.0::DOUBLE END, CASE WHEN error <> '' THEN {_hyb('q', 'error')} ELSE 0.0::DOUBLE END) END AS best, "
        f"greatest({_tok('q', 'name')}, {_tok('q', 'alias')}) AS tok, CASE WHEN by_name OR by_alias THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact, "
        f"CASE WHEN by_name THEN 0.0::DOUBLE WHEN by_alias THEN CASE WHEN contains(q, raw_brand) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {_hyb('q', 'brand')} END AS brand_score FROM e), "
        "s AS (SELECT q, unit, catalog_pos, sku, best, tok, exact, brand_score, unit_score, least(1.0::DOUBLE, 0.42::DOUBLE * best + 0.22::DOUBLE * tok + 0.16::DOUBLE * exact "
        "+ 0.05::DOUBLE * brand_score + 0.10::DOUBLE * 0.70::DOUBLE + 0.05::DOUBLE * unit_score + CASE WHEN exact > 0.99 THEN 0.10::DOUBLE WHEN best > 0.88 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM b), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY q, unit ORDER BY score DESC, catalog_pos) AS rank FROM s) "
    )


_SHORT = "SELECT DISTINCT trim(left(p_name, length(p_name) - 1)) AS q, 'kg' AS unit FROM part"
_NAMES = "SELECT DISTINCT p_name AS q, 'kg' AS unit FROM part"
_BEST = "SELECT q, sku, round(score, 10) AS score, round(best, 10) AS text_score FROM r WHERE rank = 1"


def _items(spark: SparkSession, sf_dir: str, q: Column, units: tuple[str | None, ...] = ("kg",), table: str = "part") -> DataFrame:
    unit = F.explode(F.array(*[F.lit(u).cast("string") for u in units]))
    return _table(spark, sf_dir, table).select(q.alias("product_text"), unit.alias("unit"), F.lit(None).cast("double").alias("ocr_confidence"))


def _shortened() -> Column:
    return F.expr("left(p_name, length(p_name) - 1)")


def _first(matched: DataFrame) -> DataFrame:
    return matched.filter("rank = 1").select("q", "sku", F.round("score", 10).alias("score"), F.round("text_score", 10).alias("text_score"))


def _renamed(spark, sf_dir, **lists: str) -> DataFrame:
    """part as a catalog whose names say nothing and whose lists hold p_name."""
    part = part_catalog(spark, sf_dir)
    for name in lists.values():
        part = part.withColumn(name, F.array("canonical_name"))
    return part.withColumn("canonical_name", F.concat(F.lit("item "), "sku"))


@_query(_scored(_SHORT) + _BEST)
def match_fuzzy(spark, sf_dir):
    return _first(match_items(_items(spark, sf_dir, _shortened()), part_catalog(spark, sf_dir)))


@_query(_scored(_NAMES, name="'item ' || p_partkey", alias="p_name") + _BEST)
def match_exact_alias(spark, sf_dir):
    return _first(match_items(_items(spark, sf_dir, F.col("p_name")), _renamed(spark, sf_dir, to="aliases")))


@_query(_scored(_NAMES, name="'item ' || p_partkey", error="p_name") + _BEST)
def match_ocr_error(spark, sf_dir):
    return _first(match_items(_items(spark, sf_dir, F.col("p_name")), _renamed(spark, sf_dir, to="ocr_errors")))


@_query(
    _scored("SELECT DISTINCT replace(lower(p_brand), '#', ' ') || ' ' || p_name AS q, 'kg' AS unit FROM part")
    + "SELECT q, catalog_pos, round(brand_score, 10) AS brand_score FROM r WHERE rank = 1"
)
def match_brand(spark, sf_dir):
    items = _items(spark, sf_dir, F.concat_ws(" ", "p_brand", "p_name"))
    return match_items(items, part_catalog(spark, sf_dir)).filter("rank = 1").select("q", "catalog_pos", F.round("brand_score", 10).alias("brand_score"))


_UNITS = "SELECT DISTINCT p_name AS q, u AS unit FROM part, (VALUES ('kg'), ('piece'), (CAST(NULL AS VARCHAR))) AS v(u)"


@_query(_scored(_UNITS) + "SELECT q, unit, catalog_pos, unit_score, round(score, 10) AS score FROM r WHERE rank = 1")
def match_unit_evidence(spark, sf_dir):
    items = _items(spark, sf_dir, F.col("p_name"), ("kg", "piece", None))
    matched = match_items(items, part_catalog(spark, sf_dir)).filter("rank = 1")
    return matched.select("q", "unit", "catalog_pos", "unit_score", F.round("score", 10).alias("score"))


_ROUNDED = {"best": "text_score", "tok": "token_score", "exact": "exact_alias_score", "brand_score": "brand_score", "unit_score": "unit_score", "score": "score"}


@_query(_scored(_SHORT) + "SELECT q, catalog_pos, " + ", ".join(f"round({a}, 10) AS {b}" for a, b in _ROUNDED.items()) + " FROM s")
def score_components_part(spark, sf_dir):
    every = score_components(_items(spark, sf_dir, _shortened()), part_catalog(spark, sf_dir))
    return every.select("q", "catalog_pos", *[F.round(c, 10).alias(c) for c in _ROUNDED.values()])


@_query(_scored(_SHORT) + "SELECT q, catalog_pos, round(0.45::DOUBLE + 0.35::DOUBLE * greatest(exact, best, tok) + 0.20::DOUBLE * unit_score, 10) AS catalog_evidence FROM s")
def catalog_evidence(spark, sf_dir):
    every = score_components(_items(spark, sf_dir, _shortened()), part_catalog(spark, sf_dir))
    return every.select("q", "catalog_pos", F.round("catalog_evidence", 10).alias("catalog_evidence"))


@_query(_scored(_SHORT) + "SELECT q, rank, sku, round(score, 10) AS score FROM r WHERE rank <= 5")
def top5_part(spark, sf_dir):
    matched = match_items(_items(spark, sf_dir, _shortened()), part_catalog(spark, sf_dir))
    return matched.select("q", "rank", "sku", F.round("score", 10).alias("score"))


@_query(_scored("SELECT DISTINCT lower(p_type) AS q, 'kg' AS unit FROM part") + _BEST)
def top1_match(spark, sf_dir):
    return _first(match_items(_items(spark, sf_dir, F.lower("p_type")), part_catalog(spark, sf_dir), k=1))


# Policy -----------------------------------------------------------------------------------------

_CUT = (0, 1, 3, 6)
_SUPPLIED = (
    "SELECT q, CAST(NULL AS VARCHAR) AS unit FROM ("
    + " UNION ".join(f"SELECT trim(left(p_name, length(p_name) - {n})) AS q FROM part" for n in _CUT)
    + " UNION SELECT replace(lower(s_name), '#', ' ') FROM supplier)"
)
#: One product for each name, so that not every query is ambiguous.
_NAMED = "(SELECT min(p_partkey) AS p_partkey, p_name, min(p_brand) AS p_brand FROM part GROUP BY p_name)"
_RANKED = _scored(_SUPPLIED, source=_NAMED)
_DECIDED = (
    _RANKED
    + ", t AS (SELECT q, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2 FROM r WHERE rank <= 2 GROUP BY q), "
    "d AS (SELECT q, s1, CASE WHEN s1 < 0.35 THEN 'unidentified' WHEN s1 - s2 < 0.08 AND s1 < 0.9 THEN 'ambiguous' WHEN s1 >= 0.8 THEN 'confirmed' ELSE 'suggested' END AS status FROM t) "
)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of names cut short, and of suppliers' names, in a catalog with one product for each name."""
    items = _items(spark, sf_dir, F.col("s_name"), (None,), "supplier")
    for n in _CUT:
        items = items.unionByName(_items(spark, sf_dir, F.expr(f"left(p_name, length(p_name) - {n})"), (None,)))
    named = part_catalog(spark, sf_dir).groupBy("canonical_name").agg(F.min("catalog_pos").alias("catalog_pos"), F.min("brand").alias("brand"))
    no = F.array().cast("array<string>")
    named = named.withColumns({"sku": F.col("catalog_pos").cast("string"), "category": F.lit(""), "aliases": no, "ocr_errors": no, "units": F.array(F.lit("kg"))})
    return match_items(items, named)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(_ranked(spark, sf_dir), ["q", "unit", "ocr"])


@_query(
    _DECIDED + "SELECT q, status, status <> 'confirmed' AS needs_confirmation, round(CASE WHEN status = 'unidentified' THEN 0.0 ELSE s1 END, 10) AS confidence, "
    "CASE status WHEN 'unidentified' THEN 'insufficient_confidence' WHEN 'ambiguous' THEN 'multiple_close_candidates' WHEN 'confirmed' THEN 'high_confidence_match' "
    "ELSE CASE WHEN s1 >= 0.5 THEN 'moderate_confidence' ELSE 'low_confidence_suggestion' END END AS reason FROM d"
)
def status_policy(spark, sf_dir):
    return _decided(spark, sf_dir).select("q", "status", "needs_confirmation", F.round("confidence", 10).alias("confidence"), "reason")


@_query(_DECIDED + "SELECT status, count(*) AS items FROM d GROUP BY status")
def status_distribution(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("status").agg(F.count("*").alias("items"))


@_query(_RANKED + f"SELECT {_BAND.format('score')} AS band, count(*) AS candidates FROM r WHERE rank <= 5 GROUP BY 1")
def band_distribution(spark, sf_dir):
    return _ranked(spark, sf_dir).groupBy(F.col("confidence_band").alias("band")).agg(F.count("*").alias("candidates"))


@_query(_DECIDED + "SELECT q FROM d WHERE status = 'unidentified'")
def unidentified_lines(spark, sf_dir):
    return _decided(spark, sf_dir).filter("status = 'unidentified' AND product_id IS NULL AND size(candidates) = 0").select("q")


# Uploads and streams ----------------------------------------------------------------------------

_FILE = "lower(regexp_extract(path, '[^/]*$'))"
_BY_NAME = "CASE " + " ".join(f"WHEN regexp_matches({_FILE}, '{pattern}') THEN '{line}'" for pattern, line, _, _ in NAME_RULES)


def _sql_text(s: str) -> str:
    return s.replace("\n", "' || chr(10) || '")


@_query(f"SELECT scan_id, {_sql_text(_BY_NAME)} ELSE '{_sql_text(DEFAULT_TEXT)}' END AS text FROM (SELECT scan_id, coalesce(path, '') AS path FROM scan_docs)")
def mock_ocr_by_filename(spark, sf_dir):
    picture = F.unhex(F.lit("FFD8FFE0"))
    return _table(spark, sf_dir, "scan_docs").select("scan_id", MockOcr().extract(picture, F.col("path"))["text"].alias("text"))


@_query()
def upload_results(spark, sf_dir):
    """Every scanned list as an upload whose bytes are its text."""
    uploads = _table(spark, sf_dir, "scan_docs").select("scan_id", "path", F.col("text").cast("binary").alias("content"), "content_type")
    done = process_uploads(uploads, listed_catalog(spark, sf_dir), key="scan_id")
    return done.select("scan_id", "success", "language", "error", "status", F.size("items").alias("n_items"), "ocr_engine", "ocr_confidence")


@_query()
def streaming_match(spark, sf_dir):
    """The scanned lists as a stream: every matched item."""
    source = f"{sf_dir}/scan_docs.parquet"
    schema = spark.read.parquet(source).schema
    folder = shared_folder(spark)
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/scan_docs.parque[t]")  # a pattern, as the table may be one file
    catalog = checkpointed(listed_catalog(spark, sf_dir))
    match_stream(stream, catalog, f"{folder}/items", f"{folder}/progress", key="scan_id").awaitTermination()
    items = spark.read.parquet(f"{folder}/items")
    return items.select("scan_id", "line_no", "product_text", "quantity", "unit", "product_id", F.round("confidence", 4).alias("confidence"), "status")
