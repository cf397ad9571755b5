"""The registered queries: each operator over the test tables, beside its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import lexemes as L
from tallyloom.functions import text as T
from tallyloom.operators import mapping as M
from tallyloom.operators import order as O
from tallyloom.operators import routing as R
from tallyloom.operators import tables as P
from tallyloom.operators import validate as V
from tallyloom.plans import analogue as A
from tallyloom.plans.analogue import PEAKS_SQL, PLACE, PLACE_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- order -----------------------------------------------------------------------------------


@query("""
SELECT doc_id AS file_id, source || '/doc_' || doc_id || '.' || lang AS relative_path,
  row_number() OVER (ORDER BY CAST(regexp_extract(source, '[0-9]+') AS BIGINT), doc_id, lang) AS file_rank
FROM documents""")
def natural_order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_files(spark, sf_dir)
    return O.global_rank(d, [T.natural_key(F.col("relative_path")), F.col("file_id")], "file_rank").select("file_id", "relative_path", "file_rank")


@query("""
SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = A.document_files(spark, sf_dir).groupBy("sha256").agg(F.count("*").alias("n"), F.min("file_id").alias("first_id"))
    return groups.where("n > 1")


@query("""
SELECT doc_id AS file_id, nullif(min(doc_id) OVER (PARTITION BY source, lang), doc_id) AS duplicate_of FROM documents""")
def first_seen_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.sources.scan import mark_duplicates

    d = A.document_files(spark, sf_dir).withColumn("identity", F.concat_ws("/", "source", "lang"))
    return mark_duplicates(d).select("file_id", "duplicate_of")


@query("""
SELECT doc_id AS file_id, CASE WHEN n > 1 THEN 'input_' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INTEGER), '0') || '/' ELSE '' END || path AS relative_path
FROM (SELECT doc_id, source || '/' || upper(lang) AS path, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)""")
def path_collision_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.sources.scan import distinct_paths

    d = A.document_files(spark, sf_dir).withColumn("relative_path", F.concat("source", F.lit("/"), F.upper("lang")))
    return distinct_paths(d).select("file_id", "relative_path")


@query("""
SELECT 'auto' AS requested, 'acquired_at' AS effective,
  'All successful files have reliable, timezone-aware acquisition times.' || CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN ' Unavailable outcomes use natural filename fallback.' ELSE '' END AS reason
FROM orders""")
def auto_sort_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sort_decision(A.files(spark, sf_dir))


@query("""
SELECT o_orderkey AS file_id, row_number() OVER (ORDER BY o_orderstatus = 'P', CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, o_orderkey) AS file_rank,
  CASE WHEN o_orderstatus = 'P' THEN 'fallback:' || o_orderpriority || '/order_' || o_orderkey || '.csv' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS sort_key
FROM orders""")
def files_by_acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.order_files(A.files(spark, sf_dir), "acquired_at").select("file_id", "file_rank", "sort_key")


@query("""
SELECT o_orderkey AS file_id, row_number() OVER (ORDER BY o_orderstatus = 'P', o_orderkey) AS file_rank FROM orders""")
def files_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.order_files(A.files(spark, sf_dir), "sequence").select("file_id", "file_rank")


@query("""
WITH f AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 <> 0)
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN o_orderkey > k AND o_orderkey % 5 <> 0 THEN 'skipped' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status FROM orders, f) GROUP BY status""")
def stop_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.files(spark, sf_dir).withColumn("settled", F.col("file_id") % 5 == 0)
    return O.stop_after_failure(files).groupBy("status").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority AS p, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders)
SELECT o_custkey AS file_id, min(v) AS value, count(*) FILTER (WHERE p <> v) AS n_conflicts FROM f GROUP BY o_custkey""")
def first_value_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "file_id")
    return O.first_value_wins(o, ["file_id"], "o_orderpriority", ["o_orderdate", "o_orderkey"])


@query("""
WITH e AS (SELECT user_id, event_type, min(row(ts, event_id)) AS k FROM events GROUP BY ALL)
SELECT user_id AS file_id, string_agg(event_type, '; ' ORDER BY k) AS channels FROM e GROUP BY user_id""")
def ordered_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.points(spark, sf_dir)
    return points.groupBy("file_id").agg(F.array_join(O.ordered_distinct("channel", ["ts", "event_id"]), "; ").alias("channels"))


# -- tables ----------------------------------------------------------------------------------


@query("""
SELECT o_orderkey AS file_id, o_orderpriority AS vendor, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE coalesce(n, 0) END AS peak_count, '' AS detector_channels
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def samples_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.samples_table(A.files(spark, sf_dir), A.samples(spark, sf_dir), A.peaks(spark, sf_dir))
    return out.select("file_id", "vendor", "status", "peak_count", "detector_channels")


@query(f"""
WITH {PEAKS_SQL}
SELECT sample_id, detector, channel, peak_number, retention_time, area, height, compound, o_orderpriority AS manufacturer, rt2 AS secondary_retention_time,
  CASE WHEN rt2 IS NOT NULL THEN 's' END AS secondary_retention_time_unit, row_number() OVER (PARTITION BY file_id, detector, channel ORDER BY {PLACE_SQL}) AS observation_order
FROM peaks JOIN orders ON file_id = o_orderkey WHERE o_orderstatus <> 'P'""")
def peaks_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.observation_order(A.peaks(spark, sf_dir), PLACE)
    out = P.peaks_table(rows, A.files(spark, sf_dir), A.samples(spark, sf_dir), secondary=True)
    return out.select(
        "sample_id", "detector", "channel", "peak_number", "retention_time", "area", "height", "compound", "manufacturer", "secondary_retention_time", "secondary_retention_time_unit", "observation_order",
    )


_ESCAPED = "regexp_replace({}, '#', '%23', 'g')"
_LONG_SQL = f"""{PEAKS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY file_id, compound, detector, channel ORDER BY {PLACE_SQL}) AS occurrence FROM peaks),
i AS (SELECT compound, detector, channel, row_number() OVER (ORDER BY min(row(file_id, {PLACE_SQL}))) AS ordinal FROM peaks GROUP BY ALL),
long AS (SELECT n.file_id, sample_id, 'q[compound=' || {_ESCAPED.format('n.compound')} || '][detector=' || n.detector || '][channel=' || n.channel || ']_area' ||
    CASE WHEN occurrence > 1 THEN '_' || occurrence ELSE '' END AS column_name, ordinal, occurrence, area
  FROM n JOIN i ON n.compound = i.compound AND n.detector = i.detector AND n.channel = i.channel)"""


@query(f"WITH {_LONG_SQL} SELECT * FROM long")
def compound_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compound_matrix_long(A.peaks(spark, sf_dir), ["file_id", *PLACE])


_WIDE = ["Brand#11", "Brand#23", "Brand#45"]


@query(f"""
WITH {PEAKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id, compound ORDER BY {PLACE_SQL}) AS k FROM peaks)
SELECT o_orderkey AS file_id, 'order_' || o_orderkey AS sample_id, {", ".join(f"max(CASE WHEN compound = '{b}' AND k = 1 THEN area END) AS \"{b}_area\"" for b in _WIDE)}
FROM orders LEFT JOIN n ON o_orderkey = file_id WHERE o_orderstatus <> 'P' GROUP BY o_orderkey""")
def compound_matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    peaks = A.peaks(spark, sf_dir).withColumns({"detector": none, "channel": none})
    return P.compound_matrix_wide(P.compound_matrix_long(peaks, ["file_id", *PLACE]), A.files(spark, sf_dir), [f"{b}_area" for b in _WIDE])


def _matrix_sql(second: bool) -> str:
    fields = ["retention_time", *(["rt2"] if second else []), "area"]
    names = {"rt2": "secondary_retention_time"}
    cells = ", ".join(f"max(CASE WHEN k = {i} THEN {f} END) AS peak_{i}_{names.get(f, f)}" for i in (1, 2, 3) for f in fields)
    return f"""
WITH {PEAKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id, detector, channel ORDER BY {PLACE_SQL}) AS k FROM peaks WHERE rt2 IS {'NOT ' if second else ''}NULL)
SELECT file_id, detector, channel, {cells}, count(*) AS n_peaks FROM n GROUP BY file_id, detector, channel"""


@query(_matrix_sql(False))
def order_matrix_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = P.order_matrix(A.observed(A.peaks(spark, sf_dir)), PLACE).withColumn("n_peaks", F.size("peaks").cast("long"))
    return P.widen_order_matrix(matrix, 3).drop("sample_id", "retention_time_unit", "area_unit")


@query(_matrix_sql(True))
def order_matrix_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = P.order_matrix(A.observed(A.peaks(spark, sf_dir)), PLACE, two_dimensional=True).withColumn("n_peaks", F.size("peaks").cast("long"))
    return P.widen_order_matrix(matrix, 3).drop("sample_id", "retention_time_unit", "area_unit", "secondary_retention_time_unit")


def _matrix_long_sql(second: bool) -> str:
    return f"""
WITH {PEAKS_SQL}
SELECT file_id, detector, channel, row_number() OVER (PARTITION BY file_id, detector, channel ORDER BY {PLACE_SQL}) AS peak, retention_time, {"rt2 AS secondary_retention_time, " if second else ""}area
FROM peaks WHERE rt2 IS {'NOT ' if second else ''}NULL"""


@query(_matrix_long_sql(False))
def order_matrix_1d_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All peaks of each stream; the wide query shows the first three."""
    return P.order_matrix_long(P.order_matrix(A.observed(A.peaks(spark, sf_dir)), PLACE)).drop("sample_id", "retention_time_unit", "area_unit")


@query(_matrix_long_sql(True))
def order_matrix_2d_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = P.order_matrix(A.observed(A.peaks(spark, sf_dir)), PLACE, two_dimensional=True)
    return P.order_matrix_long(matrix).drop("sample_id", "retention_time_unit", "area_unit", "secondary_retention_time_unit")


@query("""
SELECT p_partkey AS ordinal, CAST(floor((p_partkey - 1) / 30) AS BIGINT) + 1 AS segment, CAST(9 + (p_partkey - 1) % 30 AS BIGINT) AS place FROM part""")
def column_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"))
    return P.column_segments(columns, capacity=40, fixed=8, atom=3)


@query("""
WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS k FROM orders), c AS (SELECT CAST(floor((k - 1) / 1000) AS INTEGER) + 1 AS chunk FROM r)
SELECT chunk, CASE WHEN chunk = 1 THEN 'Peaks' ELSE 'Peaks_' || lpad(CAST(chunk AS VARCHAR), CAST(greatest(3, length(CAST(chunk AS VARCHAR))) AS INTEGER), '0') END AS part_name, count(*) AS n FROM c GROUP BY chunk""")
def row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = O.global_rank(A.table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], "rank")
    return P.row_chunks(ranked, "rank", 1000, "Peaks").groupBy("chunk", "part_name").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT user_id, event_type, count(*) AS n_points, min(row(ts, event_id)) AS k FROM events GROUP BY ALL)
SELECT 'user_' || user_id AS detector, event_type AS channel, n_points, row_number() OVER (ORDER BY k) AS series_no, 'user_' || user_id AS label FROM s""")
def signal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.lit(None).cast("string")
    points = A.points(spark, sf_dir).withColumns({"detector": F.concat(F.lit("user_"), "file_id"), "x_unit": unit, "y_unit": unit})
    return P.signal_datasets(points, ["ts", "event_id"]).drop("x_unit", "y_unit")


@query("""
SELECT user_id AS file_id, channel, count(*) AS n FROM (
  SELECT user_id, event_type AS channel, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS b FROM events) WHERE value <= b GROUP BY ALL""")
def step_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = O.step_faults(A.points(spark, sf_dir), ["file_id", "channel"], ["event_id"], "y")
    return faults.groupBy("file_id", "channel").agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT user_id, event_id, event_type = 'error' AS a, CAST(round(value * 100) AS BIGINT) AS word FROM events),
s AS (SELECT *, sum(CASE WHEN a THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM w),
d AS (SELECT *, sum(CASE WHEN a THEN 0 ELSE word END) OVER (PARTITION BY user_id, segment ORDER BY event_id) AS slope FROM s)
SELECT user_id AS file_id, event_id, CAST(segment AS BIGINT) AS segment, CAST(sum(CASE WHEN a THEN word ELSE slope END) OVER (PARTITION BY user_id, segment ORDER BY event_id) AS BIGINT) AS value FROM d""")
def delta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    words = e.select(F.col("user_id").alias("file_id"), "event_id", (F.col("event_type") == "error").alias("is_abs"), F.round(F.col("value") * 100).cast("long").alias("word"))
    return O.decode_deltas(words, ["file_id"], ["event_id"]).select("file_id", "event_id", "segment", "value")


@query("""
WITH b AS (SELECT user_id, event_type, event_id, CAST(date_trunc('day', ts) AS DATE) AS version FROM events)
SELECT user_id AS file_id, event_type, event_id FROM b JOIN (SELECT user_id AS u, event_type AS t, max(version) AS v FROM b GROUP BY ALL) ON user_id = u AND event_type = t AND version = v""")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    blocks = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), "event_type", "event_id", day.alias("version"))
    return O.latest_revision(blocks, ["file_id", "event_type"]).select("file_id", "event_type", "event_id")


@query("""
SELECT p_partkey AS file_id, unnest(['p_name', 'p_brand', 'p_type', 'p_size']) AS key, unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part""")
def metadata_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.operators.cells import unknown_columns

    return unknown_columns(A.table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])


@query("""
SELECT count(*) FILTER (WHERE substr(l_returnflag, 1, 1) IN ('=', '+', '-', '@')) + count(*) FILTER (WHERE substr(l_linestatus, 1, 1) IN ('=', '+', '-', '@')) AS formula_like,
  CAST(0 AS BIGINT) AS non_finite, count(*) FILTER (WHERE abs(l_orderkey) >= 1000000000000000) AS exact_integers FROM lineitem""")
def numeric_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.numeric_safety(A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"))


@query("""
WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS k, sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority) AS h FROM orders)
SELECT CAST(floor((k - 1) / 1000) AS BIGINT) AS block, count(*) AS n_rows, sha256(string_agg(h, '' ORDER BY k)) AS digest FROM r GROUP BY 1""")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    return P.ordered_digest(o, ["o_orderkey"], F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))


@query()
def series_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.operators.series import series_fingerprints

    points = A.points(spark, sf_dir).select("file_id", "channel", F.col("x").cast("double"), "y", "event_id")
    return series_fingerprints(points, ["file_id", "channel"], ["event_id"])


# -- typing ----------------------------------------------------------------------------------

_LEX_SQL = """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, CAST(l_quantity AS BIGINT) AS q, (l_orderkey + l_linenumber) % 7 AS k FROM lineitem)"""


def _lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as lexemes of seven spellings."""
    line = A.table(spark, sf_dir, "lineitem")
    q, k = F.col("l_quantity").cast("long"), (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    text = q.cast("string")
    lexeme = (
        F.when(k == 0, F.concat(text, F.lit(".25"))).when(k == 1, F.concat(F.lit(" "), text, F.lit(" "))).when(k == 2, F.concat(text, F.lit("e1"))).when(k == 3, F.concat(text, F.lit("d")))
        .when(k == 4, F.lit("")).when(k == 5, F.lit("NaN")).otherwise(F.concat(text, F.lit(".12345678901234567890123456789")))
    )
    return line.select(lexeme.alias("lexeme"))


@query(_LEX_SQL + """
SELECT code, value, count(*) AS n FROM (
  SELECT CASE k WHEN 3 THEN 'INVALID_NUMBER' WHEN 5 THEN 'NONFINITE_NUMBER' WHEN 6 THEN 'LOSSY_FLOAT_REJECTED' END AS code,
    CASE k WHEN 0 THEN q + 0.25 WHEN 1 THEN q WHEN 2 THEN q * 10 END::DOUBLE AS value FROM v) GROUP BY ALL""")
def exact_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _lexemes(spark, sf_dir).select(L.exact_float(F.col("lexeme")).alias("r"))
    return read.groupBy(F.col("r.code").alias("code"), F.when(~F.isnan("r.value"), F.col("r.value")).alias("value")).agg(F.count("*").alias("n"))


@query(_LEX_SQL + """
SELECT code, value, count(*) AS n FROM (
  SELECT CASE k WHEN 0 THEN 'INVALID_INTEGER' WHEN 3 THEN 'INVALID_NUMBER' WHEN 5 THEN 'NONFINITE_NUMBER' WHEN 6 THEN 'INVALID_INTEGER' END AS code,
    CASE k WHEN 1 THEN q WHEN 2 THEN q * 10 END AS value FROM v) GROUP BY ALL""")
def exact_integer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _lexemes(spark, sf_dir).select(L.bounded_integer(F.col("lexeme")).alias("r"))
    return read.groupBy(F.col("r.code").alias("code"), F.col("r.value").cast("long").alias("value")).agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT o_orderkey, date_trunc('second', o_orderdate) AS t, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey AS file_id, k IN (0, 1) AS reliable,
  CASE k WHEN 2 THEN 'TIMESTAMP_TIMEZONE_MISSING' WHEN 3 THEN 'INVALID_TIMESTAMP' WHEN 4 THEN 'TIMESTAMP_TIMEZONE_MISSING' WHEN 5 THEN 'INVALID_TIMESTAMP' END AS code,
  CASE k WHEN 0 THEN t WHEN 1 THEN t - INTERVAL 9 HOUR WHEN 2 THEN t WHEN 4 THEN date_trunc('day', t) END AS value FROM o""")
def iso_timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    fmt = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 1, F.concat(fmt("yyyy-MM-dd HH:mm:ss"), F.lit("+09:00"))).when(k == 2, fmt("yyyyMMdd'T'HHmmss"))
        .when(k == 3, fmt("yyyy-MM")).when(k == 4, fmt("yyyy-MM-dd")).otherwise(fmt("dd.MM.yyyy"))
    )
    read = o.select(F.col("o_orderkey").alias("file_id"), L.iso_timestamp(text).alias("r"))
    return read.select("file_id", F.col("r.reliable").alias("reliable"), F.col("r.code").alias("code"), F.col("r.value").alias("value"))


# -- routing and mapping ---------------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id, lang = 'en' AS a, length(text) >= 1000 AS b, contains(text, '|') AS c FROM documents)
SELECT doc_id AS file_id, CASE WHEN c THEN 'piped' WHEN a AND b THEN NULL WHEN a THEN 'english' WHEN b THEN 'long' END AS adapter,
  CASE WHEN c THEN CAST(0.7 AS DOUBLE) WHEN a AND b THEN NULL WHEN a THEN CAST(0.95 AS DOUBLE) WHEN b THEN CAST(0.98 AS DOUBLE) END AS confidence,
  CASE WHEN c THEN NULL WHEN a AND b THEN 'FORMAT_AMBIGUOUS' WHEN NOT a AND NOT b THEN 'FORMAT_NOT_DETECTED' END AS code FROM d""")
def route_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.document_files(spark, sf_dir)
    rules = [
        R.Rule("english", F.col("lang") == "en", F.lit(0.95)), R.Rule("long", F.length("text") >= 1000, F.lit(0.98)),
        R.Rule("piped", F.col("text").contains("|"), R.graded(F.lit(False), F.col("text").contains("|")), private=True),
    ]
    return R.best_routes(files, R.probe_matrix(files, rules))


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lists from the events: user, type, and the sort of value."""
    e = A.table(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    headers = (
        F.when(k == 0, F.array(*map(F.lit, ["Retention Time", "Area", "Height"]))).when(k == 1, F.array(*map(F.lit, ["Area", "Retention Time", "Height"])))
        .when(k == 2, F.array(*map(F.lit, ["Retention Time", "Area", "Height", "Note"]))).when(k == 3, F.array(F.lit("Retention Time"), F.lit("Area"), F.concat(F.lit("Height "), "event_type")))
        .otherwise(F.array(*map(F.lit, ["a", "b"])))
    )
    return e.select(F.col("event_id").alias("file_id"), F.lit("csv").alias("source_format"), headers.alias("headers"))


def _profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("base", "csv", ["Retention Time", "Area", "Height"]), ("wide", "csv", ["Retention Time", "Area", "Height", "Note"]), ("twin", "csv", ["Retention Time", "Area", "Height", "Note"])],
        "profile_id string, source_format string, headers array<string>",
    )


@query("""
SELECT event_id AS file_id, CASE WHEN event_id % 5 = 0 THEN 'base' END AS profile_id, CAST(CASE event_id % 5 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS n_profiles,
  CASE WHEN event_id % 5 = 2 THEN 'AMBIGUOUS_MAPPING_PROFILE' END AS code FROM events""")
def profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profile_matches(_structures(spark, sf_dir), _profiles(spark))


@query("""
SELECT k, categories, differences, lost_required, count(*) AS n FROM (SELECT event_id % 5 AS k,
  CASE event_id % 5 WHEN 0 THEN 'incompatible_structure' WHEN 1 THEN 'column_reordered' WHEN 2 THEN 'column_added'
    WHEN 3 THEN 'header_changed_unresolved,optional_mapping_column_missing' ELSE 'column_removed,header_changed_unresolved,required_mapping_column_missing,optional_mapping_column_missing,incompatible_structure' END AS categories,
  CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 3 END AS differences,
  CASE event_id % 5 WHEN 1 THEN 'retention_time,area' WHEN 4 THEN 'retention_time,area' ELSE '' END AS lost_required FROM events) GROUP BY ALL""")
def drift_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = spark.createDataFrame([("base", 1, "retention_time"), ("base", 2, "area"), ("base", 3, "height")], "profile_id string, position int, role string")
    d = M.drift_diagnostics(_structures(spark, sf_dir), _profiles(spark).where("profile_id = 'base'"), roles)
    return d.groupBy((F.col("file_id") % 5).alias("k"), F.array_join("categories", ",").alias("categories"), "differences", F.array_join("lost_required", ",").alias("lost_required")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id AS file_id, CASE event_id % 5 WHEN 2 THEN 'base' WHEN 4 THEN 'base,twin,wide' WHEN 0 THEN 'twin,wide' ELSE 'base,twin,wide' END AS candidates FROM events""")
def drift_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = M.drift_candidates(M.drift_diagnostics(_structures(spark, sf_dir), _profiles(spark)))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "profile_id"))), lambda x: x["profile_id"]), ",")
    return ranked.groupBy("file_id").agg(listed.alias("candidates"))


# -- validation ------------------------------------------------------------------------------


def _stream_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of peaks whose order column is the (repeating) line number."""
    return A.peaks(spark, sf_dir).withColumn("observation_order", F.col("peak_number"))


@query(f"""
WITH {PEAKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id, detector, channel ORDER BY {PLACE_SQL}) AS k FROM peaks),
s AS (SELECT file_id, detector, channel, bool_and(k = peak_number) AS ok FROM r GROUP BY ALL)
SELECT 'PEAK_OBSERVATION_ORDER_INVALID' AS code, count(*) AS n FROM s WHERE NOT ok""")
def issues_stream_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stream_rules(_stream_peaks(spark, sf_dir), PLACE).groupBy("code").agg(F.count("*").alias("n"))


@query(f"""
WITH {PEAKS_SQL}, v AS (SELECT CASE WHEN file_id % 3 = 0 THEN NULL WHEN rt2 IS NOT NULL THEN 's' END AS unit, rt2, height * 100 AS a, retention_time AS b FROM peaks)
SELECT 'PEAK_SECONDARY_RETENTION_PARTIAL' AS code, count(*) AS n FROM v WHERE (rt2 IS NULL) <> (unit IS NULL) HAVING count(*) > 0
UNION ALL SELECT 'PEAK_TIME_BOUNDARY_INVALID', count(*) FROM v WHERE a > b HAVING count(*) > 0""")
def issues_peak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("file_id") % 3 == 0, F.lit(None)).otherwise(F.col("secondary_retention_time_unit"))
    rows = A.observed(A.peaks(spark, sf_dir)).withColumns({"secondary_retention_time_unit": unit, "start_time": F.col("height") * 100, "end_time": F.col("retention_time") + 1})
    return V.peak_rules(rows).groupBy("code").agg(F.count("*").alias("n"))


_ISSUES_SQL = """i AS (
  SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS issue_no,
    CASE WHEN l_quantity > 45 THEN 'RANGE_' || l_linenumber ELSE 'NOTE_' || l_linenumber END AS code, CASE WHEN l_quantity > 45 THEN 'error' ELSE 'warning' END AS severity
  FROM lineitem WHERE l_quantity > 40)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues made of large quantities: above 45 an error, above 40 a warning."""
    line = A.table(spark, sf_dir, "lineitem").where("l_quantity > 40")
    bad = F.col("l_quantity") > 45
    code = F.concat(F.when(bad, "RANGE_").otherwise("NOTE_"), "l_linenumber")
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    return line.select(F.col("l_orderkey").alias("file_id"), number.alias("issue_no"), code.alias("code"), F.when(bad, "error").otherwise("warning").alias("severity"), code.alias("message"))


@query(f"""
WITH {_ISSUES_SQL}, g AS (
  SELECT file_id, coalesce(string_agg(code, ';' ORDER BY issue_no) FILTER (WHERE severity = 'warning'), '') AS warning_code,
    coalesce(string_agg(code, ';' ORDER BY issue_no) FILTER (WHERE severity = 'error'), '') AS error_code, string_agg(code, ' | ' ORDER BY issue_no) AS message FROM i GROUP BY file_id)
SELECT o_orderkey AS file_id, coalesce(warning_code, '') AS warning_code, coalesce(error_code, '') AS error_code, coalesce(message, '') AS message,
  CASE WHEN coalesce(error_code, '') <> '' THEN 'failed' WHEN message IS NOT NULL THEN 'warning' ELSE 'success' END AS status
FROM orders LEFT JOIN g ON o_orderkey = file_id""")
def import_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.files(spark, sf_dir).select("file_id").withColumn("status", F.lit(None).cast("string"))
    return P.import_log(files, _issues(spark, sf_dir))


@query(f"""
WITH {_ISSUES_SQL}, f AS (SELECT o_orderkey, CASE WHEN bool_or(severity = 'error') THEN 'failed' WHEN count(severity) > 0 THEN 'warning' ELSE 'success' END AS s FROM orders LEFT JOIN i ON o_orderkey = file_id GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (WHERE s <> 'failed') AS success_count, count(*) FILTER (WHERE s = 'warning') AS warning_count, count(*) FILTER (WHERE s = 'failed') AS failure_count,
  CAST(0 AS BIGINT) AS duplicate_count, CAST(0 AS BIGINT) AS skipped_count, 'partial_success' AS outcome FROM f""")
def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.files(spark, sf_dir).select("file_id").withColumn("status", F.lit(None).cast("string"))
    return P.batch_counts(P.import_log(files, _issues(spark, sf_dir)))


@query(f"""WITH {_ISSUES_SQL} SELECT l_orderkey AS file_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT file_id FROM i WHERE severity = 'error') GROUP BY 1""")
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "file_id")
    return P.quarantine(rows, _issues(spark, sf_dir)).groupBy("file_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_ISSUES_SQL}, c AS (SELECT DISTINCT code FROM i WHERE severity = 'warning')
SELECT (SELECT string_agg(code, '; ' ORDER BY code) FROM (SELECT code FROM c ORDER BY code LIMIT 3)) AS shown, CAST(greatest(count(*) - 3, 0) AS INTEGER) AS omitted FROM c""")
def code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.code_summary(_issues(spark, sf_dir), "warning", most=3)


@query("""
WITH s AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(28, 9))) AS computed, count(*) AS n_rows FROM lineitem GROUP BY 1)
SELECT coalesce(l_orderkey, o_orderkey) AS file_id, CAST(computed AS DOUBLE) AS computed, n_rows, o_totalprice AS stated FROM s FULL JOIN orders ON l_orderkey = o_orderkey
WHERE computed IS DISTINCT FROM CAST(o_totalprice AS DECIMAL(28, 9))""")
def totals_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "file_id")
    totals = A.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "file_id")
    out = V.section_totals(rows, totals, ["file_id"], "l_extendedprice", "o_totalprice")
    return out.select("file_id", F.col("computed").cast("double").alias("computed"), "n_rows", F.col("stated").cast("double").alias("stated"))


@query("""
SELECT key, value FROM (SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders)
UNPIVOT (value FOR key IN (orders, customers, failed))""".replace("SELECT key, value FROM (", "SELECT key, CAST(value AS VARCHAR) AS value FROM ("))
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    return P.manifest(o.agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "P").alias("failed")))


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE h END AS h FROM a WHERE doc_id % 13 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS file_id, CASE WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a LEFT JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def plan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.plans.planning import plan_changes

    entries = A.document_files(spark, sf_dir).select("file_id", "sha256")
    later = entries.where("file_id % 13 <> 0").withColumn("sha256", F.when(F.col("file_id") % 10 == 0, "x").otherwise(F.col("sha256")))
    return plan_changes(entries, later).select("file_id", "change")


@query("""
SELECT count(*) AS total_inputs, count(*) FILTER (WHERE a AND NOT z) AS routable, count(*) FILTER (WHERE a AND NOT z) AS exact_adapters, CAST(0 AS BIGINT) AS user_mappings, CAST(0 AS BIGINT) AS mapping_profiles, CAST(0 AS BIGINT) AS generic_inputs,
  CAST(0 AS BIGINT) AS drifted, CAST(0 AS BIGINT) AS unmapped, count(*) FILTER (WHERE z) AS ambiguous, count(*) FILTER (WHERE NOT a) AS unsupported, CAST(0 AS BIGINT) AS malformed, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS excluded_artifacts,
  count(*) FILTER (WHERE NOT a OR z) AS failed, CAST(sum(n) AS BIGINT) AS total_bytes,
  CASE WHEN count(*) FILTER (WHERE a AND NOT z) = 0 THEN 'BLOCKED' WHEN count(*) FILTER (WHERE NOT a OR z) > 0 THEN 'READY_WITH_KNOWN_FAILURES' ELSE 'READY' END AS readiness
FROM (SELECT length(text) >= 400 AS a, length(text) >= 2000 AS z, strlen(text) AS n FROM documents)""")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.plans.planning import plan_entries, summarise_plan

    files = A.document_files(spark, sf_dir).withColumns({"duplicate_of": F.lit(None).cast("long"), "excluded": F.lit(False)})
    probes = R.probe_matrix(files, [R.Rule("text", F.length("text") >= 400, F.lit(0.98)), R.Rule("long", F.length("text") >= 2000, F.lit(0.95))])
    return summarise_plan(plan_entries(files, R.best_routes(files, probes)))
