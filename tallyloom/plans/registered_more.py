"""Further registered queries: scalar rules, cells, mapping, reconciliation, privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import text as T
from tallyloom.operators import cells as C
from tallyloom.operators import mapping as M
from tallyloom.operators import order as O
from tallyloom.operators import routing as R
from tallyloom.operators import series as S
from tallyloom.operators import tables as P
from tallyloom.operators import validate as V
from tallyloom.plans import analogue as A
from tallyloom.plans.registered import query
from tallyloom.sources import results, scan


@query(r"""
WITH t AS (
  SELECT page_id, page_id % 10 AS k, CASE page_id % 10 WHEN 1 THEN 'C:\data\' || page_id WHEN 2 THEN 'from \\host' || page_id || '\share' WHEN 3 THEN 'see "/srv/' || page_id || '"'
    WHEN 4 THEN 'file:' || page_id WHEN 5 THEN 's3://bucket/' || page_id WHEN 6 THEN 'runs/' || page_id || '.csv' WHEN 7 THEN '\' || page_id
    WHEN 8 THEN url || ' and /' || page_id WHEN 9 THEN 'ratio 1/' || page_id ELSE url END AS u FROM pages)
SELECT page_id AS file_id, k NOT IN (0, 6, 9) OR (k = 0 AND contains(u, '://') AND NOT regexp_matches(u, '^https?://')) AS local_path, contains(u, ':') AS uri,
  CASE WHEN k NOT IN (0, 6, 9) OR (k = 0 AND contains(u, '://') AND NOT regexp_matches(u, '^https?://')) THEN '[absolute-path-omitted]' ELSE u END AS shown FROM t""")
def url_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses, and one in ten of each kind of path made from the page's number."""
    n, k, cat = F.col("page_id").cast("string"), F.col("page_id") % 10, lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    made = [cat("C:\\data\\", n), cat("from \\\\host", n, "\\share"), cat('see "/srv/', n, '"'), cat("file:", n), cat("s3://bucket/", n), cat("runs/", n, ".csv"), cat("\\", n), cat(F.col("url"), " and /", n), cat("ratio 1/", n)]
    u = F.coalesce(*[F.when(k == i, m) for i, m in enumerate(made, 1)], F.col("url"))
    texts = A.table(spark, sf_dir, "pages").select("page_id", u.alias("u"))
    u = F.col("u")
    return texts.select(F.col("page_id").alias("file_id"), T.has_local_path(u).alias("local_path"), T.has_uri_reference(u).alias("uri"), T.scrub_local_path(u).alias("shown"))


@query("""
SELECT c_custkey AS file_id, CASE WHEN c_custkey % 4 = 0 THEN '''=' || c_name WHEN c_custkey % 4 = 1 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) WHEN c_custkey % 4 = 2 THEN '''@' || c_name ELSE c_name END AS safe FROM customer""")
def formula_safe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("="), "c_name")).when(k == 1, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).when(k == 2, F.concat(F.lit("@"), "c_name")).otherwise(F.col("c_name"))
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), T.formula_safe(raw).alias("safe"))


@query("""
SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN 'source-' || sha256(text) ELSE source || '/doc_' || doc_id || '.' || lang END AS reference,
  'RUN_' || substr(sha256(text), 1, 16) AS name FROM documents""")
def public_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_files(spark, sf_dir)
    return d.select("file_id", T.public_reference(F.col("relative_path"), F.col("file_id") % 3 == 0, F.col("sha256"), F.col("input_order")).alias("reference"), T.hash_name("RUN", F.col("sha256")).alias("name"))


@query("""
SELECT doc_id AS file_id, NOT regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F]|_[xX][0-9A-Fa-f]{4}_') AS exact, length(text) <= 32767 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F]|_[xX][0-9A-Fa-f]{4}_') AS cell_exact FROM documents""")
def cell_exactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), T.text_is_exact(F.col("text")).alias("exact"), T.cell_text_is_exact(F.col("text")).alias("cell_exact"))


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells and headers of one small table for each order: its lines, with an unknown column and,
    on every fourth order, a cell beyond the header."""
    line = A.table(spark, sf_dir, "lineitem")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = line.withColumn("row_no", F.row_number().over(place))
    q = F.col("l_quantity").cast("long").cast("string")
    values = {1: q, 2: F.when(F.col("l_linenumber") == 7, F.concat(q, F.lit(" "))).otherwise(q), 3: F.col("l_returnflag"), 4: F.col("l_linestatus"), 5: F.when((F.col("l_orderkey") % 4 == 0) & (F.col("row_no") == 1), "extra").otherwise("")}
    pairs = F.array(*[F.struct(F.lit(c).alias("col_no"), v.alias("lexeme")) for c, v in values.items()])
    cells = rows.select(F.col("l_orderkey").alias("file_id"), "row_no", F.inline(pairs))
    names = F.array(*[F.struct(F.lit(c).alias("col_no"), F.lit(n).alias("header")) for c, n in enumerate(("RT", "Area ", "detector", "Batch Note"), 1)])
    headers = rows.select(F.col("l_orderkey").alias("file_id")).distinct().select("file_id", F.inline(names))
    return cells, headers


_CELL_SQL = """
WITH r AS (SELECT *, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k FROM lineitem)"""


@query(_CELL_SQL + " SELECT l_orderkey AS file_id, CAST(k AS INTEGER) AS row_no, CAST(q AS DOUBLE) AS retention_time, CAST(q AS DOUBLE) AS area, l_returnflag AS detector FROM r")
def peak_rows_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, headers = _cells(spark, sf_dir)
    values = C.value_columns(C.typed_rows(C.wide_rows(cells, headers)))
    return C.peak_rows(values).select("file_id", "row_no", "retention_time", "area", "detector")


@query(_CELL_SQL + " SELECT 'PARSE_LEXEME_WHITESPACE_TRIMMED' AS code, 'area' AS field, count(*) AS n FROM r WHERE l_linenumber = 7 HAVING count(*) > 0")
def value_issues_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, headers = _cells(spark, sf_dir)
    return C.value_issues(C.typed_rows(C.wide_rows(cells, headers))).groupBy("code", "field").agg(F.count("*").alias("n"))


@query(_CELL_SQL + """
SELECT key, value, count(*) AS n FROM (SELECT 'Batch Note' AS key, l_linestatus AS value FROM r UNION ALL SELECT 'unmapped_column_5', 'extra' FROM r WHERE l_orderkey % 4 = 0 AND k = 1) GROUP BY ALL""")
def unmapped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unmapped_cells(*_cells(spark, sf_dir)).groupBy("key", "value").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT l_orderkey AS file_id, l_orderkey % 5 <> 0 AS compatible FROM lineitem""")
def compatible_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = _cells(spark, sf_dir)[1]
    twice = headers.withColumn("header", F.when((F.col("file_id") % 5 == 0) & (F.col("col_no") == 4), "response").when((F.col("file_id") % 5 == 0) & (F.col("col_no") == 3), "Signal").otherwise(F.col("header")))
    return C.compatible_files(twice)


@query("""SELECT l_orderkey AS file_id, count(*) AS n_rows, count(*) AS n_rt, count(*) AS n_area, count(*) FILTER (WHERE l_discount > 0.05) AS n_height, count(DISTINCT l_returnflag || l_linestatus) AS n_signals FROM lineitem GROUP BY 1""")
def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = A.table(spark, sf_dir, "lineitem")
    return C.column_counts(line.select(
        F.col("l_orderkey").alias("file_id"), F.col("l_quantity").cast("string").alias("retention_time"), F.col("l_tax").cast("string").alias("area"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount").cast("string")).otherwise(" ").alias("height"), F.col("l_returnflag").alias("detector"), F.col("l_linestatus").alias("channel"),
    ))


@query("""
WITH b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 6 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM b))
SELECT l_orderkey AS file_id, l_returnflag AS detector, l_quantity AS retention_time, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS area, CAST(k AS INTEGER) AS observation_order FROM r""")
def mapped_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = _cells(spark, sf_dir)
    bad = (F.col("file_id") % 6 == 0) & (F.col("col_no") == 2)
    cells = cells.where("col_no < 5").withColumn("lexeme", F.when(bad, "1e999").otherwise(F.trim("lexeme"))).withColumn("profile_id", F.lit("p"))
    columns = spark.createDataFrame([("p", 1, "retention_time"), ("p", 2, "area"), ("p", 3, "detector"), ("p", 4, "IGNORED")], "profile_id string, position int, role string")
    units = spark.createDataFrame([("p", "min", None)], "profile_id string, retention_time_unit string, area_unit string")
    return M.mapped_peaks(cells, columns, units)[0].select("file_id", "detector", "retention_time", "area", "observation_order")


@query("""SELECT o_custkey AS file_id, 'o_orderpriority' AS field FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1 UNION ALL SELECT o_custkey, 'o_orderstatus' FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1""")
def inconsistent_file_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.inconsistent_file_fields(A.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "file_id"), ["o_orderpriority", "o_orderstatus"])


@query("""
WITH s AS (SELECT l_orderkey, count(*) AS found FROM lineitem GROUP BY 1)
SELECT o_orderkey AS file_id, CAST(4 AS BIGINT) AS n, coalesce(found, 0) AS found FROM orders LEFT JOIN s ON o_orderkey = l_orderkey WHERE coalesce(found, 0) <> 4""")
def declared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "file_id")
    declared = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit(4).cast("long").alias("n"))
    return V.declared_counts(rows, declared, ["file_id"])


@query("""
WITH s AS (SELECT user_id, event_type, min(value) AS a, max(value) AS b FROM events GROUP BY ALL)
SELECT e.user_id AS file_id, e.event_id FROM events e JOIN s ON e.user_id = s.user_id AND e.event_type = s.event_type WHERE e.value * 1.5 NOT BETWEEN a AND b""")
def outside_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.points(spark, sf_dir)
    return V.outside_range(points.withColumn("at", F.col("y") * 1.5), points, ["file_id", "channel"], "at", "y").select("file_id", "event_id")


@query("""
WITH a AS (SELECT l_orderkey AS f, l_linenumber AS p, min(l_quantity) AS q FROM lineitem GROUP BY ALL), b AS (SELECT f, p, CASE WHEN f % 9 = 0 THEN q + 1 ELSE q END AS q FROM a WHERE p < 7)
SELECT coalesce(a.f, b.f) AS file_id, CAST(coalesce(a.p, b.p) AS INTEGER) AS pos FROM a FULL JOIN b ON a.f = b.f AND a.p = b.p WHERE a.q IS DISTINCT FROM b.q""")
def paired_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_quantity").alias("q"))
    b = a.where("pos < 7").withColumn("q", F.when(F.col("file_id") % 9 == 0, F.col("q") + 1).otherwise(F.col("q")))
    return V.paired_mismatches(a, b, ["file_id", "pos"], ["q"]).select("file_id", "pos")


@query("""
SELECT user_id AS scan, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, min(CAST(round(value * 100) AS BIGINT)) AS least, max(CAST(round(value * 100) AS BIGINT)) AS greatest,
  min(event_id) AS mass_from, max(event_id) AS mass_to, count(*) AS n_points FROM events GROUP BY 1""")
def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return S.scan_statistics(e.select(F.col("user_id").alias("scan"), F.col("event_id").alias("mass_raw"), F.round(F.col("value") * 100).cast("long").alias("intensity")), ["scan"])


@query("""SELECT source AS file_id FROM documents GROUP BY source, lang HAVING count(DISTINCT sha256(text)) > 1""".replace("SELECT source AS file_id", "SELECT source AS file_id, lang AS channel"))
def differing_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    return S.duplicate_payloads(d.select(F.col("source").alias("file_id"), F.col("lang").alias("channel"), "text"), ["file_id", "channel"], "text")


@query("""
WITH a AS (SELECT doc_id, strlen(text) AS s, sha256(text) AS h FROM documents)
SELECT doc_id AS file_id, 'INPUT_CHANGED_DURING_PARSE' AS code FROM a WHERE doc_id % 11 = 0""")
def changed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = A.document_files(spark, sf_dir).select("file_id", F.col("relative_path").alias("path"), "size", "sha256")
    after = before.withColumn("sha256", F.when(F.col("file_id") % 11 == 0, "other").otherwise(F.col("sha256")))
    return V.changed_inputs(before, after).select("file_id", "code")


@query("""
SELECT doc_id AS file_id, CASE WHEN strlen(text) > 20000 THEN 'INPUT_TOO_LARGE' ELSE 'INPUT_LARGE' END AS code, CASE WHEN strlen(text) > 20000 THEN 'error' ELSE 'warning' END AS severity FROM documents WHERE strlen(text) >= 2500""")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The same guard over small texts: their sizes are scaled up to the limits' range.
    d = A.document_files(spark, sf_dir).withColumn("size", F.when(F.col("size") > 20_000, F.lit(scan.MOST_BYTES + 1)).when(F.col("size") >= 2_500, F.lit(scan.WARN_BYTES)).otherwise(F.col("size")))
    return scan.size_issues(d)


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)
SELECT doc_id AS file_id, CAST(n AS INTEGER) AS line_no, count(*) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM (SELECT * FROM l WHERE length(line) < 40)""")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("content"))
    lines = results.text_lines(d).where(F.length("line") < 40)
    numbered = lines.withColumn("mark", F.row_number().over(Window.partitionBy("file_id").orderBy("line_no")).cast("long"))
    return O.carry_section(numbered, F.col("mark"), ["file_id"], ["line_no"]).select("file_id", "line_no", "section")


@query("""
WITH f AS (SELECT doc_id, source, lang FROM documents), s AS (SELECT source, bool_or(lang = 'fr') AS owned FROM f WHERE doc_id % 50 = 0 GROUP BY 1)
SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 0 THEN lang = 'de' ELSE coalesce(owned, false) END AS private FROM f LEFT JOIN s ON f.source = s.source""")
def private_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_files(spark, sf_dir).withColumn("extension", F.col("source"))
    rules = d.where("file_id % 50 = 0").select(F.col("source").alias("suffix"), (F.col("lang") == "fr").alias("private"))
    routes = d.where("file_id % 2 = 0").select("file_id", (F.col("lang") == "de").alias("private"))
    return R.private_files(d, rules, routes)


@query("""
SELECT 'p_name' AS "column", CAST(max(length(p_name)) AS INTEGER) AS longest, false AS to_csv FROM part UNION ALL SELECT 'p_brand', max(length(p_brand)), false FROM part""")
def overlong_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.overlong_columns(A.table(spark, sf_dir, "part").select("p_name", "p_brand"))


@query("""
WITH t AS (SELECT l_orderkey AS file_id, l_linenumber % 3 AS label, l_linenumber AS position, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k FROM lineitem)
SELECT label, k, count(*) AS n FROM t GROUP BY ALL""")
def header_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = A.table(spark, sf_dir, "lineitem")
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    headers = line.select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") % 3).alias("label"), place.alias("position"))
    return O.header_tokens(headers, ["file_id"]).groupBy("label", "k").agg(F.count("*").alias("n"))
