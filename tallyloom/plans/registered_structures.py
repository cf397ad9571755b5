"""Registered queries over digest trees, fingerprints, sheets, wide integers and files written by the query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import lexemes as L
from tallyloom.functions.shared import cut, shared_folder
from tallyloom.operators import fingerprints as FP
from tallyloom.operators import mapping as M
from tallyloom.operators import merkle
from tallyloom.operators import series as S
from tallyloom.operators import sheets as H
from tallyloom.operators import tables as P
from tallyloom.plans import analogue as A
from tallyloom.plans.registered import query
from tallyloom.sources import delimited, scan

# -- files -----------------------------------------------------------------------------------


def _written(spark: SparkSession, rows: DataFrame) -> str:
    """A folder of delimited files with the rows, in the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


@query("""
SELECT col_no, header, count(*) AS n, count(DISTINCT v) AS n_distinct, min(v) AS least, max(v) AS greatest FROM (
  SELECT unnest([1, 2, 3]) AS col_no, unnest(['key', 'note', 'lines']) AS header,
    unnest([CAST(c_custkey AS VARCHAR), c_name || ', "' || CAST(c_nationkey AS VARCHAR) || '"', c_mktsegment || chr(10) || CAST(c_custkey % 3 AS VARCHAR)]) AS v FROM customer) GROUP BY ALL""")
def delimited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as delimited files with quotes, delimiters and line feeds in their cells, listed and read again."""
    c = A.table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    rows = c.select(
        key.alias("key"), F.concat("c_name", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')).alias("note"),
        F.concat("c_mktsegment", F.lit("\n"), (F.col("c_custkey") % 3).cast("string")).alias("lines"),
    )
    folder = _written(spark, rows)
    cells = delimited.stream_cells(scan.discover(spark, [folder], extensions=["csv"]))
    heads = cells.where("row_no = 0").select("col_no", F.col("lexeme").alias("header")).distinct()
    body = cells.where("row_no > 0").groupBy("col_no").agg(F.count("*").alias("n"), F.count_distinct("lexeme").alias("n_distinct"), F.min("lexeme").alias("least"), F.max("lexeme").alias("greatest"))
    return body.join(heads, "col_no").select("col_no", "header", "n", "n_distinct", "least", "greatest")


# -- digest trees ----------------------------------------------------------------------------

_LINE_SQL = "source || '/doc_' || doc_id || '.' || lang"


def _tree_sql(rows: str, range_rows: int) -> str:
    """A tree's nodes over ``rows (key, d)``, up to four levels below the root."""
    levels = "\n".join(
        f"n{n} AS (SELECT substr(range, 1, {n}) AS range, sum(n_rows) AS n_rows, sha256(string_agg(digest, '' ORDER BY range)) AS digest FROM n{n + 1} GROUP BY 1 UNION ALL SELECT range, n_rows, digest FROM leaf WHERE depth = {n}),"
        for n in (3, 2, 1, 0)
    )
    return f"""
WITH e AS ({rows}), c AS (SELECT count(*) AS n FROM e),
d AS (SELECT CASE WHEN n <= {range_rows} THEN 0 WHEN n <= {range_rows * 16} THEN 1 WHEN n <= {range_rows * 256} THEN 2 WHEN n <= {range_rows * 4096} THEN 3 ELSE 4 END AS depth FROM c),
leaf AS (SELECT substr(sha256(key), 1, depth) AS range, count(*) AS n_rows, sha256(string_agg(d, '' ORDER BY d)) AS digest, depth FROM e, d GROUP BY 1, depth),
n4 AS (SELECT range, n_rows, digest FROM leaf WHERE depth = 4),
{levels}
t AS (SELECT 0 AS level, * FROM n0 UNION ALL SELECT 1, * FROM n1 UNION ALL SELECT 2, * FROM n2 UNION ALL SELECT 3, * FROM n3 UNION ALL SELECT 4, * FROM n4)"""


@query(_tree_sql(f"SELECT {_LINE_SQL} AS key, sha256({_LINE_SQL} || chr(9) || strlen(text) || chr(9) || sha256(text)) AS d FROM documents", 64) + """
SELECT level, range, CAST(n_rows AS BIGINT) AS n_rows, digest FROM t""")
def digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_files(spark, sf_dir)
    line = F.concat_ws("\t", "relative_path", F.col("size").cast("string"), "sha256")
    return merkle.tree(d, F.col("relative_path"), F.sha2(line, 256), range_rows=64)


@query(_tree_sql(f"SELECT {_LINE_SQL} AS key, sha256({_LINE_SQL} || chr(9) || strlen(text) || chr(9) || sha256(text)) AS d FROM documents", 2048) + """
SELECT digest, CAST(n_rows AS BIGINT) AS n_files FROM t WHERE level = 0""")
def file_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.file_set_digest(A.document_files(spark, sf_dir))


@query("""
SELECT doc_id AS file_id, CASE WHEN doc_id % 97 = 3 THEN 'removed' WHEN doc_id % 89 = 5 THEN 'added' ELSE 'changed' END AS change FROM documents
WHERE (doc_id % 97 = 3) <> (doc_id % 89 = 5) OR (doc_id % 101 = 7 AND doc_id % 97 <> 3 AND doc_id % 89 <> 5)""")
def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that were removed, added or changed; only the ranges that hold some are compared."""
    d, key = cut(A.document_files(spark, sf_dir).select("file_id", "relative_path", "sha256")), F.col("file_id")  # texts are hashed once
    reviewed = d.where(key % 89 != 5)
    rebuilt = d.where(key % 97 != 3).withColumn("sha256", F.when(key % 101 == 7, F.lit("other")).otherwise(F.col("sha256")))
    return merkle.changes(reviewed, rebuilt, "file_id", ["relative_path", "sha256"], range_rows=16).select("file_id", "change")


_UP = "SELECT channel, i // 16 AS i, sum(n) AS n, CASE WHEN count(*) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {} GROUP BY channel, i // 16"


@query(f"""
WITH p AS (SELECT event_type AS channel, epoch_us(ts) || '|' || event_id AS t, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 100 AS i, ts, event_id FROM events),
r AS (SELECT channel, i, count(*) AS n, sha256(string_agg(t, chr(10) ORDER BY ts, event_id)) AS d FROM p GROUP BY channel, i),
a AS ({_UP.format('r')}), b AS ({_UP.format('a')}), c AS ({_UP.format('b')}), d AS ({_UP.format('c')})
SELECT channel, CAST(n AS BIGINT) AS n_points, d AS digest FROM d""")
def series_tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.points(spark, sf_dir)
    text = F.concat(F.col("x").cast("string"), F.lit("|"), F.col("event_id").cast("string"))
    return S.series_tree_digests(points, ["channel"], ["ts", "event_id"], text, run=100, fan=16)


# -- fingerprints ----------------------------------------------------------------------------

_FORMATS_SQL = "CASE p_partkey % 3 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'csv' ELSE 'tsv' END"


def _profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A profile for each part: three columns, the last one's label of other scripts, and units that some lack."""
    key = F.col("p_partkey")
    p = A.table(spark, sf_dir, "part").select(
        key.alias("profile_id"), F.when(key % 3 == 0, "xlsx").when(key % 3 == 1, "csv").otherwise("tsv").alias("source_format"), F.when(key % 6 == 0, F.col("p_type")).alias("worksheet_title"),
        F.lit("min").alias("retention_time_unit"), F.when(key % 2 == 0, "mV").alias("area_unit"), F.lit(None).cast("string").alias("height_unit"), F.lit(None).cast("string").alias("secondary_retention_time_unit"), "p_name", "p_brand",
    )
    rows = F.array(
        F.struct(F.lit(1).alias("position"), F.lit("Retention Time").alias("label"), F.lit("retention_time").alias("role")),
        F.struct(F.lit(2).alias("position"), F.concat("p_brand", F.lit(' "x"')).alias("label"), F.lit("area").alias("role")),
        F.struct(F.lit(3).alias("position"), F.concat(F.lit("높이 \U0001f9ea "), "p_name").alias("label"), F.lit("IGNORED").alias("role")),
    )
    return p.drop("p_name", "p_brand"), p.select("profile_id", F.inline(rows))


_LABELS_SQL = """'"Retention Time"' AS l1, '"' || p_brand || ' \\"x\\""' AS l2, '"\\ub192\\uc774 \\ud83e\\uddea ' || p_name || '"' AS l3"""


@query(f"""
WITH p AS (SELECT p_partkey AS id, {_FORMATS_SQL} AS f, CASE WHEN p_partkey % 6 = 0 THEN '"' || p_type || '"' ELSE 'null' END AS w, CASE WHEN p_partkey % 2 = 0 THEN '"mV"' ELSE 'null' END AS u, {_LABELS_SQL} FROM part)
SELECT id AS profile_id, sha256('{{"headers":[' || l1 || ',' || l2 || ',' || l3 || '],"source_format":"' || f || '","worksheet_title":' || w || '}}') AS exact_structure,
  sha256('{{"column_count":3,"fingerprint_schema_version":1,"mapping_schema_version":1,"ordered_roles":["retention_time","area","IGNORED"],"source_format":"' || f || '","unit_presence":{{"area":' ||
    CASE WHEN u = 'null' THEN 'false' ELSE 'true' END || ',"height":false,"retention_time":true,"secondary_retention_time":false}},"worksheet_policy":"' ||
    CASE WHEN f <> 'xlsx' THEN 'NOT_APPLICABLE' WHEN w <> 'null' THEN 'EXACT_TITLE' ELSE 'SINGLE_VISIBLE' END || '"}}') AS public_structure,
  sha256('{{"columns":[{{"label":' || l1 || ',"position":1,"role":"retention_time"}},{{"label":' || l2 || ',"position":2,"role":"area"}},{{"label":' || l3 || ',"position":3,"role":"IGNORED"}}],"source_format":"' || f ||
    '","units":{{"area_unit":' || u || ',"height_unit":null,"retention_time_unit":"min","secondary_retention_time_unit":null}},"worksheet_title":' || w || '}}') AS semantic FROM p""")
def profile_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FP.profile_fingerprints(*_profiles(spark, sf_dir))


@query(f"""
WITH p AS (SELECT p_partkey AS id, p_partkey % 40 AS s, {_FORMATS_SQL} AS f, p_partkey % 6 = 0 AS w, p_partkey % 2 = 0 AS u FROM part),
d AS (SELECT id, s, sha256('{{"column_count":3,"fingerprint_schema_version":1,"mapping_schema_version":1,"ordered_roles":["retention_time","area","IGNORED"],"source_format":"' || f || '","unit_presence":{{"area":' ||
  CASE WHEN u THEN 'true' ELSE 'false' END || ',"height":false,"retention_time":true,"secondary_retention_time":false}},"worksheet_policy":"' || CASE WHEN f <> 'xlsx' THEN 'NOT_APPLICABLE' WHEN w THEN 'EXACT_TITLE' ELSE 'SINGLE_VISIBLE' END || '"}}') AS d FROM p)
SELECT s AS set_id, CAST(count(*) AS INTEGER) AS n_profiles, sha256('{{"fingerprint_schema_version":1,"mapping_set_schema_version":1,"profiles":["' || string_agg(d, '","' ORDER BY id) || '"]}}') AS fingerprint FROM d GROUP BY s""")
def profile_set_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles, columns = _profiles(spark, sf_dir)
    members = profiles.select((F.col("profile_id") % 40).alias("set_id"), F.col("profile_id").alias("position"), "profile_id")
    return FP.set_fingerprint(members, FP.profile_fingerprints(profiles, columns))


# -- sheets ----------------------------------------------------------------------------------


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as the sheets of a workbook: of five header lists, hidden ones among them."""
    o, k = A.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 7
    headers = (
        F.when(k == 0, F.array(*map(F.lit, ["Retention Time", "Area", ""]))).when(k == 1, F.array(*map(F.lit, ["RT", "Area", "area"])))
        .otherwise(F.array(F.lit("note"), F.col("o_orderpriority")))
    )
    sheets = o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("sheet_no"), F.concat(F.lit("Sheet "), (F.col("o_orderkey") % 5).cast("string")).alias("title"), (F.col("o_orderstatus") != "P").alias("visible"), headers.alias("headers"))
    names = F.transform(H.trimmed_headers(F.col("headers")), lambda h: F.lower(h))
    fault = F.when(F.size(F.array_distinct(names)) < F.size(names), "DUPLICATE_HEADER")
    return H.judged_sheets(sheets, F.array_contains(names, "area"), fault)


_SHEETS_SQL = """s AS (SELECT o_custkey AS file_id, o_orderkey AS sheet_no, 'Sheet ' || (o_orderkey % 5) AS title, o_orderstatus <> 'P' AS visible, o_orderkey % 7 = 0 AS fit, o_orderkey % 7 = 1 AS bad FROM orders)"""


@query(f"""
WITH {_SHEETS_SQL}, g AS (SELECT file_id, count(*) FILTER (WHERE visible AND fit) AS n, count(*) FILTER (WHERE visible AND bad) AS b, min(sheet_no) FILTER (WHERE visible AND fit) AS k FROM s GROUP BY 1)
SELECT g.file_id, CASE WHEN n = 1 THEN k END AS sheet_no, CASE WHEN n = 1 THEN 'Sheet ' || (k % 5) END AS title, n AS n_compatible,
  CASE WHEN n > 1 THEN 'XLSX_SHEET_AMBIGUOUS' WHEN n = 0 THEN CASE WHEN b = 1 THEN 'DUPLICATE_HEADER' WHEN b > 1 THEN 'XLSX_SHEET_AMBIGUOUS' ELSE 'XLSX_NO_COMPATIBLE_SHEET' END END AS code FROM g""")
def elected_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.elect_sheets(_sheets(spark, sf_dir))


@query(f"""
WITH {_SHEETS_SQL}, g AS (SELECT file_id, count(*) FILTER (WHERE title = 'Sheet 2') AS t, count(*) FILTER (WHERE title = 'Sheet 2' AND fit) AS n, count(*) FILTER (WHERE title = 'Sheet 2' AND bad) AS b FROM s GROUP BY 1)
SELECT CASE WHEN t = 0 THEN 'XLSX_SHEET_NOT_FOUND' WHEN n > 1 THEN 'XLSX_SHEET_AMBIGUOUS' WHEN n = 0 THEN CASE WHEN b = 1 THEN 'DUPLICATE_HEADER' WHEN b > 1 THEN 'XLSX_SHEET_AMBIGUOUS' ELSE 'XLSX_SHEET_SCHEMA_UNRECOGNIZED' END END AS code, count(*) AS n
FROM g GROUP BY 1""")
def named_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.elect_sheets(_sheets(spark, sf_dir), named="Sheet 2").groupBy("code").agg(F.count("*").alias("n"))


@query(f"""
WITH {_SHEETS_SQL}, g AS (SELECT file_id, min(sheet_no) AS k FROM s WHERE visible AND fit GROUP BY 1 HAVING count(*) = 1)
SELECT file_id, CASE WHEN k % 5 = 1 THEN 0 ELSE 1 END AS differences, CASE WHEN k % 5 = 1 THEN 'incompatible_structure' ELSE 'worksheet_identity_changed_unresolved' END AS categories FROM g""")
def worksheet_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elected sheets against a profile of the same columns on the sheet named Sheet 1."""
    sheets = _sheets(spark, sf_dir)
    structures = H.sheet_structures(sheets, H.elect_sheets(sheets))
    profile = spark.createDataFrame([("p", "xlsx", ["Retention Time", "Area"], "Sheet 1")], "profile_id string, source_format string, headers array<string>, worksheet_title string")
    return M.drift_diagnostics(structures, profile).select("file_id", "differences", F.array_join("categories", ",").alias("categories"))


# -- wide integers ---------------------------------------------------------------------------


@query("""
WITH w AS (SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS up, ltrim(CASE o_orderkey % 4 WHEN 2 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) || repeat('7', CAST(30 + o_orderkey % 50 AS INTEGER)) END ||
  CASE o_orderkey % 4 WHEN 3 THEN repeat('0', 60) ELSE '' END, '0') AS digits FROM orders)
SELECT id AS file_id, CASE WHEN up THEN '' ELSE '-' END || digits AS whole, length(digits) <= 38 AS fits,
  row_number() OVER (ORDER BY up, CASE WHEN up THEN length(digits) ELSE -length(digits) END, CASE WHEN up THEN digits ELSE translate(digits, '0123456789', '9876543210') END, id) AS place FROM w""")
def wide_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of up to 140 digits, some written with a power of ten, put in order."""
    from tallyloom.operators.order import global_rank

    k = F.col("o_orderkey") % 4
    key = F.col("o_orderkey").cast("string")
    long = F.concat(key, F.repeat(F.lit("7"), (30 + F.col("o_orderkey") % 50).cast("int")))
    lexeme = F.when(k == 0, F.concat(F.lit(" +"), long, F.lit(".0 "))).when(k == 1, F.concat(F.lit("-"), long)).when(k == 2, F.concat(F.lit("-00"), key)).otherwise(F.concat(F.lit("-"), long, F.lit("e60")))
    read = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), L.whole_integer(lexeme).alias("r"))
    rows = read.select("file_id", "r.whole", "r.key", F.col("r.value").isNotNull().alias("fits"))
    return global_rank(rows, [F.col("key"), F.col("file_id")], "place").drop("key")
