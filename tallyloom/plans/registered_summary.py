"""Registered queries over summaries, candidate formats and plan problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import summary as M
from tallyloom.plans import analogue as A
from tallyloom.plans.registered import query

_STATUS_SQL = """CASE WHEN o_orderkey % 50 = 0 THEN 'duplicate' WHEN o_orderkey % 51 = 0 THEN 'skipped' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'warning' ELSE 'success' END"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = A.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(key % 50 == 0, "duplicate").when(key % 51 == 0, "skipped").when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderstatus") == "O", "warning").otherwise("success")
    return o.select(key.alias("file_id"), status.alias("status"))


@query(f"""
WITH f AS (SELECT o_orderkey AS id, {_STATUS_SQL} AS s FROM orders), c AS (SELECT id FROM f WHERE s IN ('success', 'warning')),
z AS (SELECT DISTINCT l_orderkey AS id, l_returnflag, l_linestatus FROM lineitem)
SELECT count(*) AS total_sources, count(*) FILTER (WHERE s IN ('success', 'warning')) AS converted_sources, count(*) FILTER (WHERE s = 'warning') AS warning_sources,
  count(*) FILTER (WHERE s = 'failed') AS failed_sources, count(*) FILTER (WHERE s = 'skipped') AS skipped_sources, count(*) FILTER (WHERE s = 'duplicate') AS duplicate_sources,
  (SELECT count(*) FROM c) AS sample_records, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT id FROM c)) AS peak_records,
  (SELECT count(*) FROM z WHERE l_linestatus = 'F' AND id IN (SELECT id FROM c)) AS scientific_signal_series,
  (SELECT count(*) FROM z WHERE l_linestatus = 'O' AND id IN (SELECT id FROM c)) AS structural_record_series FROM f""")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sources, their lines as peaks; each return flag and line status of an order is a series."""
    files, line = _files(spark, sf_dir), A.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "file_id")
    kind = F.when(F.col("l_linestatus") == "F", "SCIENTIFIC_SIGNAL").when(F.col("l_linestatus") == "O", "DECODED_RECORDS")
    series = line.select("file_id", "l_returnflag", "l_linestatus").distinct().withColumn("series_kind", kind)
    return M.result_summary(files, files.select("file_id"), line, series)


@query(f"""WITH {A.PEAKS_SQL}
SELECT compound, detector, channel, max(n) AS maximum FROM (SELECT file_id, compound, detector, channel, count(*) AS n FROM peaks WHERE compound <> '' GROUP BY ALL) GROUP BY ALL""")
def occurrence_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.occurrence_maximum(A.peaks(spark, sf_dir))


_ROUTE_SQL = """CASE o_orderkey % 8 WHEN 0 THEN 'EXACT_ADAPTER' WHEN 1 THEN 'USER_MAPPING' WHEN 2 THEN 'USER_MAPPING_PROFILE' WHEN 3 THEN 'NO_MAPPING_MATCH'
  WHEN 4 THEN 'SCHEMA_DRIFT_CANDIDATE' WHEN 5 THEN 'AMBIGUOUS_MAPPING_PROFILE' WHEN 6 THEN 'AMBIGUOUS_WORKSHEET' END"""
_ROUTES = ("EXACT_ADAPTER", "USER_MAPPING", "USER_MAPPING_PROFILE", "NO_MAPPING_MATCH", "SCHEMA_DRIFT_CANDIDATE", "AMBIGUOUS_MAPPING_PROFILE", "AMBIGUOUS_WORKSHEET")


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = A.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    route = F.coalesce(*[F.when(key % 8 == i, r) for i, r in enumerate(_ROUTES)])
    return o.select(key.alias("file_id"), route.alias("mapping_route"), F.concat(F.lit("profile_"), F.col("o_custkey") % 7).alias("mapping_profile_id"), "o_orderstatus")


@query(f"""
WITH r AS (SELECT {_ROUTE_SQL} AS route, 'profile_' || (o_custkey % 7) AS profile FROM orders)
SELECT count(*) FILTER (WHERE route = 'EXACT_ADAPTER') AS exact_adapter_routes, count(DISTINCT profile) FILTER (WHERE route = 'USER_MAPPING_PROFILE') AS mapping_profiles_used,
  count(*) FILTER (WHERE route = 'NO_MAPPING_MATCH') AS unmapped_tables, count(*) FILTER (WHERE route = 'SCHEMA_DRIFT_CANDIDATE') AS drift_candidates,
  count(*) FILTER (WHERE route LIKE 'AMBIGUOUS%') AS ambiguous_tables FROM r""")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.route_counts(_routes(spark, sf_dir))


@query("""
SELECT doc_id AS file_id, CASE doc_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'tsv' WHEN 2 THEN 'tsv,semicolon' ELSE '' END AS formats FROM documents""")
def candidate_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents named with five suffixes in turn, against three requested formats."""
    d = A.document_files(spark, sf_dir)
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".csv", ".TSV", ".txt", ".xlsx", ".bin")]), (F.col("file_id") % 5 + 1).cast("int"))
    formats = M.candidate_formats(F.concat("relative_path", suffix), ("csv", "tsv", "semicolon"))
    return d.select("file_id", F.array_join(formats, ",").alias("formats"))


_ENTRIES_SQL = f"""r AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, o_orderkey % 3 AS s, {_ROUTE_SQL} AS route FROM orders),
e AS (
  SELECT id, CASE WHEN k < 3 THEN route END AS route, CASE WHEN k < 3 THEN 'ROUTABLE' WHEN id % 40 = 7 THEN 'DUPLICATE' ELSE 'FAILED' END AS status,
    CASE k WHEN 3 THEN CASE WHEN s < 2 THEN 'UNMAPPED_GENERIC_TABLE' ELSE 'UNSUPPORTED_FORMAT' END WHEN 4 THEN 'MAPPING_SCHEMA_DRIFT' WHEN 5 THEN 'MAPPING_PROFILE_AMBIGUOUS' WHEN 6 THEN 'WORKSHEET_AMBIGUOUS'
      WHEN 7 THEN CASE s WHEN 0 THEN 'UNSUPPORTED_FORMAT' WHEN 1 THEN 'ADAPTER_AMBIGUOUS' ELSE 'MALFORMED_INPUT' END END AS problem FROM r)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("file_id")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (key % 3 + 1).cast("int"))
    code = F.when(key % 8 == 7, pick("FORMAT_NOT_DETECTED", "FORMAT_AMBIGUOUS", "DELIMITED_ENCODING_INVALID")).when(key % 8 > 2, "PEAK_MAPPING_FAILED")
    path = F.concat(F.lit("order_"), key.cast("string"), pick(".csv", ".txt", ".dat"))
    rows = _routes(spark, sf_dir).withColumn("problem", M.plan_problem(F.col("mapping_route"), code, path))
    status = F.when(key % 8 < 3, "ROUTABLE").when(key % 40 == 7, "DUPLICATE").otherwise("FAILED")
    return rows.select("file_id", F.when(key % 8 < 3, F.col("mapping_route")).alias("route"), status.alias("status"), "problem")


@query(f"WITH {_ENTRIES_SQL} SELECT id AS file_id, route, status, problem FROM e")
def plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)


@query(f"""WITH {_ENTRIES_SQL}
SELECT count(*) AS total_inputs, count(*) FILTER (WHERE status = 'ROUTABLE') AS routable, count(*) FILTER (WHERE route = 'EXACT_ADAPTER') AS exact_adapters,
  count(*) FILTER (WHERE route = 'USER_MAPPING') AS user_mappings, count(*) FILTER (WHERE route = 'USER_MAPPING_PROFILE') AS mapping_profiles, count(*) FILTER (WHERE route = 'GENERIC_INPUT') AS generic_inputs,
  count(*) FILTER (WHERE problem = 'MAPPING_SCHEMA_DRIFT') AS drifted, count(*) FILTER (WHERE problem = 'UNMAPPED_GENERIC_TABLE') AS unmapped,
  count(*) FILTER (WHERE problem LIKE '%AMBIGUOUS%') AS ambiguous, count(*) FILTER (WHERE problem = 'UNSUPPORTED_FORMAT') AS unsupported, count(*) FILTER (WHERE problem = 'MALFORMED_INPUT') AS malformed,
  count(*) FILTER (WHERE status = 'DUPLICATE') AS duplicates, count(*) FILTER (WHERE status = 'EXCLUDED_ARTIFACT') AS excluded_artifacts, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM e""")
def plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.plan_counts(_entries(spark, sf_dir))


@query("""
SELECT event_id AS file_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS at_text,
  CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS even_text, CAST(user_id AS VARCHAR) AS user_text FROM events""")
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("file_id"), M.cell_text(F.col("ts").cast("timestamp"), "timestamp").alias("at_text"), M.cell_text(F.col("event_id") % 2 == 0, "boolean").alias("even_text"),
        M.cell_text(F.col("user_id"), "bigint").alias("user_text"),
    )
