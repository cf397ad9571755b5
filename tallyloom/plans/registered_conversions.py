"""Registered queries over whole conversions: files that the query writes from the given tables, read back by profile."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.shared import shared_folder
from tallyloom.operators import manifest as MF
from tallyloom.operators import order as O
from tallyloom.operators import summary as M
from tallyloom.operators import validate as V
from tallyloom.plans import analogue as A
from tallyloom.plans import convert
from tallyloom.plans.publish import measured
from tallyloom.plans.recipes import Profile, Recipe
from tallyloom.plans.registered import query

PROFILE = Profile("by_line", "csv", (("Flag", "detector"), ("Zeit (min)", "retention_time"), ("Fläche", "area"), ("Nr", "peak_number"), ("Notiz", "IGNORED")), "min", "mV.s")


#: Order lines in one result file, about: more lines are more files, as a batch of results grows.
LINES_A_FILE = 500_000


def _result_files(spark: SparkSession, sf_dir: str, n_mapped: int = 8) -> str:
    """A folder of result files: order lines in eight (or ``n_mapped``), one kind of them with another column, and customers in two."""
    path = f"{shared_folder(spark).rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    line = A.table(spark, sf_dir, "lineitem")
    cells = line.select(F.col("l_returnflag").alias("Flag"), F.col("l_quantity").alias("Zeit (min)"), F.col("l_extendedprice").cast("decimal(18,2)").alias("Fläche"), F.col("l_linenumber").alias("Nr"), F.col("l_linestatus").alias("Notiz"))
    write = lambda df, name, n: df.repartition(n).write.option("header", True).csv(f"{path}/{name}")
    write(cells.where("Nr <> 7"), "mapped", n_mapped)
    write(cells.where("Nr = 7").withColumn("more", F.lit("x")), "drifted", max(2, n_mapped // 4))
    write(A.table(spark, sf_dir, "customer").select("c_name", "c_acctbal"), "other", 2)
    return path


@query("""
SELECT l_returnflag AS detector, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, sum(l_quantity) AS times, 'min' AS retention_time_unit, 'mV.s' AS area_unit
FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1""")
def converted_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that a profile's conversion reads from files: those of the very headers, and no others."""
    n_files = max(8, -(-A.table(spark, sf_dir, "lineitem").count() // LINES_A_FILE))
    out = convert.convert(spark, [_result_files(spark, sf_dir, n_files)], Recipe(recursive=True, sort="filename", profiles=(PROFILE,)))
    peaks = out.peaks.groupBy("detector", "retention_time_unit", "area_unit")
    return peaks.agg(F.count("*").alias("n"), F.sum(F.col("area").cast("decimal(18,2)")).cast("double").alias("total"), F.sum("retention_time").alias("times"))


@query("""
SELECT unnest(['ROUTABLE', 'FAILED', 'FAILED']) AS status, unnest(['USER_MAPPING', NULL, NULL]) AS route, unnest([NULL, 'MAPPING_SCHEMA_DRIFT', 'UNMAPPED_GENERIC_TABLE']) AS problem, unnest([8, 2, 2]) AS n
FROM (SELECT count(*) FROM lineitem)""".replace("unnest([8, 2, 2]) AS n", "CAST(unnest([8, 2, 2]) AS BIGINT) AS n"))
def planned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a plan routes the files, by their header lines alone."""
    entries = convert.plan(spark, [_result_files(spark, sf_dir)], Recipe(recursive=True, sort="filename", profiles=(PROFILE,)))
    return entries.groupBy("status", "route", "problem").agg(F.count("*").alias("n"))


# -- manifest --------------------------------------------------------------------------------

_OPTIONS = {"recursive": True, "extensions": [".csv", ".tsv"], "sort": "auto", "include_signals": False, "on_error": "continue", "sidecar_mode": "csv", "overwrite": False, "output_name": "orders"}
_CODES_SQL = """c AS (SELECT DISTINCT CASE WHEN l_quantity > 45 THEN 'RANGE_' || l_linenumber ELSE 'NOTE_' || l_linenumber END AS code, l_quantity > 45 AS bad FROM lineitem WHERE l_quantity > 40)"""
_LITERALS = {
    "library_version": MF.VERSION, "generated_at_utc": "2026-01-01T00:00:00+00:00", "result_summary_schema_version": "1", "sort_requested": "auto", "sort_effective": "acquired_at", "conversion_options_policy": MF.POLICIES["conversion_options_policy"],
    "option_recursive": "True", "option_extensions": ".csv; .tsv", "option_sort": "auto", "option_include_signals": "False", "option_adapter": "<auto>", "option_sheet": "<auto>", "option_include_hidden_sheets": "False",
    "option_on_error": "continue", "option_overwrite": "False", "option_sidecar_mode": "csv", "option_output_name": "orders", "execution_mode": "convert", "included_sheets": "parts; peaks", "include_signals": "False", "original_modified": "No",
    "source_display_policy": MF.POLICIES["source_display_policy"], "source_display_escape_count": "0", "data_split": "False", "warning_summary_omitted_count": "0", "error_summary_omitted_count": "0",
    "literal_string_policy": MF.POLICIES["literal_string_policy"], "exact_integer_policy": MF.POLICIES["exact_integer_policy"], "nonfinite_literal_count": "0", "conversion_recipe_schema_version": "1",
}
_ROWS_SQL = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in _LITERALS.items())


@query(f"""
WITH {_CODES_SQL}, f AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS ok FROM orders),
s AS (SELECT DISTINCT user_id, event_type FROM events JOIN f ON user_id = id AND ok),
m AS (
  SELECT * FROM (VALUES {_ROWS_SQL}) AS t(key, value)
  UNION ALL SELECT 'input_file_count', CAST(count(*) AS VARCHAR) FROM f UNION ALL SELECT 'success_count', CAST(count(*) FILTER (WHERE ok) AS VARCHAR) FROM f
  UNION ALL SELECT 'warning_file_count', '0' UNION ALL SELECT 'failure_count', CAST(count(*) FILTER (WHERE NOT ok) AS VARCHAR) FROM f UNION ALL SELECT 'duplicate_count', '0' UNION ALL SELECT 'skipped_count', '0'
  UNION ALL SELECT 'sample_record_count', CAST(count(*) FILTER (WHERE ok) AS VARCHAR) FROM f
  UNION ALL SELECT 'peak_record_count', CAST(count(*) AS VARCHAR) FROM lineitem JOIN f ON l_orderkey = id AND ok
  UNION ALL SELECT 'scientific_signal_series_count', CAST(count(*) AS VARCHAR) FROM s UNION ALL SELECT 'structural_record_series_count', '0'
  UNION ALL SELECT 'sort_reason', 'All successful files have reliable, timezone-aware acquisition times.' || CASE WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN ' Unavailable outcomes use natural filename fallback.' ELSE '' END FROM f
  UNION ALL SELECT 'warning_summary', string_agg(code, '; ' ORDER BY code) FROM c WHERE NOT bad UNION ALL SELECT 'error_summary', string_agg(code, '; ' ORDER BY code) FROM c WHERE bad
  UNION ALL SELECT 'formula_like_literal_count', CAST(count(*) FILTER (WHERE p_partkey % 3 = 0) AS VARCHAR) FROM part
  UNION ALL SELECT 'exact_integer_literal_count', CAST((SELECT count(*) FROM lineitem) AS VARCHAR))
SELECT key, value, NULL::VARCHAR AS path, NULL::BIGINT AS row_count, NULL::VARCHAR AS sha256, NULL::BIGINT AS formula_escape_count FROM m
UNION ALL SELECT 'sidecar', 'CSV texts that look like formulas are escaped with an apostrophe', 'parts_001.csv', count(*), 'none', count(*) FILTER (WHERE p_partkey % 3 = 0) FROM part""")
def manifest_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of a manifest: orders as files, order lines as peaks, events as series, parts as a CSV part."""
    from tallyloom.plans.registered import _issues

    files = A.files(spark, sf_dir)
    line, events = A.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "file_id"), A.table(spark, sf_dir, "events")
    series = events.select(F.col("user_id").alias("file_id"), "event_type").distinct().withColumn("series_kind", F.lit("SCIENTIFIC_SIGNAL"))
    tables = {
        "peaks": line.select("l_returnflag", (F.col("file_id") + F.lit(10**15)).alias("wide"), "l_quantity"),
        "parts": A.table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name")).alias("name"), "p_partkey"),
    }
    facts = []
    for name, rows in tables.items():  # the measures come with the one pass that writes a table
        held, seen = measured(rows)
        held.write.format("noop").mode("overwrite").save()
        m = seen.get
        facts.append((name, m["row_count"], m["formula_like"] or 0, m["non_finite"] or 0, m["exact_integers"] or 0, False))
    written = spark.createDataFrame(facts, "table string, row_count long, formula_like long, non_finite long, exact_integers long, sidecar boolean")
    part = written.where("table = 'parts'").select(F.lit("parts_001.csv").alias("relative_path"), "row_count", F.lit("none").alias("sha256"), F.col("formula_like").alias("formula_escape_count"))
    counts = M.result_summary(files, files.select("file_id"), line, series)
    return MF.manifest_rows(files, _issues(spark, sf_dir), counts, O.sort_decision(files), written, part, _OPTIONS, {"conversion_recipe_schema_version": 1, "conversion_plan_schema_version": None}, datetime(2026, 1, 1, tzinfo=UTC))


# -- checks that no other query reaches ------------------------------------------------------


def _stream_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as streams, one in seven kinds broken in a way of its own."""
    peaks = A.observed(A.peaks(spark, sf_dir)).withColumns({"secondary_retention_time": F.lit(None).cast("double"), "secondary_retention_time_unit": F.lit(None).cast("string")})
    k, o, first = F.col("file_id") % 7, F.col("observation_order"), F.col("observation_order") == 1
    return peaks.withColumns(
        {
            "observation_order": F.when((k == 1) & first, None).when(k == 2, None).otherwise(o),
            "secondary_retention_time": F.when((k == 2) | (k == 3) | ((k == 4) & first), 1.0),
            "secondary_retention_time_unit": F.when((k == 3) & first, "ms").when((k == 2) | (k == 3) | ((k == 4) & first), "s"),
            "area": F.when((k == 5) & first, float("nan")).otherwise(F.col("area")),
            "area_unit": F.when((k == 6) & first, "mV").when(k == 6, None),
        }
    )


@query(f"""
WITH {A.PEAKS_SQL}, s AS (SELECT file_id % 7 AS k, count(*) AS n FROM peaks GROUP BY file_id, detector, channel),
c AS (
  SELECT 'PEAK_OBSERVATION_ORDER_PARTIAL' AS code FROM s WHERE k = 1 AND n > 1 UNION ALL SELECT 'PEAK_SECONDARY_RETENTION_ORDER_REQUIRED' FROM s WHERE k = 2
  UNION ALL SELECT 'PEAK_SECONDARY_RETENTION_UNIT_INCONSISTENT' FROM s WHERE k = 3 AND n > 1 UNION ALL SELECT 'PEAK_RETENTION_DIMENSION_MIXED' FROM s WHERE k = 4 AND n > 1
  UNION ALL SELECT 'ORDERED_PEAK_VALUE_INVALID' FROM s WHERE k = 5 UNION ALL SELECT 'ORDERED_PEAK_UNIT_INVALID' FROM s WHERE k = 6 AND n > 1)
SELECT code, count(*) AS n FROM c GROUP BY 1""")
def issues_stream_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream rule once: partial and missing orders, mixed dimensions, unequal units, values that aren't finite."""
    return V.stream_rules(_stream_cases(spark, sf_dir), A.PLACE).groupBy("code").agg(F.count("*").alias("n"))
