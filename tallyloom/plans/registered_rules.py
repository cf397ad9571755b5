"""Registered queries that reach the remaining rules, readers and profile checks, over rows with one fault in so many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import mapping as M
from tallyloom.operators import validate as V
from tallyloom.plans import analogue as A
from tallyloom.plans.registered import query
from tallyloom.sources import results


def _counted(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count("*").alias("n"))


def _count_sql(table: str, key: str, modulus: int, codes: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {k} THEN '{c}'" for k, c in codes.items())
    return f"SELECT CASE {key} % {modulus} {cases} END AS code, count(*) AS n FROM {table} WHERE {key} % {modulus} IN ({', '.join(map(str, codes))}) GROUP BY 1"


@query(_count_sql("orders", "o_orderkey", 6, {1: "SAMPLE_ID_EMPTY", 2: "RUNTIME_NONFINITE", 3: "ACQUIRED_AT_RELIABILITY_INVALID", 4: "WORKBOOK_CELL_TEXT_LIMIT"}))
def issues_sample_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = A.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    none = F.array().cast("array<string>")
    samples = o.select(
        F.col("o_orderkey").alias("file_id"), F.when(k == 1, " \t").otherwise(F.concat(F.lit("s"), "o_orderkey")).alias("sample_id"), F.lit("gc").alias("instrument_type"),
        F.when(k == 4, F.repeat(F.lit("v"), 32_768)).otherwise(F.col("o_orderpriority")).alias("vendor"), none.alias("detectors"), none.alias("channels"),
        F.when(k == 2, float("inf")).otherwise(F.col("o_totalprice")).alias("runtime"), F.lit(True).alias("acquired_at_reliable"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 3, "").otherwise("+09:00")).alias("acquired_at_raw"),
    )
    return _counted(V.sample_rules(samples))


@query(
    _count_sql("orders", "o_orderkey", 7, {1: "CANONICAL_ISSUE_SEVERITY_INVALID", 2: "CANONICAL_ISSUE_CODE_INVALID", 4: "CANONICAL_ISSUE_TEXT_UNREPRESENTABLE", 5: "CANONICAL_ISSUE_PRIVATE_PATH"})
    + " UNION ALL " + _count_sql("orders", "o_orderkey", 700, {3: "CANONICAL_ISSUE_CELL_LIMIT"})
)
def issues_about_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = A.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 7
    message = F.when(F.col("o_orderkey") % 700 == 3, F.repeat(F.lit("m"), 32_768)).when(k == 4, F.lit("a\x01b")).when(k == 5, F.lit("see C:\\data\\run")).otherwise(F.col("o_orderpriority"))
    issues = o.select(F.col("o_orderkey").alias("file_id"), F.when(k == 1, "fatal").otherwise("error").alias("severity"), F.when(k == 2, "not a code").otherwise("GOOD_CODE").alias("code"), message.alias("message"), F.lit("table:row:1").alias("source"))
    return _counted(V.issue_rules(issues))


@query("""
WITH n AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT 'SAMPLE_COUNT_INVALID' AS code, count(*) AS n FROM n WHERE n <> 1
UNION ALL SELECT 'WORKBOOK_TEXT_UNREPRESENTABLE', count(*) FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'PEAK_SAMPLE_MISMATCH', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 3""")
def issues_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with no or several samples, texts that no cell holds, and peaks of another sample."""
    files, line = A.files(spark, sf_dir), A.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "file_id")
    names = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("\x02"))).otherwise(F.col("c_name")).alias("name"), "c_mktsegment")
    children = line.select("file_id", F.when(F.col("l_linenumber") == 3, "other").otherwise(F.concat(F.lit("order_"), "file_id")).alias("sample_id"))
    parts = [V.count_rules(files, line), V.text_rules(names, ["name", "c_mktsegment"]), V.child_rules(children, files, "PEAK_SAMPLE_MISMATCH")]
    return _counted(V.all_issues([p.select("file_id", "code", "source") for p in parts]))


@query("""
SELECT 'PEAK_OBSERVATION_ORDER_INVALID' AS code, count(*) AS n FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT 'PEAK_SECONDARY_RETENTION_VALUE_INVALID', count(*) FROM lineitem WHERE l_linenumber = 2
UNION ALL SELECT 'PEAK_SECONDARY_RETENTION_UNIT_INVALID', count(*) FROM lineitem WHERE l_linenumber = 3
UNION ALL SELECT 'PEAK_TIME_BOUNDARY_INVALID', count(*) FROM lineitem WHERE l_linenumber = 4""")
def issues_peak_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders below one, second times and units that say nothing, and a NaN among three times."""
    k = F.col("peak_number")
    rows = A.peaks(spark, sf_dir).withColumns(
        {
            "observation_order": k - 1, "secondary_retention_time": F.when(k == 2, float("nan")).otherwise(1.0), "secondary_retention_time_unit": F.when(k == 3, " ").otherwise("s"),
            "start_time": F.when(k == 4, float("nan")).otherwise(F.col("retention_time") - 1), "end_time": F.col("retention_time") + 1,
        }
    )
    return _counted(V.peak_rules(rows.where("peak_number is not null")))


@query("""
WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT 'SIGNAL_SERIES_KIND_INVALID' AS code, count(*) AS n FROM s WHERE user_id % 4 = 1 HAVING count(*) > 0 UNION ALL SELECT 'SIGNAL_LENGTH_MISMATCH', count(*) FROM s WHERE user_id % 4 = 2 HAVING count(*) > 0
UNION ALL SELECT 'METADATA_VALUE_TYPE_INVALID', count(*) FROM events WHERE event_id % 5 = 1 UNION ALL SELECT 'METADATA_SOURCE_UNSAFE', count(*) FROM events WHERE event_id % 5 IN (2, 3)""")
def issues_series_and_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, u = A.points(spark, sf_dir), F.col("file_id") % 4
    held = p.groupBy("file_id", "channel").agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y"))
    series = held.withColumns({"y": F.when(u == 2, F.slice("y", 1, F.size("y") - 1)).otherwise(F.col("y")), "series_kind": F.when(u == 1, "curve").otherwise("scientific_signal")})
    e, k = A.table(spark, sf_dir, "events"), F.col("event_id") % 5
    source = F.when(k == 2, "/etc/passwd").when(k == 3, "https://host/x").when(k == 4, "sheet:1:cell:AB12").otherwise(F.concat(F.lit("table:row:"), "event_id"))
    metadata = e.select(F.col("event_id").alias("file_id"), F.when(k == 1, "blob").otherwise("text").alias("value_type"), source.alias("source"))
    return _counted(V.signal_rules(series).unionByName(V.metadata_rules(metadata)))


_PROFILE_FAULTS = {
    1: "POSITIONS_NOT_CONTIGUOUS", 2: "ROLE_REPEATED", 3: "ROLE_MISSING_AREA", 4: "ROLE_MISSING_RETENTION_TIME", 6: "SECONDARY_UNIT_UNPAIRED", 7: "SECONDARY_UNIT_UNPAIRED",
    8: "HEIGHT_UNIT_WITHOUT_COLUMN", 9: "RETENTION_TIME_UNIT_MISSING", 10: "WORKSHEET_TITLE_OUTSIDE_WORKBOOK",
}


@query(f"""
WITH p AS (SELECT p_partkey AS key, p_partkey % 12 AS k, CAST(CASE WHEN p_partkey % 24 = 23 THEN p_partkey - 12 ELSE p_partkey END AS VARCHAR) AS id,
  CASE WHEN p_partkey // 48 % 8 = 1 THEN 'l' || (p_partkey // 48) ELSE 's' || (p_partkey // 24) END AS set_id FROM part),
n AS (SELECT *, count(*) OVER (PARTITION BY set_id) AS in_set, count(*) OVER (PARTITION BY set_id, k = 5) AS alike, count(*) OVER (PARTITION BY set_id, id) AS same_id FROM p)
SELECT id AS profile_id, CASE k {" ".join(f"WHEN {k} THEN '{c}'" for k, c in _PROFILE_FAULTS.items())} END AS fault FROM p WHERE k IN ({", ".join(map(str, _PROFILE_FAULTS))})
UNION ALL SELECT id, unnest(['ROLE_MISSING_RETENTION_TIME', 'ROLE_MISSING_AREA']) FROM p WHERE key % 240 = 0
UNION ALL SELECT id, 'CONTENT_REPEATED' FROM n WHERE k = 5 AND alike > 1
UNION ALL SELECT DISTINCT id, 'PROFILE_ID_REPEATED' FROM n WHERE same_id > 1
UNION ALL SELECT id, 'SET_TOO_LARGE' FROM n WHERE in_set > 32""")
def profile_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as profiles in sets of 24 and some of 48: with one fault in so many, a common id for two in 24, and no column for one in 240."""
    part, key, k = A.table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_partkey") % 12
    own = F.when(key % 24 == 23, key - 12).otherwise(key).cast("string").alias("profile_id")
    row = lambda at, role: F.struct(F.lit(at).cast("int").alias("position"), F.lit("x").alias("label"), role.alias("role"))
    role = lambda wrong, instead, right: F.when(k == wrong, instead).otherwise(right)
    third = F.when(k == 2, "area").when(k == 6, "secondary_retention_time").when(k == 8, "IGNORED").otherwise("height")
    rows = F.array(
        row(1, role(4, "IGNORED", "retention_time")), row(2, role(3, "IGNORED", "area")),
        F.struct(F.when(k == 1, 5).otherwise(3).alias("position"), F.lit("x").alias("label"), third.alias("role")),
    )
    columns = part.where((key % 24 != 23) & (key % 240 != 0)).select(own, F.inline(rows))
    headers = F.when(k == 5, F.array(F.lit("same"))).otherwise(F.array(key.cast("string")))
    block = lambda n: F.floor(key / n)
    sets = F.when(block(48) % 8 == 1, F.concat(F.lit("l"), block(48).cast("string"))).otherwise(F.concat(F.lit("s"), block(24).cast("string")))
    units = {"retention_time_unit": F.when(k == 9, " ").otherwise("min"), "secondary_retention_time_unit": F.when(k == 7, "s"), "height_unit": F.when(k == 8, "mV"), "worksheet_title": F.when(k == 10, "Sheet1")}
    return M.profile_faults(columns, part.select(own, sets.alias("set_id"), F.lit("csv").alias("source_format"), headers.alias("headers"), *[c.alias(n) for n, c in units.items()]))


@query(f"""
WITH {A.PEAKS_SQL}
SELECT file_id, 'Peak Table(Ch1)' AS section, peak_number, retention_time, area, CASE WHEN compound = 'Brand#11' THEN NULL ELSE compound END AS compound,
  CAST(row_number() OVER (PARTITION BY file_id ORDER BY {A.PLACE_SQL}) AS INTEGER) AS observation_order FROM peaks""")
def sectioned_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as sectioned result texts, a section for their lines, and read again."""
    p = A.peaks(spark, sf_dir)
    # Numbers travel, and become text where a file's lines are together.
    name = lambda x: F.when(x["compound"] == "Brand#11", "unknown").otherwise(x["compound"])
    line = lambda x: F.concat_ws("\t", x["peak_number"].cast("string"), x["retention_time"].cast("string"), F.lit("0"), F.lit("99"), x["area"].cast("string"), F.lit("1"), name(x))
    rows = F.sort_array(F.collect_list(F.struct(*A.PLACE, "retention_time", "compound")))
    texts = p.groupBy("file_id").agg(F.transform(rows, line).alias("l"))
    head = F.concat(F.lit("[Header]\r\nApplication Name\tX\r\n\r\n[Peak Table(Ch1)]\r\n# of Peaks\t"), F.size("l").cast("string"), F.lit("\r\nPeak#\tR.Time\tI.Time\tF.Time\tArea\tHeight\tName\r\n"))
    files = texts.select("file_id", F.encode(F.concat(head, F.array_join("l", "\r\n"), F.lit("\r\n")), "UTF-8").alias("content"))
    peaks, _, _ = results.sectioned_result(results.text_lines(files))
    return peaks.select("file_id", "section", F.col("peak_number").cast("long").alias("peak_number"), "retention_time", "area", "compound", "observation_order")
