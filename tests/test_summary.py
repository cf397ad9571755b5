"""Summaries on small tables, with empty and null rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import summary
from tallyloom.plans import planning


def test_result_summary_counts_converted_files_only(spark):
    files = spark.createDataFrame([(1, "success"), (2, "warning"), (3, "failed"), (4, "duplicate"), (5, "skipped")], "file_id long, status string")
    rows = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "file_id long")
    series = spark.createDataFrame([(1, "SCIENTIFIC_SIGNAL"), (2, "DECODED_RECORDS"), (2, "other"), (3, "SCIENTIFIC_SIGNAL")], "file_id long, series_kind string")
    assert tuple(summary.result_summary(files, rows, rows, series).first()) == (5, 2, 1, 1, 1, 1, 3, 3, 1, 1)
    assert tuple(summary.result_summary(files.limit(0), rows, rows, series).first()) == (0,) * 10


def test_occurrence_maximum(spark):
    rows = [(1, "a", "d", None), (1, "a", "d", None), (2, "a", "d", None), (2, "a", None, "c"), (2, "", "d", "c"), (2, None, "d", "c")]
    out = summary.occurrence_maximum(spark.createDataFrame(rows, "file_id long, compound string, detector string, channel string")).collect()
    assert {tuple(r) for r in out} == {("a", "d", None, 2), ("a", None, "c", 1)}


def test_candidate_formats_and_problems(spark):
    paths = spark.createDataFrame([("a/B.CSV",), ("b.txt",), ("c",), (None,)], "p string")
    assert [r[0] for r in paths.select(summary.candidate_formats(F.col("p"), ("csv", "tsv", "semicolon"))).collect()] == [["csv"], ["tsv", "semicolon"], [], []]
    assert [r[0] for r in paths.select(summary.candidate_formats(F.col("p"), ())).collect()] == [[], [], [], []]
    cases = [("NO_MAPPING_MATCH", "X", "a.csv"), ("NO_MAPPING_MATCH", "X", "a.bin"), (None, "FORMAT_NOT_DETECTED", "a"), (None, "FORMAT_AMBIGUOUS", "a"), (None, "BAD", "a"), (None, None, "a")]
    problem = summary.plan_problem(F.col("route"), F.col("code"), F.col("p"))
    got = [r[0] for r in spark.createDataFrame(cases, "route string, code string, p string").select(problem).collect()]
    assert got == ["UNMAPPED_GENERIC_TABLE", "UNSUPPORTED_FORMAT", "UNSUPPORTED_FORMAT", "ADAPTER_AMBIGUOUS", "MALFORMED_INPUT", None]


def test_cell_text(spark):
    frame = spark.sql("SELECT timestamp '2026-01-02 03:04:05' AS a, timestamp '1969-12-31 23:59:59.25' AS b, true AS c, 12345678901234567890123456789012345678BD AS d, CAST(NULL AS boolean) AS e")
    shown = frame.select(*[summary.cell_text(F.col(n), k) for n, k in zip("abcde", ("timestamp", "timestamp", "boolean", "decimal", "boolean"), strict=True)]).first()
    assert tuple(shown) == ("2026-01-02T03:04:05+00:00", "1969-12-31T23:59:59.250000+00:00", "True", "12345678901234567890123456789012345678", None)


def test_plan_limits(spark):
    files = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "file_id long, size long")
    assert [planning.plan_limit(files, *limits) for limits in ((3, 12), (2, 12), (3, 11))] == [None, "PLAN_FILE_LIMIT_EXCEEDED", "PLAN_SIZE_LIMIT_EXCEEDED"]
    assert planning.plan_limit(files.limit(0)) is None
