"""What keeps the work in proportion to the input: inputs read once, no file or value gathered in one place."""

from __future__ import annotations

from tallyloom.functions import canonical
from tallyloom.operators import cells as C
from tallyloom.operators import mapping as M
from tallyloom.operators import merkle
from tallyloom.operators import order as O
from tallyloom.plans import registered_conversions


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_rows_are_gathered_from_cells_once(spark, tmp_path):
    lexemes = [(1, 0, 1, "RT"), (1, 1, 1, "1.5"), (1, 1, 2, "2"), (1, 1, 3, "3"), (1, 2, 1, ""), (1, 2, 2, ""), (1, 3, 3, "note"), (1, 4, 1, ""), (1, 4, 3, "x"), (2, 1, 1, "7"), (2, 1, 2, "8")]
    cells = _table(spark, tmp_path, "cells", lexemes, "file_id long, row_no int, col_no int, lexeme string")
    headers = spark.createDataFrame([(1, 1, "RT"), (1, 2, "Area "), (2, 1, "area"), (2, 2, "Area")], "file_id long, col_no int, header string")
    wide = C.wide_rows(cells, headers)
    assert _plan(wide).count("Relation [") == 1
    got = sorted((r["file_id"], r["row_no"], r["retention_time"], r["area"]) for r in wide.collect())
    assert got == [(1, 1, "1.5", "2"), (1, 4, "", None)]  # blank rows, rows of unknown columns and columns named twice give none
    unmapped = C.unmapped_cells(cells, headers)
    assert _plan(unmapped).count("Relation [") == 1


def test_issues_are_told_after_rows_without_any_went(spark):
    cells = spark.createDataFrame([(1, 1, 1, "1 "), (1, 2, 1, "2"), (1, 3, 1, "x")], "file_id long, row_no int, col_no int, lexeme string")
    headers = spark.createDataFrame([(1, 1, "Area")], "file_id long, col_no int, header string")
    issues = C.value_issues(C.typed_rows(C.wide_rows(cells, headers)))
    assert "Generate inline" in _plan(issues) and "Filter isnotnull(code" not in _plan(issues)
    assert sorted((r["row_no"], r["field"], r["code"]) for r in issues.collect()) == [(1, "area", "PARSE_LEXEME_WHITESPACE_TRIMMED"), (3, "area", "INVALID_NUMBER")]


def test_mapped_tables_are_read_once_for_peaks(spark, tmp_path):
    rows = [(1, 1, 1, "1"), (1, 1, 2, "2"), (2, 1, 1, "1"), (2, 1, 2, "bad"), (3, 1, 1, ""), (4, 1, 1, "1"), (4, 1, 2, "2"), (4, 1, 3, "more"), (5, 1, 1, "3"), (5, 1, 2, "4"), (5, 2, 1, ""), (5, 2, 2, "")]
    cells = _table(spark, tmp_path, "cells", [(f, "p", r, c, v) for f, r, c, v in rows], "file_id long, profile_id string, row_no int, col_no int, lexeme string")
    columns = spark.createDataFrame([("p", 1, "retention_time"), ("p", 2, "area")], "profile_id string, position int, role string")
    units = spark.createDataFrame([("p", "min", None)], "profile_id string, retention_time_unit string, area_unit string")
    peaks, faults = M.mapped_peaks(cells, columns, units)
    assert "lexeme" not in _plan(peaks)
    assert sorted((r["file_id"], r["retention_time"], r["area"], r["observation_order"]) for r in peaks.collect()) == [(1, 1.0, 2.0, 1), (5, 3.0, 4.0, 1)]
    assert sorted((r["file_id"], r["code"]) for r in faults.collect()) == [(2, "PEAK_MAPPING_NUMBER_INVALID"), (3, "PEAK_MAPPING_EMPTY_TABLE"), (4, "PEAK_MAPPING_EXTRA_CELLS")]


def test_profile_checks_gather_no_content_and_expand_nothing(spark):
    columns = spark.createDataFrame([("a", 1, "retention_time"), ("a", 2, "area"), ("b", 1, "retention_time"), ("b", 3, "area"), ("c", 1, "area"), ("c", 2, "area")], "profile_id string, position int, role string")
    profiles = spark.createDataFrame([("a", "csv", ["x", None]), ("b", "csv", ["x", None]), ("c", "csv", ["x", ""])], "profile_id string, source_format string, headers array<string>")
    faults = M.profile_faults(columns, profiles)
    assert "Window" not in _plan(faults) and "Expand" not in _plan(faults)
    assert sorted((r["profile_id"], r["fault"]) for r in faults.collect()) == [
        ("a", "CONTENT_REPEATED"), ("b", "CONTENT_REPEATED"), ("b", "POSITIONS_NOT_CONTIGUOUS"), ("c", "ROLE_MISSING_RETENTION_TIME"), ("c", "ROLE_REPEATED"),
    ]


def test_escapes_touch_only_what_needs_them(spark):
    import json

    texts = ['plain', 'a"b\\c/d', "line\r\n\tend\n", "높이 🧪 x\x7f\x01\b\f", "", " é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = rows.select("t", canonical.json_text(rows["t"]).alias("j"))
    assert all(r["j"] == json.dumps(r["t"], ensure_ascii=True) for r in out.collect())
    assert "conv(" not in _plan(out)


def test_compared_tables_are_read_once(spark):
    import pyspark.sql.functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(x):
        read.add(1)
        return f"v{x}"

    a = spark.range(500).withColumn("v", costly("id"))
    found = merkle.changes(a, spark.range(500).withColumn("v", F.concat(F.lit("v"), F.when(F.col("id") == 7, 0).otherwise(F.col("id")))), "id", ["v"], range_rows=16)
    assert [(r["id"], r["change"]) for r in found.collect()] == [(7, "changed")]
    assert read.value == 500


def test_sample_ids_are_elected_without_gathering_a_file(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (1, 3, "a"), (2, 1, None), (3, 1, "c"), (3, 2, None)], "file_id long, row_no int, sample_id string")
    from pyspark.sql import functions as F

    out = O.elect_sample_id(rows, F.concat(F.lit("stem"), "file_id"), ["row_no"])
    assert "Window" not in _plan(out)
    assert sorted((r["file_id"], r["row_no"], r["sample_id"], r["other_ids"]) for r in out.collect()) == [
        (1, 1, "b", True), (1, 2, "b", True), (1, 3, "b", True), (2, 1, "stem2", False), (3, 1, "c", False), (3, 2, "c", False),
    ]


def test_more_lines_are_more_files(spark, tmp_path, monkeypatch):
    lines = [(str(k % 3), float(k % 40), k / 4, k % 7 + 1, "O") for k in range(700)]
    spark.createDataFrame(lines, "l_returnflag string, l_quantity double, l_extendedprice double, l_linenumber int, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([("c", 1.0), ("d", 2.0)], "c_name string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    made = []
    kept = registered_conversions._result_files
    monkeypatch.setattr(registered_conversions, "_result_files", lambda *a: made.append(a[2]) or kept(*a))
    monkeypatch.setattr(registered_conversions, "LINES_A_FILE", 50)
    out = {r["detector"]: r["n"] for r in registered_conversions.converted_peaks(spark, str(tmp_path)).collect()}
    assert made == [14] and out == {"0": 200, "1": 200, "2": 200}
