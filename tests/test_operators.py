"""Order, tables, validation, routing and mapping on hand-made rows."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import cells as C
from tallyloom.operators import mapping as M
from tallyloom.operators import order as O
from tallyloom.operators import routing as R
from tallyloom.operators import series as S
from tallyloom.operators import tables as P
from tallyloom.operators import validate as V
from tallyloom.plans import planning

PEAK = "file_id long, row_no int, sample_id string, source_file string, detector string, channel string, compound string, area double, retention_time double, retention_time_unit string, secondary_retention_time double, secondary_retention_time_unit string, observation_order int, area_unit string, start_time double, end_time double"


def peak(file_id, row_no, order=None, rt=1.0, unit="min", rt2=None, unit2=None, compound=None, area=1.0, area_unit=None, start=None, end=None, detector="FID"):
    return (file_id, row_no, f"s{file_id}", f"f{file_id}", detector, None, compound, area, rt, unit, rt2, unit2, order, area_unit, start, end)


def codes(df):
    return sorted((r["file_id"], r["code"]) for r in df.collect())


def test_global_rank_over_many_ranges(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = O.global_rank(df, [F.col("v")], "rank").collect()
    assert all(r["rank"] == r["v"] + 1 for r in got) and len(got) == 500
    assert O.global_rank(df.limit(0), [F.col("v")], "rank").count() == 0


FILES = "file_id long, name string, relative_path string, public_id string, input_order long, ok boolean, acquired_at timestamp, reliable boolean, sequence long, status string, settled boolean"


def file_rows(spark, rows):
    import datetime as dt

    full = []
    for i, (name, ok, hour, reliable, seq, public) in enumerate(rows):
        at = None if hour is None else dt.datetime(2026, 1, 1, hour)
        full.append((i, name, name, public, i, ok, at, reliable, seq, "success" if ok else "failed", False))
    return spark.createDataFrame(full, FILES)


def test_sort_decisions(spark):
    timed = file_rows(spark, [("b10", True, 3, True, None, None), ("b2", True, 1, True, None, None), ("x", False, None, False, None, None)])
    ranked, decision = O.sort_files(timed)
    row = decision.first()
    assert row["effective"] == "acquired_at" and row["reason"].endswith("fallback.")
    assert [r["name"] for r in ranked.orderBy("file_rank").collect()] == ["b2", "b10", "x"]
    assert [r["sort_key"] for r in ranked.orderBy("file_rank").collect()][2] == "fallback:x"
    numbered = file_rows(spark, [("b10", True, 3, False, 2, None), ("b2", True, 1, True, 5, None)])
    assert O.sort_decision(numbered).first()["effective"] == "sequence"
    named = file_rows(spark, [("b10", True, None, False, None, None), ("b2", True, 1, True, None, None), ("b1", True, 1, True, None, "source-ff10")])
    ranked, decision = O.sort_files(named)
    assert decision.first()["effective"] == "filename"
    assert [r["name"] for r in ranked.orderBy("file_rank").collect()] == ["b2", "b10", "b1"]
    assert O.sort_decision(named.limit(0)).first()["effective"] == "filename"
    assert O.sort_decision(named, "input_order").first()["reason"] == "User requested input_order ordering."


def test_stop_after_failure(spark):
    files = file_rows(spark, [("a", True, None, False, None, None), ("b", False, None, False, None, None), ("c", True, None, False, None, None), ("d", True, None, False, None, None)])
    files = files.withColumn("status", F.when(F.col("name") == "d", "duplicate").otherwise(F.col("status"))).withColumn("settled", F.col("name") == "d")
    assert [r["status"] for r in O.stop_after_failure(files).orderBy("file_id").collect()] == ["success", "failed", "skipped", "duplicate"]


def test_compound_matrix(spark):
    rows = [peak(1, 1, compound="x", area=1.0), peak(1, 2, compound="x", area=2.0), peak(1, 3, compound="X", area=5.0), peak(2, 1, compound="y", area=3.0), peak(2, 2, compound=None), peak(2, 3, compound="x", area=4.0, detector="TCD")]
    long = P.compound_matrix_long(spark.createDataFrame(rows, PEAK), ["file_id", "row_no"])
    got = {(r["file_id"], r["column_name"]): r["area"] for r in long.collect()}
    q = lambda c, d: f"q[compound={c}][detector={d}][channel=]_area"
    assert got == {(1, q("x", "FID")): 1.0, (1, q("x", "FID") + "_2"): 2.0, (1, q("X", "FID") + "__identity_2"): 5.0, (2, q("y", "FID")): 3.0, (2, q("x", "TCD")): 4.0}
    files = spark.createDataFrame([(1, "s1", "success"), (2, "s2", "warning"), (3, "s3", "success"), (4, "s4", "failed")], "file_id long, sample_id string, status string")
    wide = {r["file_id"]: r for r in P.compound_matrix_wide(long, files, [q("x", "FID")]).collect()}
    assert set(wide) == {1, 2, 3} and wide[1][q("x", "FID")] == 1.0 and wide[3][q("x", "FID")] is None


def test_order_matrices(spark):
    rows = [peak(1, k, order=k, rt=float(k), area=10.0 * k) for k in (2, 1, 3)] + [peak(1, 9, rt=9.0)] + [peak(2, k, order=k, rt2=0.5 * k, unit2="s") for k in (1, 2)]
    df = spark.createDataFrame(rows, PEAK)
    flat = P.widen_order_matrix(P.order_matrix(df, ["row_no"]), 4).collect()
    assert len(flat) == 1 and [flat[0][f"peak_{k}_area"] for k in (1, 2, 3, 4)] == [10.0, 20.0, 30.0, None]
    second = P.order_matrix(df, ["row_no"], two_dimensional=True).collect()
    assert [tuple(x) for x in second[0]["peaks"]] == [(1.0, 0.5, 1.0), (1.0, 1.0, 1.0)]


def test_segments_never_split_atoms(spark):
    df = P.column_segments(spark.createDataFrame([(i,) for i in range(1, 41)], "ordinal int"), capacity=16, fixed=8, atom=3)
    per = {}
    for r in df.collect():
        per.setdefault(r["segment"], []).append(r["ordinal"])
    assert all(len(v) % 3 == 0 for k, v in per.items() if k < max(per)) and max(map(len, per.values())) == 6


def test_logs_and_counts(spark):
    issues = spark.createDataFrame([(1, 2, "B", "m2", "warning"), (1, 1, "A", "m1", "warning"), (2, 1, "E", "bad", "error"), (2, 2, "W", "w", "warning"), (5, 1, "L", "x" * 40_000, "warning")], "file_id long, issue_no int, code string, message string, severity string")
    files = spark.createDataFrame([(i, "duplicate" if i == 4 else None) for i in range(1, 6)], "file_id long, status string")
    log = {r["file_id"]: r for r in P.import_log(files, issues).collect()}
    assert [log[i]["status"] for i in range(1, 6)] == ["warning", "failed", "success", "duplicate", "warning"]
    assert log[1]["warning_code"] == "A;B" and log[1]["message"] == "m1 | m2" and log[2]["error_code"] == "E" and log[5]["message"] == "WORKBOOK_AUDIT_CELL_LIMIT"
    counts = P.batch_counts(P.import_log(files, issues)).first()
    assert (counts["success_count"], counts["failure_count"], counts["duplicate_count"], counts["outcome"]) == (3, 1, 1, "partial_success")
    assert sorted(r["file_id"] for r in P.quarantine(files, issues).collect()) == [1, 3, 4, 5]
    many = spark.createDataFrame([(f"C{i:03d}", "warning") for i in range(130)], "code string, severity string")
    shown = P.code_summary(many, "warning").first()
    assert len(shown["shown"].split("; ")) == 100 and shown["omitted"] == 30


def test_stream_rules(spark):
    good = [peak(1, k, order=k) for k in (1, 2, 3)]
    rows = good + [peak(2, 1, order=1), peak(2, 2)] + [peak(3, 1, order=1), peak(3, 2, order=3)] + [peak(4, 1, order=1), peak(4, 2, order=2, rt2=1.0, unit2="s")]
    rows += [peak(5, 1, rt2=1.0, unit2="s"), peak(5, 2, rt2=2.0, unit2="s")] + [peak(6, 1, order=1), peak(6, 2, order=2, unit="s")] + [peak(7, 1, order=1, area_unit="a"), peak(7, 2, order=2)]
    rows += [peak(8, 1, order=1, rt=float("nan")), peak(8, 2, order=2)] + [peak(9, 1), peak(9, 2, unit="s")] + [peak(10, 1, order=1, rt2=1.0, unit2="s"), peak(10, 2, order=2, rt2=1.0, unit2="m")]
    assert codes(V.stream_rules(spark.createDataFrame(rows, PEAK), ["row_no"])) == [
        (2, "PEAK_OBSERVATION_ORDER_PARTIAL"), (3, "PEAK_OBSERVATION_ORDER_INVALID"), (4, "PEAK_RETENTION_DIMENSION_MIXED"), (5, "PEAK_SECONDARY_RETENTION_ORDER_REQUIRED"),
        (6, "ORDERED_PEAK_UNIT_INVALID"), (7, "ORDERED_PEAK_UNIT_INVALID"), (8, "ORDERED_PEAK_VALUE_INVALID"), (10, "PEAK_SECONDARY_RETENTION_UNIT_INCONSISTENT"),
    ]


def test_peak_and_sample_rules(spark):
    rows = [peak(1, 1, start=0.5, end=2.0), peak(2, 1, start=1.5, end=2.0), peak(3, 1, start=0.5, end=float("nan")), peak(4, 1, rt2=1.0), peak(5, 1, rt2=float("inf"), unit2=" "), peak(6, 1, order=0)]
    assert codes(V.peak_rules(spark.createDataFrame(rows, PEAK))) == [
        (2, "PEAK_TIME_BOUNDARY_INVALID"), (3, "PEAK_TIME_BOUNDARY_INVALID"), (4, "PEAK_SECONDARY_RETENTION_PARTIAL"), (5, "PEAK_SECONDARY_RETENTION_UNIT_INVALID"), (5, "PEAK_SECONDARY_RETENTION_VALUE_INVALID"), (6, "PEAK_OBSERVATION_ORDER_INVALID"),
    ]
    sample = "file_id long, sample_id string, runtime double, acquired_at_reliable boolean, acquired_at_raw string, instrument_type string, vendor string, detectors array<string>, channels array<string>"
    samples = spark.createDataFrame([(1, "a", 1.0, True, "2026-01-01T00:00:00Z", None, None, None, None), (2, " ", float("nan"), True, "2026-01-01", "x" * 40_000, None, [], [])], sample)
    assert codes(V.sample_rules(samples)) == [(2, "ACQUIRED_AT_RELIABILITY_INVALID"), (2, "RUNTIME_NONFINITE"), (2, "SAMPLE_ID_EMPTY"), (2, "WORKBOOK_CELL_TEXT_LIMIT")]
    files = spark.createDataFrame([(1,), (2,), (3,)], "file_id long")
    assert codes(V.count_rules(files, samples.unionByName(samples.where("file_id = 2")))) == [(2, "SAMPLE_COUNT_INVALID"), (3, "SAMPLE_COUNT_INVALID")]
    children = spark.createDataFrame([(1, "a"), (1, "b")], "file_id long, sample_id string")
    assert codes(V.child_rules(children, samples, "PEAK_SAMPLE_MISMATCH")) == [(1, "PEAK_SAMPLE_MISMATCH")]
    issues = spark.createDataFrame([(1, "OK", "m", "warning", "table:row:1"), (2, "bad", "at /etc/x", "worse", None)], "file_id long, code string, message string, severity string, source string")
    assert codes(V.issue_rules(issues)) == [(2, "CANONICAL_ISSUE_CODE_INVALID"), (2, "CANONICAL_ISSUE_PRIVATE_PATH"), (2, "CANONICAL_ISSUE_SEVERITY_INVALID")]


def test_records_and_axes(spark):
    words = spark.createDataFrame([(1, i, a, w) for i, (a, w) in enumerate([(True, 100), (False, 2), (False, -1), (True, 50), (False, 5)])], "file_id long, i int, is_abs boolean, word long")
    assert [r["value"] for r in O.decode_deltas(words, ["file_id"], ["i"]).orderBy("i").collect()] == [100, 102, 103, 50, 55]
    points = spark.createDataFrame([(20, 40, k) for k in range(3)], "delay_ms int, interval_ms int, point_no int")
    assert [round(r["x"], 6) for r in O.uniform_axis(points).orderBy("point_no").collect()] == [0.000333, 0.001, 0.001667]
    faults = O.step_faults(spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, 2.0, 2.0, 3.0, 5.0])], "s int, i int, x double"), ["s"], ["i"], "x")
    assert [r["i"] for r in faults.collect()] == [2]
    blocks = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 3)], "file_id long, version int")
    got = sorted((r["file_id"], r["version"], r["contiguous"]) for r in O.latest_revision(blocks, ["file_id"]).collect())
    assert got == [(1, 2, True), (1, 2, True), (2, 3, False)]


def test_series_fingerprint(spark):
    import hashlib
    import struct

    df = spark.createDataFrame([(1, 1, 2.0, 20.0), (1, 0, 1.0, 10.0)], "s int, i int, x double, y double")
    row = S.series_fingerprints(df, ["s"], ["i"]).first()
    assert row["sha256_x"] == hashlib.sha256(struct.pack(">dd", 1.0, 2.0)).hexdigest() and row["sha256_xy"] == hashlib.sha256(struct.pack(">dddd", 1.0, 10.0, 2.0, 20.0)).hexdigest()
    scans = spark.createDataFrame([(1, 5, 2), (1, 7, 3)], "scan int, mass_raw int, intensity long")
    assert tuple(S.scan_statistics(scans, ["scan"]).first()) == (1, 5, 2, 3, 5, 7, 2)


def test_sections_and_totals(spark):
    rows = spark.createDataFrame([(1, "0.1"), (1, "0.2"), (2, "1")], "file_id long, area string")
    totals = spark.createDataFrame([(1, "0.3"), (2, "2"), (3, "1")], "file_id long, total string")
    assert sorted(r["file_id"] for r in V.section_totals(rows, totals, ["file_id"], "area", "total").collect()) == [2, 3]
    declared = spark.createDataFrame([(1, 2), (2, 2), (4, 1)], "file_id long, n long")
    assert sorted(r["file_id"] for r in V.declared_counts(rows, declared, ["file_id"]).collect()) == [2, 4]
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "file_id long, pos int, area string")
    b = spark.createDataFrame([(1, 0, "x"), (1, 1, "z"), (1, 2, "w")], "file_id long, pos int, area string")
    assert sorted(r["pos"] for r in V.paired_mismatches(a, b, ["file_id", "pos"], ["area"]).collect()) == [1, 2]


def test_routing(spark):
    files = spark.createDataFrame([(1, 0.9, 0.95), (2, 0.9, 0.8), (3, None, None), (4, 1.0, 0.95), (5, 0.5, None)], "file_id long, a double, b double")
    rules = [R.Rule("a", F.col("a").isNotNull(), F.col("a")), R.Rule("b", F.col("b").isNotNull(), F.col("b")), R.Rule("p", F.col("file_id") == 5, F.lit(0.1), private=True)]
    probes = R.probe_matrix(files, rules)
    got = {r["file_id"]: (r["adapter"], r["code"]) for r in R.best_routes(files, probes).collect()}
    assert got == {1: (None, "FORMAT_AMBIGUOUS"), 2: ("a", None), 3: (None, "FORMAT_NOT_DETECTED"), 4: ("a", None), 5: ("p", None)}
    forced = {r["file_id"]: r["adapter"] for r in R.best_routes(files, probes, forced="b").collect()}
    assert forced[1] == "b" and forced[3] is None


def drift(spark, headers, roles=True):
    profile = spark.createDataFrame([("p", "csv", ["Retention Time", "Area", "Height"])], "profile_id string, source_format string, headers array<string>")
    given = spark.createDataFrame([("p", 1, "retention_time"), ("p", 2, "area"), ("p", 3, "IGNORED")], "profile_id string, position int, role string")
    seen = spark.createDataFrame([(1, "csv", headers)], "file_id long, source_format string, headers array<string>")
    return M.drift_diagnostics(seen, profile, given if roles else None).first()


@pytest.mark.parametrize(
    ("headers", "figures", "categories"),
    [
        (["Retention Time", "Area", "Height", "New"], (3, 0, 1, 0, 0), ["column_added"]),
        (["New", "Retention Time", "Area", "Height"], (0, 0, 1, 0, 0), ["column_added"]),
        (["Retention Time", "Area"], (2, 0, 0, 1, 0), ["column_removed"]),
        (["Retention Time", "Peak Area", "Height"], (2, 1, 0, 0, 0), ["header_changed_unresolved", "required_mapping_column_missing"]),
        (["Area", "Retention Time", "Height"], (1, 0, 0, 0, 2), ["column_reordered"]),
        (["Retention Time", "Area", "Area"], (2, 1, 0, 0, 0), ["header_changed_unresolved", "duplicate_header_changed"]),
        (["a", "b"], (0, 2, 0, 1, 0), ["column_removed", "header_changed_unresolved", "required_mapping_column_missing", "incompatible_structure"]),
    ],
)
def test_drift(spark, headers, figures, categories):
    r = drift(spark, headers)
    assert (r["exact_positions"], r["changed"], r["added"], r["removed"], r["moved"]) == figures and r["categories"] == categories


def test_profiles(spark):
    profiles = spark.createDataFrame([("a", "csv", ["x", "y"]), ("b", "csv", ["x", "y"]), ("c", "tsv", ["x"])], "profile_id string, source_format string, headers array<string>")
    seen = spark.createDataFrame([(1, "csv", ["x", "y"]), (2, "tsv", ["x"]), (3, "tsv", ["x", "y"])], "file_id long, source_format string, headers array<string>")
    got = {r["file_id"]: (r["profile_id"], r["code"]) for r in R.profile_matches(seen, profiles).collect()}
    assert got == {1: (None, "AMBIGUOUS_MAPPING_PROFILE"), 2: ("c", None), 3: (None, None)}
    assert M.repair_profiles(profiles, "c", "d", ["x", "z"]).count() == 4
    with pytest.raises(ValueError):
        M.repair_profiles(profiles, "a", "d", ["x", "y"])
    columns = spark.createDataFrame([("a", 1, "retention_time"), ("a", 3, "area"), ("b", 1, "area"), ("b", 2, "area"), ("c", 1, "retention_time"), ("c", 2, "area")], "profile_id string, position int, role string")
    faults = sorted((r["profile_id"], r["fault"]) for r in M.profile_faults(columns, profiles).collect())
    assert faults == [("a", "CONTENT_REPEATED"), ("a", "POSITIONS_NOT_CONTIGUOUS"), ("b", "CONTENT_REPEATED"), ("b", "ROLE_MISSING_RETENTION_TIME"), ("b", "ROLE_REPEATED")]
    assert M.fingerprint({"b": 1, "a": "é"}, "t") == M.fingerprint({"a": "é", "b": 1}, "t")


def test_sheet_cells(spark):
    schema = "file_id long, sheet_no int, sheet_title string, sheet_state string, row_no int, col_no int, cell_type string, lexeme string, formula string, formula_cached string, style_index int, is_date boolean"
    rows = []
    for file_id, sheets in ((1, [("One", "visible")]), (2, [("One", "visible"), ("Two", "visible")]), (3, [("One", "hidden")])):
        for n, (title, state) in enumerate(sheets, 1):
            rows += [(file_id, n, title, state, 0, c, "s", h, None, None, None, False) for c, h in enumerate(("area", "compound", "rt"), 1)]
            rows += [(file_id, n, title, state, 1, 1, "n", "5", "A1+1" if file_id == 1 else None, "5", 3, False), (file_id, n, title, state, 1, 2, "b", "1", None, None, None, False), (file_id, n, title, state, 1, 3, "n", "44000", None, None, None, True)]
    cells = spark.createDataFrame(rows, schema)
    got = {r["file_id"]: (r["sheet_no"], r["code"]) for r in C.chosen_sheet(cells).collect()}
    assert got == {1: (1, None), 2: (None, "SHEET_AMBIGUOUS"), 3: (None, "SHEET_NOT_FOUND")}
    assert C.chosen_sheet(cells, "Two").where("file_id = 2").first()["sheet_no"] == 2
    one = cells.where("file_id = 1")
    headers = one.where("row_no = 0").select("file_id", "col_no", F.col("lexeme").alias("header"))
    policy = {r["col_no"]: (r["taken"], r["code"]) for r in C.typed_cell_policy(one.where("row_no = 1"), headers).collect()}
    assert policy == {1: (None, "FORMULA_NOT_EVALUATED"), 2: (None, "CELL_TYPE_MISMATCH"), 3: (None, "CELL_TYPE_MISMATCH")}
    facts = {(r["source"], r["key"]): r["value"] for r in C.cell_provenance(one.where("row_no = 1")).collect()}
    assert facts["sheet:1:cell:A2", "formula"] == "A1+1" and facts["sheet:1:cell:C2", "is_date"] == "true"


def test_plans(spark):
    files = spark.createDataFrame([(1, "a.csv", 10, "h1", None, False), (2, "b.csv", 20, "h2", None, False), (3, "a.csv", 10, "h1", 1, False)], "file_id long, relative_path string, size long, sha256 string, duplicate_of long, excluded boolean")
    routes = spark.createDataFrame([(1, "generic_csv", None), (2, None, "FORMAT_AMBIGUOUS"), (3, None, None)], "file_id long, adapter string, code string")
    entries = planning.plan_entries(files, routes)
    got = [(r["status"], r["route"], r["problem"], r["adapter"]) for r in entries.orderBy("file_id").collect()]
    assert got == [("ROUTABLE", "EXACT_ADAPTER", None, "generic_csv"), ("FAILED", None, "ADAPTER_AMBIGUOUS", None), ("DUPLICATE", None, "DUPLICATE_INPUT", None)]
    told = planning.summarise_plan(entries).first()
    assert (told["readiness"], told["total_inputs"], told["exact_adapters"], told["ambiguous"], told["duplicates"], told["total_bytes"]) == ("READY_WITH_KNOWN_FAILURES", 3, 1, 1, 1, 40)
    assert planning.plan_digest(entries, {"a": 1}) == planning.plan_digest(entries.repartition(3), {"a": 1}) != planning.plan_digest(entries, {"a": 2})
    later = entries.withColumn("sha256", F.when(F.col("file_id") == 2, "new").otherwise(F.col("sha256"))).where("file_id <> 3")
    assert sorted((r["file_id"], r["change"]) for r in planning.plan_changes(entries, later).collect()) == [(2, "changed"), (3, "removed")]
    with pytest.raises(ValueError):
        planning.Recipe().merged(sort="filename")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("=1", 1.0), ("-5", float("nan")), ("ok", 2.0)], "t string, v double")
    seen = P.write_csv_part(rows, f"{tmp_path}/out")
    assert seen == {"row_count": 3, "formula_escape_count": 1}
    assert sorted(r["t"] for r in spark.read.csv(f"{tmp_path}/out", header=True).collect()) == ["'=1", "-5", "ok"]
    assert P.part_digests(spark, f"{tmp_path}/out").count() >= 1
    with pytest.raises(Exception, match="exist"):
        P.write_csv_part(rows, f"{tmp_path}/out")
    assert tuple(P.numeric_safety(rows).first()) == (2, 1, 0)
    assert {r["column"]: r["to_csv"] for r in P.overlong_columns(rows).collect()} == {"t": False}
    assert P.cell_audit(rows).first()["n_bad"] == 0
    files = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "relative_path string, size long, sha256 string")
    assert P.file_set_digest(files).first() == P.file_set_digest(files.orderBy(F.desc("size"))).first()


@pytest.mark.parametrize("name", ["order_matrix_1d", "order_matrix_2d"])
def test_order_matrix_queries_return_every_peak(spark, name):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    folder = f"{entry.TESTDATA}/sf0.001"
    con = duckdb.connect()
    for table in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    got = entry.queries()[f"{name}_long"](spark, folder)
    want = con.execute(entry.oracle_sql()[f"{name}_long"])
    assert got.columns == [d[0] for d in want.description]
    rows = collections.Counter(tuple(r) for r in got.collect())
    assert rows == collections.Counter(want.fetchall())
    assert max(r[3] for r in rows) > 3
    wide = entry.queries()[name](spark, folder).collect()
    assert sum(rows.values()) == sum(r["n_peaks"] for r in wide)
