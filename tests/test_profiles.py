"""Profiles of a set: every rule of the reference's own check has its fault."""

from __future__ import annotations

import collections

import pytest

from tallyloom.operators import mapping as M

COLUMNS = "profile_id string, position int, role string"
PROFILES = "set_id string, profile_id string, source_format string, headers array<string>, retention_time_unit string, secondary_retention_time_unit string, height_unit string, worksheet_title string"


def test_every_rule_of_a_profile_is_checked(spark):
    good = [(1, "retention_time"), (2, "area")]
    columns = {
        "ok": good, "two": [*good, (3, "secondary_retention_time")], "unit": good, "height": good, "blank": good, "title": good, "sheet": good, "zero": [(0, "retention_time"), (2, "area"), (3, "height")],
        "odd": [*good, (3, "colour")], "twice": good,
    }
    rows = [(p, *c) for p, cs in columns.items() for c in cs]
    head = lambda p, s="s", f="csv", rt="min", second=None, height=None, title=None, h=None: (s, p, f, [h or p], rt, second, height, title)
    profiles = [
        head("ok"), head("two"), head("unit", second="s"), head("height", height="mV"), head("blank", rt=" "), head("title", title="One"), head("sheet", f="xlsx", title="One"), head("zero"), head("odd"),
        head("none"), head("twice"), head("twice", h="other"), head("ok", "t"),
    ]
    profiles += [head(f"x{i}", "large") for i in range(33)] + [head(f"y{i}", "full") for i in range(32)]
    rows += [(f"{c}{i}", *x) for c in "xy" for i in range(33) for x in good]
    found = [tuple(r) for r in M.profile_faults(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(profiles, PROFILES)).collect()]
    assert sorted(r for r in found if not r[0].startswith("x")) == sorted([
        ("two", "SECONDARY_UNIT_UNPAIRED"), ("unit", "SECONDARY_UNIT_UNPAIRED"), ("height", "HEIGHT_UNIT_WITHOUT_COLUMN"), ("blank", "RETENTION_TIME_UNIT_MISSING"),
        ("title", "WORKSHEET_TITLE_OUTSIDE_WORKBOOK"), ("zero", "POSITIONS_NOT_CONTIGUOUS"), ("odd", "ROLE_UNKNOWN"), ("none", "ROLE_MISSING_RETENTION_TIME"), ("none", "ROLE_MISSING_AREA"),
        ("twice", "PROFILE_ID_REPEATED"),
    ])
    assert sorted(r for r in found if r[0].startswith("x")) == sorted((f"x{i}", "SET_TOO_LARGE") for i in range(33))


def test_the_query_reaches_every_fault(spark):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    folder = f"{entry.TESTDATA}/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet')")
    want = collections.Counter(con.execute(entry.oracle_sql()["profile_faults"]).fetchall())
    assert collections.Counter(tuple(r) for r in entry.queries()["profile_faults"](spark, folder).collect()) == want
    assert len({f for _, f in want}) == 11 and want
