"""Text functions and strict typing against plain-Python models."""

from __future__ import annotations

import math
import random
import re
from decimal import Decimal, InvalidOperation

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import lexemes as L
from tallyloom.functions import text as T


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def results(df, expr):
    return [r["r"] for r in df.select("i", expr.alias("r")).orderBy("i").collect()]


def test_natural_order(spark):
    rng = random.Random(1)
    names = ["sample_1", "sample_2", "sample_10", "Sample_2b", "2a", "10a", "a", "", "007", "7", "a01b", "a1b"]
    names += ["".join(rng.choice("abB019_. ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    model = lambda s: [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", s.lower()) if p or True]
    rows = column(spark, names)
    got = [r["x"] for r in rows.orderBy(T.natural_key(F.col("x")), "x").collect()]
    assert [model(a) for a in got] == sorted(model(n) for n in names)


@pytest.mark.parametrize("text", ["plain", "a~b", "_x0041_", "__x000D__", "tab\tok\nok", "bell\x07", "cr\r", "\ufdd0", "\U0001fffe", "~~u000041;"])
def test_audit_display_round_trip(spark, text):
    df = column(spark, [text])
    shown = results(df, T.audit_display(F.col("x")))[0]
    assert results(column(spark, [shown]), T.audit_restore(F.col("x"))) == [text]
    assert results(column(spark, [shown]), T.text_is_exact(F.col("x"))) == [True]


def test_exact_text(spark):
    values = ["ok", "a\rb", "\x00", "_X00aF_", "_x12_", "￾", "é🙂"]
    assert results(column(spark, values), T.text_is_exact(F.col("x"))) == [True, False, False, False, True, False, True]
    assert results(column(spark, ["a" * 32_767, "a" * 32_768]), T.cell_text_is_exact(F.col("x"))) == [True, False]


def test_preview_display(spark):
    assert results(column(spark, ["a\u200bb\tc", "ok"]), T.preview_display(F.col("x"))) == ["a\\u200Bb\\u0009c", "ok"]


def test_local_paths(spark):
    inside = ["q:'x C:y", "http://h/c:d", "(\\x", "\\\\h\\s http://a", "/http://x", "a:/http://x", "FILE:", "x+file://", "http:// /x", "é/x", "C:\\data\\x", "at D:/x now", "\\\\host\\share", "\\root", "/etc/passwd", "see (/tmp/x)", "file:a", "s3://bucket/a"]
    outside = ["plain text", "a/b", "http://host/a/b", "https://host/x?y=/z", "ratio 1/2", "key: value", "12:30", "", "/", "\\\\h", "ab\\c", "x:", "1http://a/b", "HTTPS://a//b", "a\\\\b", "myfile:x", "http://", "_/a"]
    assert results(column(spark, inside), T.has_local_path(F.col("x"))) == [True] * len(inside)
    assert results(column(spark, outside), T.has_local_path(F.col("x"))) == [False] * len(outside)
    assert results(column(spark, ["/tmp/x", "x"]), T.scrub_local_path(F.col("x"))) == [T.PATH_PLACEHOLDER, "x"]


def test_locators(spark):
    values = ["table:row:3", "table:row:3:column:2", "sheet:1:cell:AB12", "canonical:a.b", "relative/name", "sheet:1:cell:AB12:x", "mailto:x", "/abs", "a\x01", "sheet:1:cell:A01", "canonical:", ":row:3", "a?b:row:3"]
    assert results(column(spark, values), T.locator_is_unsafe(F.col("x"))) == [False] * 5 + [True] * 8


def test_codes_bounds_and_names(spark):
    assert results(column(spark, ["A_1", "a", "1A", "A" * 65, "A\n", "", "A" * 64, "_A"]), T.issue_code_is_valid(F.col("x"))) == [True, False, False, False, False, False, True, False]
    assert results(column(spark, ["1" * 1000, "0" * 9 + "1" * 1000, "1" * 1001]), T.integer_within_bound(F.col("x"))) == [True, True, False]
    assert T.dataset_names(["Peaks", "peaks", "a/b", "history", "x" * 40, "x" * 40]) == ["Peaks", "peaks_2", "a_b", "History_", "x" * 31, "x" * 29 + "_2"]
    assert results(column(spark, [" R-T  min ", "Peak\tNo", "ÄREA"]), T.normal_header(F.col("x"))) == ["r_t_min", "peak_no", "ärea"]
    assert results(column(spark, ["a/B.CSV", "x.tar.gz", ".hidden", "none"]), T.extension(F.col("x"))) == [".csv", ".gz", "", ""]
    assert results(column(spark, ["=1+1", "-5", "-x", "+1e3", "@a", "a"]), T.formula_safe(F.col("x"))) == ["'=1+1", "-5", "'-x", "+1e3", "'@a", "a"]


def test_matrix_names(spark):
    df = spark.createDataFrame([(0, "a b", None, None), (1, "a]b", "é", None)], "i int, c string, d string, h string")
    got = results(df, T.matrix_base(F.col("c"), F.col("d"), F.col("h")))
    assert got == ["a b_area", "q[compound=a%5Db][detector=%C3%A9][channel=]_area"]


def float_model(text):
    text = (text or "").strip()
    if not text:
        return None, None
    try:
        number, exact = float(text), Decimal(text)
    except (ValueError, InvalidOperation):
        return None, "INVALID_NUMBER"
    if not math.isfinite(number):
        return (None, "LOSSY_FLOAT_REJECTED") if exact.is_finite() else (number, "NONFINITE_NUMBER")
    return (number, None) if exact == Decimal(str(number)) else (None, "LOSSY_FLOAT_REJECTED")


def lexemes():
    rng = random.Random(2)
    out = ["1", "1.5", " 2 ", "", "  ", None, "1e23", "1_000", "NaN", "-inf", "1e400", "0.1000000000000000055", "3.0", "3e2", "1d", "+7", "0x10", "1e", "--1", ".5", "5.", "-0", "0e9999", "1e-400"]
    out += ["1" * n for n in (15, 16, 17, 38, 39, 1000, 1001, 4097)]
    for _ in range(300):
        body = "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 22)))
        k = rng.randint(0, len(body))
        out.append(rng.choice(["", "-", "+"]) + body[:k] + rng.choice(["", "."]) + body[k:] + rng.choice(["", "", f"e{rng.randint(-30, 30)}"]))
    return out


def test_exact_float(spark):
    values = lexemes()
    got = results(column(spark, values), L.exact_float(F.col("x")))
    for text, r in zip(values, got, strict=True):
        want = float_model(text)
        same = r["value"] == want[0] or (want[0] is not None and math.isnan(want[0]))
        assert same and r["code"] == want[1], (text, r, want)


def integer_model(text):
    if text is None or not text.strip():
        return None, None
    if len(text) > 4096:
        return None, "INTEGER_LIMIT_EXCEEDED"
    try:
        n = Decimal(text.strip())
    except InvalidOperation:
        return None, "INVALID_NUMBER"
    if not n.is_finite():
        return None, "NONFINITE_NUMBER"
    if abs(n.as_tuple().exponent) > 1000 or (n and n.adjusted() >= 1000):
        return None, "INTEGER_LIMIT_EXCEEDED"
    if n != n.to_integral_value():
        return None, "INVALID_INTEGER"
    return (int(n), None) if abs(int(n)) < 10**38 else (None, "INTEGER_BEYOND_DECIMAL")


def test_bounded_integer(spark):
    values = lexemes()
    got = results(column(spark, values), L.bounded_integer(F.col("x")))
    for text, r in zip(values, got, strict=True):
        want = integer_model(text)
        assert (None if r["value"] is None else int(r["value"]), r["code"]) == want, (text, r)


def test_iso_timestamp(spark):
    cases = {
        "2026-01-01T01:00:00Z": (True, None), "2026-01-01T01:00:00+09:00": (True, None), "2026-01-01 01:00": (False, "TIMESTAMP_TIMEZONE_MISSING"), "2026-01-01": (False, "TIMESTAMP_TIMEZONE_MISSING"),
        "20260101T010000": (False, "TIMESTAMP_TIMEZONE_MISSING"), "2026-W01-1": (False, "TIMESTAMP_TIMEZONE_MISSING"), "2026": (False, "INVALID_TIMESTAMP"), "2026-1-1": (False, "INVALID_TIMESTAMP"),
        "2026-02-30": (False, "INVALID_TIMESTAMP"), "0001-01-01T00:00:00+10:00": (False, "ACQUIRED_AT_UTC_RANGE_UNORDERABLE"), "": (False, None), "T01:00": (False, "INVALID_TIMESTAMP"),
    }
    got = results(column(spark, list(cases)), L.iso_timestamp(F.col("x")))
    assert [(r["reliable"], r["code"]) for r in got] == list(cases.values())
    assert got[1]["value"].isoformat() == "2025-12-31T16:00:00"


def test_text_rules(spark):
    df = column(spark, ["a ", " ", "", None])
    assert [tuple(r) for r in results(df, L.mapped_text(F.col("x")))] == [("a ", None), (None, "MAPPED_TEXT_WHITESPACE_ONLY"), (None, None), (None, None)]
    assert [r["code"] for r in results(df, L.strict_text(F.col("x"), True))] == [None] + ["PEAK_MAPPING_VALUE_MISSING"] * 3
    nums = column(spark, ["1", "x", "inf", "0.1000000000000000055", ""])
    codes = [None, "PEAK_MAPPING_NUMBER_INVALID", "PEAK_MAPPING_NUMBER_NONFINITE", "PEAK_MAPPING_NUMBER_LOSSY", "PEAK_MAPPING_VALUE_MISSING"]
    assert [r["code"] for r in results(nums, L.strict_number(F.col("x"), True))] == codes
    assert [r["value"] for r in results(column(spark, ["1.5", "-1", "1e3", None]), L.vendor_decimal(F.col("x")))] == [1.5, None, None, None]
