"""Constraint validation: one issue row for each violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tallyloom.functions import text as T

ISSUE = ("file_id", "code", "source")
STREAM = ("file_id", "sample_id", "source_file", "detector", "channel")


def blank(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "") == ""


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & ~value.isin(float("inf"), float("-inf"))


def violations(rows: DataFrame, rules: list[tuple[str, Column]], source: str | None = None) -> DataFrame:
    """Issue rows of row-level rules ``(code, violated)``, in one pass over the rows."""
    found = F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]), lambda c: c.isNotNull())
    where = F.col(source) if source else F.lit(None).cast("string")
    return rows.select("file_id", F.explode(found).alias("code"), where.alias("source"))


def schema_faults(df: DataFrame, expected: StructType) -> list[tuple[str, str, str | None]]:
    """Columns of ``expected`` that a table lacks or holds in another type."""
    types = dict(df.dtypes)
    return [(f.name, f.dataType.simpleString(), types.get(f.name)) for f in expected if types.get(f.name) != f.dataType.simpleString()]


def issue_rules(issues: DataFrame) -> DataFrame:
    """Issues about issues: severity, code, length and exactness of texts, and local paths."""
    text = F.concat_ws(" ", "code", "message", "source")
    return violations(
        issues,
        [
            ("CANONICAL_ISSUE_SEVERITY_INVALID", ~F.coalesce(F.col("severity").isin("warning", "error", "info"), F.lit(False))),
            ("CANONICAL_ISSUE_CODE_INVALID", ~F.coalesce(T.issue_code_is_valid(F.col("code")), F.lit(False))),
            ("CANONICAL_ISSUE_CELL_LIMIT", F.length(text) > T.MAX_CELL_CHARACTERS),
            ("CANONICAL_ISSUE_TEXT_UNREPRESENTABLE", ~T.text_is_exact(text)),
            ("CANONICAL_ISSUE_PRIVATE_PATH", T.has_local_path(text)),
        ],
    )


def count_rules(files: DataFrame, samples: DataFrame) -> DataFrame:
    """Files with other than exactly one sample."""
    n = samples.groupBy("file_id").agg(F.count("*").alias("n"))
    joined = files.select("file_id").join(n, "file_id", "left").where(F.coalesce("n", F.lit(0)) != 1)
    return joined.select("file_id", F.lit("SAMPLE_COUNT_INVALID").alias("code"), F.lit(None).cast("string").alias("source"))


def text_rules(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One issue for each text cell that can't be held exactly."""
    cells = F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("v")) for c in columns])
    held = rows.select("file_id", F.inline(cells)).where(~T.text_is_exact(F.col("v")))
    return held.select("file_id", F.lit("WORKBOOK_TEXT_UNREPRESENTABLE").alias("code"), "source")


def sample_rules(samples: DataFrame) -> DataFrame:
    """Rules on samples: id, runtime, reliability of the time, lengths of mandatory cells."""
    long = reduce(lambda a, b: a | b, [F.coalesce(F.length(c) > T.MAX_CELL_CHARACTERS, F.lit(False)) for c in ("sample_id", "instrument_type", "vendor")])
    lists = F.length(F.array_join(F.concat(F.coalesce("detectors", F.array().cast("array<string>")), F.coalesce("channels", F.array().cast("array<string>"))), "; "))
    return violations(
        samples,
        [
            ("SAMPLE_ID_EMPTY", F.coalesce(blank(F.col("sample_id")), F.lit(True))),
            ("RUNTIME_NONFINITE", F.col("runtime").isNotNull() & ~finite(F.col("runtime"))),
            ("ACQUIRED_AT_RELIABILITY_INVALID", F.col("acquired_at_reliable") & ~F.coalesce(F.col("acquired_at_raw").rlike(r"(Z|[+\-][0-9]{2}:?[0-9]{2})$"), F.lit(False))),
            ("WORKBOOK_CELL_TEXT_LIMIT", long | (lists > T.MAX_CELL_CHARACTERS)),
        ],
        "sample_id",
    )


def child_rules(children: DataFrame, samples: DataFrame, code: str) -> DataFrame:
    """Children whose sample id differs from their file's sample."""
    parent = samples.select("file_id", F.col("sample_id").alias("parent_id"))
    wrong = children.join(parent, "file_id").where(F.col("sample_id") != F.col("parent_id"))
    return wrong.select("file_id", F.lit(code).alias("code"), F.col("sample_id").alias("source"))


def peak_rules(peaks: DataFrame) -> DataFrame:
    """Row-level rules on peaks; NaN breaks an order of times as it does in plain comparison."""
    second, unit = F.col("secondary_retention_time"), F.col("secondary_retention_time_unit")
    start, at, end = (F.col(c).cast("double") for c in ("start_time", "retention_time", "end_time"))
    known = start.isNotNull() & at.isNotNull() & end.isNotNull()
    inside = (start <= at) & (at <= end) & ~F.isnan(start) & ~F.isnan(at) & ~F.isnan(end)
    return violations(
        peaks,
        [
            ("PEAK_OBSERVATION_ORDER_INVALID", F.col("observation_order") < 1),
            ("PEAK_SECONDARY_RETENTION_PARTIAL", second.isNull() != unit.isNull()),
            ("PEAK_SECONDARY_RETENTION_VALUE_INVALID", second.isNotNull() & ~finite(second)),
            ("PEAK_SECONDARY_RETENTION_UNIT_INVALID", blank(unit)),
            ("PEAK_TIME_BOUNDARY_INVALID", known & ~inside),
        ],
        "source_file",
    )


def stream_rules(peaks: DataFrame, place: list[str]) -> DataFrame:
    """Rules on whole streams (file, sample, source, detector, channel; nulls group together)."""
    line = Window.partitionBy(*STREAM).orderBy(*place)
    rows = peaks.withColumn("__at", F.row_number().over(line))
    two = F.col("secondary_retention_time").isNotNull() | F.col("secondary_retention_time_unit").isNotNull()
    ordered = F.col("observation_order").isNotNull()
    no_unit = lambda c: F.coalesce(blank(F.col(c)), F.lit(True))
    s = rows.groupBy(*STREAM).agg(
        F.bool_or(two).alias("any2"), F.bool_and(two).alias("all2"), F.bool_or(ordered).alias("any_o"), F.bool_and(ordered).alias("all_o"),
        F.bool_or(no_unit("secondary_retention_time_unit")).alias("bad_u2"), F.min("secondary_retention_time_unit").alias("u2a"), F.max("secondary_retention_time_unit").alias("u2b"),
        F.bool_and(F.coalesce(F.col("observation_order") == F.col("__at"), F.lit(False))).alias("in_order"),
        F.bool_or(~finite(F.col("retention_time").cast("double"))).alias("bad_rt"), F.bool_or(~finite(F.col("area").cast("double"))).alias("bad_area"),
        F.bool_or(no_unit("retention_time_unit")).alias("bad_ru"), F.min("retention_time_unit").alias("rua"), F.max("retention_time_unit").alias("rub"),
        F.bool_or(F.coalesce(blank(F.col("area_unit")), F.lit(False))).alias("blank_au"), F.count("area_unit").alias("n_au"), F.count("*").alias("n"),
        F.min("area_unit").alias("aua"), F.max("area_unit").alias("aub"),
    )
    judged = F.col("any_o") | F.col("all2")
    goes_on = judged & (F.col("all_o") | F.col("all2"))
    mixed_area = F.col("blank_au") | ((F.col("n_au") > 0) & (F.col("n_au") < F.col("n"))) | F.coalesce(F.col("aua") != F.col("aub"), F.lit(False))
    return violations(
        s,
        [
            ("PEAK_RETENTION_DIMENSION_MIXED", F.col("any2") & ~F.col("all2")),
            ("PEAK_SECONDARY_RETENTION_UNIT_INCONSISTENT", F.col("all2") & (F.col("bad_u2") | (F.col("u2a") != F.col("u2b")))),
            ("PEAK_OBSERVATION_ORDER_PARTIAL", F.col("any_o") & ~F.col("all_o") & ~F.col("all2")),
            ("PEAK_SECONDARY_RETENTION_ORDER_REQUIRED", F.col("all2") & ~F.col("all_o")),
            ("PEAK_OBSERVATION_ORDER_INVALID", judged & F.col("all_o") & ~F.col("in_order")),
            ("ORDERED_PEAK_VALUE_INVALID", goes_on & F.col("bad_rt")),
            ("ORDERED_PEAK_VALUE_INVALID", goes_on & F.col("bad_area")),
            ("ORDERED_PEAK_UNIT_INVALID", goes_on & (F.col("bad_ru") | (F.col("rua") != F.col("rub")))),
            ("ORDERED_PEAK_UNIT_INVALID", goes_on & mixed_area),
        ],
        "source_file",
    )


def signal_rules(series: DataFrame) -> DataFrame:
    """Rules on series held as arrays ``x, y``."""
    kind = F.coalesce(F.col("series_kind").isin("scientific_signal", "decoded_records"), F.lit(False))
    return violations(series, [("SIGNAL_SERIES_KIND_INVALID", ~kind), ("SIGNAL_LENGTH_MISMATCH", F.size("x") != F.size("y"))])


def metadata_rules(metadata: DataFrame) -> DataFrame:
    known = F.coalesce(F.col("value_type").isin("null", "text", "boolean", "integer", "float", "timestamp"), F.lit(False))
    return violations(metadata, [("METADATA_VALUE_TYPE_INVALID", ~known), ("METADATA_SOURCE_UNSAFE", T.locator_is_unsafe(F.col("source")))], "source")


def integer_rules(rows: DataFrame, columns: list[str]) -> DataFrame:
    bad = [("INTEGER_LIMIT_EXCEEDED", ~T.integer_within_bound(F.col(c))) for c in columns]
    return violations(rows, bad)


def all_issues(parts: list[DataFrame]) -> DataFrame:
    """The parts' issues as errors, numbered in each file by code and source."""
    union = reduce(DataFrame.unionByName, parts)
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("code", "source"))
    return union.withColumn("severity", F.lit("error")).withColumn("message", F.col("code")).withColumn("issue_no", number)


def section_totals(rows: DataFrame, totals: DataFrame, key: list[str], value: str, stated: str) -> DataFrame:
    """Sections whose exact decimal sum differs from the stated total, or that lack one."""
    sums = rows.groupBy(*key).agg(F.sum(F.col(value).cast("decimal(28,9)")).alias("computed"), F.count("*").alias("n_rows"))
    joined = sums.join(totals.select(*key, F.col(stated).cast("decimal(28,9)").alias("stated")), key, "full")
    return joined.where(~F.col("computed").eqNullSafe(F.col("stated")))


def declared_counts(rows: DataFrame, declared: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose number of rows differs from the declared ``n``."""
    have = rows.groupBy(*key).agg(F.count("*").alias("found"))
    joined = declared.join(have, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.where(F.col("found") != F.col("n"))


def outside_range(rows: DataFrame, points: DataFrame, key: list[str], at: str, x: str = "x") -> DataFrame:
    """Rows whose place lies outside the range of their file's points."""
    span = points.groupBy(*key).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    return rows.join(span, key).where(~F.col(at).between(F.col("x_min"), F.col("x_max")))


def paired_mismatches(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Positions where two row lists differ in a column, or one of them has no row."""
    a = left.select(*key, F.struct(*columns).alias("a"))
    b = right.select(*key, F.struct(*columns).alias("b"))
    return a.join(b, key, "full").where(~F.col("a").eqNullSafe(F.col("b")))


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose size or hash changed between two listings, or that went."""
    b = after.select("path", F.col("size").alias("size_after"), F.col("sha256").alias("sha256_after"))
    same = F.col("size").eqNullSafe(F.col("size_after")) & F.col("sha256").eqNullSafe(F.col("sha256_after"))
    out = before.join(b, "path", "left").where(~same)
    return out.withColumn("code", F.lit("INPUT_CHANGED_DURING_PARSE"))
