"""Summaries after a conversion or a plan: result counts, route counts, occurrence maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T

#: Suffixes that tables of a mapped format may have (fixed values).
SUFFIXES = {"csv": (".csv",), "tsv": (".tsv", ".txt"), "semicolon": (".txt",), "xlsx": (".xlsx",)}
CONVERTED = ("success", "warning")


def result_summary(files: DataFrame, samples: DataFrame, peaks: DataFrame, series: DataFrame) -> DataFrame:
    """One row of ten counters. Records count where their file was converted; ``series`` has one row
    for each series with its ``series_kind``."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    sources = files.agg(
        F.count("*").alias("total_sources"), n(*CONVERTED).alias("converted_sources"), n("warning").alias("warning_sources"), n("failed").alias("failed_sources"),
        n("skipped").alias("skipped_sources"), n("duplicate").alias("duplicate_sources"),
    )
    # Each table's rows are counted by file before they meet the files.
    kind = lambda k: F.count_if(F.col("series_kind") == k)
    parts = [
        samples.groupBy("file_id").agg(F.count("*").alias("sample_records")),
        peaks.groupBy("file_id").agg(F.count("*").alias("peak_records")),
        series.groupBy("file_id").agg(kind("SCIENTIFIC_SIGNAL").alias("scientific_signal_series"), kind("DECODED_RECORDS").alias("structural_record_series")),
    ]
    held = files.where(F.col("status").isin(*CONVERTED)).select("file_id").distinct()
    names = ["sample_records", "peak_records", "scientific_signal_series", "structural_record_series"]
    for part in parts:
        held = held.join(part, "file_id", "left")
    records = held.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return sources.join(F.broadcast(records), F.lit(True))


def occurrence_maximum(peaks: DataFrame, identity: tuple[str, ...] = ("compound", "detector", "channel")) -> DataFrame:
    """The identity columns and ``maximum``: how often an identity stands in one file at most. Peaks
    without a compound don't count; missing detectors and channels are values of their own."""
    named = peaks.where(F.coalesce(F.col(identity[0]), F.lit("")) != "")
    return named.groupBy("file_id", *identity).agg(F.count("*").alias("n")).groupBy(*identity).agg(F.max("n").alias("maximum"))


def route_counts(routes: DataFrame) -> DataFrame:
    """One row: files by route (``mapping_route``, ``mapping_profile_id``) and how many profiles were used."""
    route = F.col("mapping_route")
    return routes.agg(
        F.count_if(route == "EXACT_ADAPTER").alias("exact_adapter_routes"),
        F.count_distinct(F.when(route == "USER_MAPPING_PROFILE", F.col("mapping_profile_id"))).alias("mapping_profiles_used"),
        F.count_if(route == "NO_MAPPING_MATCH").alias("unmapped_tables"), F.count_if(route == "SCHEMA_DRIFT_CANDIDATE").alias("drift_candidates"),
        F.count_if(route.isin("AMBIGUOUS_MAPPING_PROFILE", "AMBIGUOUS_WORKSHEET")).alias("ambiguous_tables"),
    )


def candidate_formats(path: Column, requested: tuple[str, ...]) -> Column:
    """The requested formats that a path's suffix allows, as an array: only those are probed."""
    suffix = T.extension(path)
    return F.array_compact(F.array(*[F.when(suffix.isin(*s), F.lit(name)) for name, s in SUFFIXES.items() if name in requested] or [F.lit(None).cast("string")]))


def plan_problem(route: Column, code: Column, path: Column) -> Column:
    """Why a file of a plan can't be routed, by its mapping route and error code; null without a code."""
    table = T.extension(path).isin(*{s for group in SUFFIXES.values() for s in group})
    return F.when(code.isNull(), None).otherwise(
        F.when(route == "SCHEMA_DRIFT_CANDIDATE", "MAPPING_SCHEMA_DRIFT")
        .when((route == "NO_MAPPING_MATCH") & table, "UNMAPPED_GENERIC_TABLE")
        .when(route == "AMBIGUOUS_MAPPING_PROFILE", "MAPPING_PROFILE_AMBIGUOUS")
        .when(route == "AMBIGUOUS_WORKSHEET", "WORKSHEET_AMBIGUOUS")
        .when((route == "NO_MAPPING_MATCH") | (code == "FORMAT_NOT_DETECTED"), "UNSUPPORTED_FORMAT")
        .when(code.contains("AMBIGUOUS"), "ADAPTER_AMBIGUOUS")
        .otherwise("MALFORMED_INPUT")
    )


def plan_counts(entries: DataFrame) -> DataFrame:
    """One row of fourteen counters over plan entries (``status, route, problem``)."""
    status, route, problem = (F.col(c) for c in ("status", "route", "problem"))
    count = lambda test, name: F.count_if(test).alias(name)
    return entries.agg(
        F.count("*").alias("total_inputs"), count(status == "ROUTABLE", "routable"), count(route == "EXACT_ADAPTER", "exact_adapters"), count(route == "USER_MAPPING", "user_mappings"),
        count(route == "USER_MAPPING_PROFILE", "mapping_profiles"), count(route == "GENERIC_INPUT", "generic_inputs"), count(problem == "MAPPING_SCHEMA_DRIFT", "drifted"),
        count(problem == "UNMAPPED_GENERIC_TABLE", "unmapped"), count(problem.isin("MAPPING_PROFILE_AMBIGUOUS", "WORKSHEET_AMBIGUOUS", "ADAPTER_AMBIGUOUS"), "ambiguous"),
        count(problem == "UNSUPPORTED_FORMAT", "unsupported"), count(problem == "MALFORMED_INPUT", "malformed"), count(status == "DUPLICATE", "duplicates"),
        count(status == "EXCLUDED_ARTIFACT", "excluded_artifacts"), count(status == "FAILED", "failed"),
    )


def cell_text(value: Column, kind: str) -> Column:
    """A typed value as a cell's text: times in ISO 8601 with their offset (UTC) and no fraction where it
    is zero, truth values as True and False, integers digit by digit."""
    if kind.startswith("timestamp"):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.unix_micros(value) % 1_000_000
        micros = F.when(micros < 0, micros + 1_000_000).otherwise(micros)
        return F.concat(whole, F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("+00:00"))
    if kind == "boolean":
        return F.when(value, "True").when(~value, "False")
    return value.cast("string")
