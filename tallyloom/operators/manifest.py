"""The manifest of a published set: what was read, how, and what was written, as key and value rows.

All figures are one-row aggregates over files, issues and the measures of the writes, so what comes to the
driver is a few numbers whatever the batch; the manifest itself has some fifty rows and one for each CSV part.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import tables as P

VERSION = "0.3"
#: Statements that the manifest makes about the output (fixed texts of this library).
POLICIES = {
    "conversion_options_policy": "All options that change a result, as they were for this run.",
    "source_display_policy": "Source names that a cell can't hold are escaped reversibly; inputs and their digests are unchanged.",
    "literal_string_policy": "Texts are written as texts; nothing becomes a formula or a link.",
    "exact_integer_policy": "Integers over 15 digits are kept digit by digit.",
}
MAX_CODES = 100
#: Options in the order in which they are told, with what stands for none (fixed values).
OPTIONS = {
    "recursive": "False", "extensions": "<all>", "sort": "auto", "include_signals": "False", "adapter": "<auto>", "sheet": "<auto>", "include_hidden_sheets": "False", "on_error": "continue",
    "overwrite": "False", "sidecar_mode": "error", "output_name": "",
}
SCHEMA = "key string, value string, path string, row_count long, sha256 string, formula_escape_count long"


def _told(value: object, otherwise: str) -> str:
    if value is None or value == "" or value == [] or value == ():
        return otherwise
    return "; ".join(value) if isinstance(value, (list, tuple)) else str(value)


def manifest_rows(
    files: DataFrame, issues: DataFrame, results: DataFrame, decision: DataFrame, written: DataFrame, parts: DataFrame, options: dict, extra: dict | None = None,
    generated_at: datetime | None = None, execution_mode: str = "convert",
) -> DataFrame:
    """``key, value, path, row_count, sha256, formula_escape_count`` in a fixed order.

    ``results`` are the counters of ``summary.result_summary``, ``written`` and ``parts`` what ``publish.write_tables`` gives. ``extra`` has keys that
    stand only where they apply: fingerprints of mappings, of a reviewed plan and of a recipe. No paths of inputs are in it.
    """
    spark = files.sparkSession
    counts = results.first()
    sort = decision.first()
    w = written.agg(
        F.array_join(F.sort_array(F.collect_list("table")), "; ").alias("tables"), F.coalesce(F.sum("formula_like"), F.lit(0)).alias("formula_like"), F.coalesce(F.sum("non_finite"), F.lit(0)).alias("non_finite"),
        F.coalesce(F.sum("exact_integers"), F.lit(0)).alias("exact_integers"), F.coalesce(F.bool_or("sidecar"), F.lit(False)).alias("split"),
    ).first()
    name = F.coalesce("public_id", "relative_path") if "public_id" in files.columns else F.col("relative_path")
    escaped = files.agg(F.count_if(T.audit_display(name) != name).alias("n")).first()["n"]
    codes = {s: P.code_summary(issues, s, MAX_CODES).first() for s in ("warning", "error")}
    when = generated_at or datetime.now(UTC)
    facts: dict[str, object] = {
        "library_version": VERSION, "generated_at_utc": when.isoformat(), "input_file_count": counts["total_sources"], "success_count": counts["converted_sources"], "warning_file_count": counts["warning_sources"],
        "failure_count": counts["failed_sources"], "duplicate_count": counts["duplicate_sources"], "skipped_count": counts["skipped_sources"], "result_summary_schema_version": 1,
        "sample_record_count": counts["sample_records"], "peak_record_count": counts["peak_records"], "scientific_signal_series_count": counts["scientific_signal_series"],
        "structural_record_series_count": counts["structural_record_series"], "sort_requested": sort["requested"], "sort_effective": sort["effective"], "sort_reason": sort["reason"],
        "conversion_options_policy": POLICIES["conversion_options_policy"],
    }
    facts |= {f"option_{k}": _told(options.get(k), none) for k, none in OPTIONS.items()}
    facts |= {
        "execution_mode": execution_mode, "included_sheets": w["tables"], "include_signals": _told(options.get("include_signals"), "False"), "original_modified": "No",
        "source_display_policy": POLICIES["source_display_policy"], "source_display_escape_count": escaped, "data_split": str(w["split"]),
        "warning_summary": codes["warning"]["shown"], "warning_summary_omitted_count": codes["warning"]["omitted"], "error_summary": codes["error"]["shown"], "error_summary_omitted_count": codes["error"]["omitted"],
        "literal_string_policy": POLICIES["literal_string_policy"], "formula_like_literal_count": w["formula_like"], "nonfinite_literal_count": w["non_finite"],
        "exact_integer_policy": POLICIES["exact_integer_policy"], "exact_integer_literal_count": w["exact_integers"],
    }
    facts |= {k: v for k, v in (extra or {}).items() if v is not None}
    rows = spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "key string, value string")
    none = lambda t: F.lit(None).cast(t)
    rows = rows.select("key", "value", none("string").alias("path"), none("long").alias("row_count"), none("string").alias("sha256"), none("long").alias("formula_escape_count"))
    own = parts.select(F.lit("sidecar").alias("key"), F.lit("CSV texts that look like formulas are escaped with an apostrophe").alias("value"), F.col("relative_path").alias("path"), "row_count", "sha256", "formula_escape_count")
    return rows.unionByName(own)


