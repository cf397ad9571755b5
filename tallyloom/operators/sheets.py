"""Which sheet of a workbook is read: a named one, or the only compatible visible one.

Sheets share few header lists, so what a list is good for is found once for each different one and joined
back. A file's sheets are counted by aggregates: a workbook with very many sheets is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.joins import keyed_join

#: What the election of a sheet can say (fixed values).
NOT_FOUND, UNRECOGNIZED, NONE, SEVERAL = "XLSX_SHEET_NOT_FOUND", "XLSX_SHEET_SCHEMA_UNRECOGNIZED", "XLSX_NO_COMPATIBLE_SHEET", "XLSX_SHEET_AMBIGUOUS"


def trimmed_headers(headers: Column) -> Column:
    """Headers without the blank ones at the end."""
    last = F.coalesce(F.array_max(F.filter(F.transform(headers, lambda h, i: F.when(F.trim(F.coalesce(h, F.lit(""))) != "", i + 1)), lambda n: n.isNotNull())), F.lit(0))
    return F.slice(headers, 1, last)


def judged_sheets(sheets: DataFrame, compatible: Column, fault: Column | None = None) -> DataFrame:
    """``sheets`` with ``compatible`` and ``fault``, expressions over ``headers``: whether the headers can be read,
    and the code of headers that are against the rules (those are never compatible)."""
    fault = F.lit(None).cast("string") if fault is None else fault
    kinds = sheets.select("headers").distinct().withColumn("fault", fault)
    kinds = kinds.withColumn("compatible", F.col("fault").isNull() & F.coalesce(compatible, F.lit(False)))
    return keyed_join(sheets, kinds, ["headers"])


def elect_sheets(sheets: DataFrame, named: str | None = None, include_hidden: bool = False) -> DataFrame:
    """``file_id, sheet_no, title, n_compatible, code`` for each file of ``sheets (file_id, sheet_no, title, visible,
    compatible, fault)``.

    With ``named`` only the sheet of that very title counts, also a hidden one; without, all visible sheets (or all).
    Exactly one compatible one is read. Several are ambiguous; of none, a single fault is told, several are ambiguous, and
    without a fault there is no compatible sheet. Null visibility counts as hidden.
    """
    counts = (F.col("title") == named) if named is not None else F.lit(True) if include_hidden else F.coalesce(F.col("visible"), F.lit(False))
    counts = F.coalesce(counts, F.lit(False))
    fit, bad = counts & F.col("compatible"), counts & F.col("fault").isNotNull()
    out = sheets.groupBy("file_id").agg(
        F.min(F.when(fit, F.struct("sheet_no", "title"))).alias("s"), F.count_if(counts).alias("n"), F.count_if(fit).alias("n_compatible"),
        F.count_if(bad).alias("n_bad"), F.min(F.when(bad, F.col("fault"))).alias("first_fault"),
    )
    code = F.when(F.col("n_compatible") > 1, SEVERAL).when(F.col("n_compatible") == 0, F.when(F.col("n_bad") == 1, F.col("first_fault")).when(F.col("n_bad") > 1, SEVERAL).otherwise(UNRECOGNIZED if named is not None else NONE))
    if named is not None:
        code = F.when(F.col("n") == 0, NOT_FOUND).otherwise(code)
    chosen = lambda f: F.when(F.col("code").isNull(), F.col("s")[f]).alias(f)
    return out.withColumn("code", code).select("file_id", chosen("sheet_no"), chosen("title"), "n_compatible", "code")


def sheet_structures(sheets: DataFrame, elected: DataFrame, source_format: str = "xlsx") -> DataFrame:
    """``file_id, source_format, headers, worksheet_title`` of the elected sheets, for drift and matching."""
    chosen = elected.where("code is null").select("file_id", "sheet_no")
    held = sheets.join(chosen, ["file_id", "sheet_no"], "left_semi")
    return held.select("file_id", F.lit(source_format).alias("source_format"), trimmed_headers(F.col("headers")).alias("headers"), F.col("title").alias("worksheet_title"))
