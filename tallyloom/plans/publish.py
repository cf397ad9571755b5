"""Publishing a conversion: what is written, where, and what may not be.

Each table is written once, and its rows, longest text and formula-like texts are measured by that very write. A
table with a text beyond one cell then goes to a CSV part as well, from what was written, and a
placeholder with its identity columns stands for it; nothing is counted by reading again.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import tables as P

if TYPE_CHECKING:
    from tallyloom.plans.convert import Converted

TABLES = ("samples", "peaks", "metadata", "import_log", "matrix", "signals")
#: Tables that may go to a CSV part, with the columns that their placeholders keep (fixed values).
IDENTITY = {
    "matrix": ("sample_id",), "order_matrix": ("sample_id", "source_file", "manufacturer", "detector", "channel", "retention_time_unit", "area_unit"),
    "order_matrix_2d": ("sample_id", "source_file", "manufacturer", "detector", "channel", "retention_time_unit", "secondary_retention_time_unit", "area_unit"), "peaks": None, "metadata": None, "signals": (),
}


class PublishRefused(ValueError):
    """Nothing was published; the text begins with a code."""


def output_conflicts(sources: DataFrame, folder: str) -> DataFrame:
    """``file_id, path`` of inputs that are, or lie in, the output folder, and of those the folder lies in."""
    plain = lambda c: F.rtrim(F.regexp_replace(c, "^file:/*", "/"), F.lit("/"))
    target, path = plain(F.lit(folder)), plain(F.col("path"))
    return sources.where((path == target) | path.startswith(F.concat(target, F.lit("/"))) | target.startswith(F.concat(path, F.lit("/")))).select("file_id", "path")


def measured(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """``rows`` with metrics that the first action on them gathers: rows, longest text, formula-like texts,
    non-finite numbers and integers of over 15 digits."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    floats = [c for c, t in rows.dtypes if t in ("double", "float")]
    whole = [c for c, t in rows.dtypes if t in ("bigint", "int", "smallint", "tinyint") or (t.startswith("decimal") and t.endswith(",0)"))]
    count = lambda flags: reduce(lambda a, b: a + b, [F.sum(F.coalesce(f, F.lit(False)).cast("long")) for f in flags], F.lit(0).cast("long"))
    longest = F.greatest(F.lit(0), F.lit(0), *[F.max(F.length(c)) for c in texts])
    seen = Observation()
    held = rows.observe(
        seen, F.count(F.lit(1)).alias("row_count"), longest.alias("longest"), count([T.is_formula_like(F.col(c)) for c in texts]).alias("formula_like"),
        count([F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")) for c in floats]).alias("non_finite"), count([F.abs(F.col(c)) >= F.lit(10**15) for c in whole]).alias("exact_integers"),
    )
    return held, seen


def placeholder(table: DataFrame, name: str) -> DataFrame:
    """No rows, the identity columns of a table that went to a CSV part, and ``sidecar_status``."""
    keep = IDENTITY[name]
    held = table.limit(0)
    return held if keep is None else held.select(*[c for c in keep if c in table.columns], F.lit(None).cast("string").alias("sidecar_status"))


def write_tables(tables: dict[str, DataFrame], folder: str, sidecar_mode: str = "error", overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Writes tables as Parquet under ``folder``; ``table, row_count, longest, formula_like, non_finite, exact_integers, sidecar``
    of each, and ``relative_path, row_count, sha256, formula_escape_count`` of the CSV parts.

    Tables with a text beyond one cell are an error (``EXCEL_CELL_TEXT_LIMIT``) unless ``sidecar_mode`` is ``csv`` and they may go to a
    part; then the part has all rows and the table is its placeholder. Everything is written apart first and
    only a whole set that is allowed takes its place.
    """
    if sidecar_mode not in ("error", "csv"):
        raise PublishRefused("SIDECAR_MODE_INVALID: error or csv")
    spark = next(iter(tables.values())).sparkSession
    folder = folder.rstrip("/")
    first = {name: f"{folder}/_staged-{uuid.uuid4().hex}/{name}" for name in tables}
    facts, parts = [], []
    for name, rows in tables.items():
        held, seen = measured(rows)
        held.write.parquet(first[name])
        m = seen.get
        facts.append((name, m["row_count"], m["longest"] or 0, m["formula_like"] or 0, m["non_finite"] or 0, m["exact_integers"] or 0, (m["longest"] or 0) > T.MAX_CELL_CHARACTERS))
    over = [f[0] for f in facts if f[-1]]
    refused = [name for name in over if sidecar_mode == "error" or name not in IDENTITY]
    if refused:
        raise PublishRefused(f"EXCEL_CELL_TEXT_LIMIT: {', '.join(refused)}")
    mode = "overwrite" if overwrite else "errorifexists"
    for name, rows in tables.items():
        staged = spark.read.schema(rows.schema).parquet(first[name])
        if name in over:
            told = P.write_csv_part(staged, f"{folder}/{name}_001.csv", overwrite)
            digests = P.part_digests(spark, f"{folder}/{name}_001.csv").orderBy("path").select("sha256").collect()
            parts.append((f"{name}_001.csv", told["row_count"], ";".join(d["sha256"] for d in digests), told["formula_escape_count"]))
            staged = placeholder(staged, name)
        staged.write.mode(mode).parquet(f"{folder}/{name}")
    return (
        spark.createDataFrame(facts, "table string, row_count long, longest int, formula_like long, non_finite long, exact_integers long, sidecar boolean"),
        spark.createDataFrame(parts, "relative_path string, row_count long, sha256 string, formula_escape_count long"),
    )


def publish(result: Converted, folder: str, overwrite: bool = False) -> DataFrame:
    """Write the tables as Parquet under ``folder``; ``table, row_count`` and the measures of what was written.

    Nothing is overwritten unless asked, nothing is written where no file succeeded, and an output folder may not be
    or hold an input. Texts beyond one cell are treated as the recipe's ``sidecar_mode`` says. A manifest is
    written beside the tables.
    """
    from tallyloom.operators.manifest import manifest_rows

    spark: SparkSession = result.files.sparkSession
    if output_conflicts(result.sources, folder).limit(1).count():
        raise PublishRefused("OUTPUT_IS_INPUT: the output folder is or holds an input")
    if result.summary.first()["success_count"] == 0:
        raise ValueError("no file succeeded: nothing is published")
    if not overwrite and _exists(spark, folder):
        raise PublishRefused("OUTPUT_EXISTS: the output exists; ask for overwriting to replace it")
    tables = {name: t for name in TABLES if (t := getattr(result, name)) is not None}
    facts, parts = write_tables(tables, folder, result.recipe.sidecar_mode, overwrite)
    rows = manifest_rows(result.files, result.issues, result.results, result.decision, facts, parts, result.recipe.options() | {"overwrite": overwrite})
    rows.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder.rstrip('/')}/manifest")
    return facts


def _exists(spark: SparkSession, folder: str) -> bool:
    """Whether a published set is there: Spark's own file systems are asked, so any store will do."""
    try:
        return len(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder.rstrip('/')}/import_log").limit(1).select("path").collect()) > 0
    except Exception as fault:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(fault):
            return False
        raise


