"""Scanning folders of result files into a table of sources and a table of cells."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import text as T
from tallyloom.operators.order import global_rank
from tallyloom.sources.delimited import DELIMITERS, readable_directly, stream_cells, stream_digests

#: Input sizes (fixed values): from the first on a warning, over the second an error.
WARN_BYTES, MOST_BYTES = 256 << 20, 2 << 30
MOST_TABLE_BYTES = 512 << 20


def discover(spark: SparkSession, paths: list[str], recursive: bool = False, extensions: list[str] | None = None) -> DataFrame:
    """``file_id, path, relative_path, name, extension, size, modified_at, input_order``.

    Files come in the natural order of their paths. ``extensions`` keeps only those, with or without
    a dot and in any case. Names that start with ``_`` or ``.`` are not listed (Spark's rule). The
    files' content is not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths).drop("content")
    listed = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    listed = listed.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("extension", T.extension(F.col("path")))
    roots = F.array(*[F.lit(p.rstrip("/") + "/") for p in paths])
    local = F.regexp_replace("path", "^file:/*", "/")
    inside = F.transform(F.filter(roots, lambda r: local.startswith(r)), lambda r: F.substring(local, F.length(r) + 1, F.length(local)))
    listed = listed.withColumn("relative_path", F.coalesce(F.get(inside, F.lit(0)), F.col("name")))
    if extensions:
        listed = listed.where(F.col("extension").isin([T.normal_extension(e) for e in extensions]))
    ranked = global_rank(listed, [T.natural_key(F.col("path")), F.col("path"), F.monotonically_increasing_id()], "n")
    return ranked.withColumn("input_order", F.col("n") - 1).withColumn("file_id", F.col("n")).drop("n")


def with_hash(sources: DataFrame, paths: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """``sources`` with ``sha256`` of the content of files within the size limit, scanned from the same
    ``paths`` as the listing; without them the executors open the files themselves.

    The limit is a filter on the scan, so an oversize file is never loaded. Digests are made in the
    scan: what meets the sources is a path and a digest.
    """
    if paths is None:
        hashed = stream_digests(sources.where(F.col("size") <= MOST_BYTES))
        return sources.join(hashed, "path", "left")
    content = sources.sparkSession.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths).where(F.col("length") <= MOST_BYTES)
    hashed = content.select("path", F.sha2("content", 256).alias("sha256")).dropDuplicates(["path"])
    return sources.join(hashed, "path", "left")


def size_issues(sources: DataFrame) -> DataFrame:
    """A warning for large files and an error for those that are too large to parse."""
    code = F.when(F.col("size") > MOST_BYTES, "INPUT_TOO_LARGE").when(F.col("size") >= WARN_BYTES, "INPUT_LARGE")
    return sources.where(F.col("size") >= WARN_BYTES).select("file_id", code.alias("code"), F.when(F.col("size") > MOST_BYTES, "error").otherwise("warning").alias("severity"))


def mark_duplicates(sources: DataFrame, identity: str = "identity") -> DataFrame:
    """``duplicate_of``: the first input of the same path identity, null for the first itself.

    Equal content under two paths is no duplicate. The first of each identity is an aggregate, so a
    common identity is not gathered in one task.
    """
    firsts = sources.groupBy(F.col(identity).alias("__i")).agg(F.min("input_order").alias("__first"))
    joined = sources.join(firsts, F.col(identity).eqNullSafe(F.col("__i")))
    return joined.withColumn("duplicate_of", F.when(F.col("__first") != F.col("input_order"), F.col("__first"))).drop("__i", "__first")


def content_groups(sources: DataFrame) -> DataFrame:
    """Hashes that several files share, for information: those files stay separate."""
    return sources.groupBy("sha256").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("input_order")).alias("inputs")).where("n > 1")


def distinct_paths(sources: DataFrame) -> DataFrame:
    """Relative paths that are equal without case get ``input_NNN/`` before them, and any that then
    still collide ``record_NNNNNN_NNN/``."""
    low = Window.partitionBy(F.lower("relative_path"))
    n, k = F.count("*").over(low), F.row_number().over(low.orderBy("input_order"))
    pad = lambda c, w: F.lpad(c.cast("string"), F.greatest(F.length(c.cast("string")), F.lit(w)), F.lit("0"))
    once = sources.withColumn("__n", n).withColumn("__k", k)
    once = once.withColumn("relative_path", F.when(F.col("__n") > 1, F.concat(F.lit("input_"), pad(F.col("__k"), 3), F.lit("/"), "relative_path")).otherwise(F.col("relative_path")))
    again = F.row_number().over(Window.partitionBy(F.lower("relative_path")).orderBy("input_order"))
    twice = once.withColumn("__k", again)
    renamed = F.concat(F.lit("record_"), pad(F.col("input_order") + 1, 6), F.lit("_"), pad(F.col("__k") - 1, 3), F.lit("/"), "relative_path")
    return twice.withColumn("relative_path", F.when(F.col("__k") > 1, renamed).otherwise(F.col("relative_path"))).drop("__n", "__k")


def own_outputs(sources: DataFrame, stem: str) -> DataFrame:
    """``excluded`` for files that an earlier run of this output wrote; they stay as audit rows."""
    import re

    name = F.lower("name")
    part = name.rlike(f"^{re.escape(stem.lower())}_.+_[0-9]{{3}}\\.csv$")
    return sources.withColumn("excluded", part | name.startswith(".tallyloom_") | name.isin(f"{stem.lower()}.xlsx", stem.lower()))


def is_text(content: Column) -> Column:
    """``code`` for content that can't be a table: empty, with a NUL byte, or not UTF-8."""
    body = content.cast("string")
    return F.when(F.length(content) == 0, "EMPTY_FILE").when(F.contains(content, F.unhex(F.lit("00"))), "NUL_BYTE").when(~F.is_valid_utf8(body), "INVALID_UTF8")


def text_issues(spark: SparkSession, sources: DataFrame, paths: list[str], recursive: bool = False) -> DataFrame:
    """Errors of files that are not admissible as text."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths).where(F.col("length") <= MOST_TABLE_BYTES)
    code = content.select("path", is_text(F.col("content")).alias("code")).where("code is not null").dropDuplicates(["path"])
    return sources.join(code, "path").select("file_id", "code", F.lit("error").alias("severity"))


def read_cells(spark: SparkSession, sources: DataFrame, paths: list[str], recursive: bool = False, delimiter: str | None = None) -> DataFrame:
    """``file_id, row_no, col_no, lexeme`` of delimited files: strict quoting, no type guessing.

    Row 0 is the header. A file that breaks the format gives one row with ``error`` set and no
    others, so one bad file never removes good ones. Each file is read by one task, as a stream; only
    where a store is open to Spark alone do contents come through it.
    """
    if readable_directly(paths):
        sized = sources.where(F.col("size") <= MOST_TABLE_BYTES) if "size" in sources.columns else sources
        return stream_cells(sized, delimiter)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths).where(F.col("length") <= MOST_TABLE_BYTES)
    wanted = sources.select("file_id", "path", "extension")
    held = wanted.join(content.select("path", "content"), "path").dropDuplicates(["file_id"]).select("file_id", "extension", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file_id", "row_no", "col_no", "lexeme", "error"]
        for batch in batches:
            for file_id, ext, raw in zip(batch["file_id"], batch["extension"], batch["content"], strict=True):
                rows: list[tuple] = []
                try:
                    if not raw:
                        raise ValueError("EMPTY_FILE")
                    if b"\0" in raw:
                        raise ValueError("NUL_BYTE")
                    text = io.StringIO(bytes(raw).decode("utf-8-sig"), newline="")
                    for n, row in enumerate(csv.reader(text, delimiter=delimiter or DELIMITERS.get(ext, ","), strict=True)):
                        rows += [(file_id, n, c, v, None) for c, v in enumerate(row, 1)]
                except UnicodeDecodeError:
                    rows = [(file_id, None, None, None, "INVALID_UTF8")]
                except csv.Error:
                    rows = [(file_id, None, None, None, "DELIMITED_SYNTAX_INVALID")]
                except ValueError as fault:
                    rows = [(file_id, None, None, None, str(fault))]
                for i in range(0, max(1, len(rows)), 100_000):
                    yield pd.DataFrame(rows[i : i + 100_000], columns=names)

    return held.mapInPandas(parse, "file_id long, row_no int, col_no int, lexeme string, error string")


def read_heads(spark: SparkSession, sources: DataFrame, paths: list[str], recursive: bool = False) -> DataFrame:
    """The header cells of delimited files, and faults up to there; as ``read_cells`` has them."""
    if readable_directly(paths):
        return stream_cells(sources, most_rows=1).where("row_no = 0 or error is not null")
    return read_cells(spark, sources, paths, recursive).where("row_no = 0 or error is not null")


def preview_files(sources: DataFrame, n: int = 5, delimiter: str | None = None) -> DataFrame:
    """``file_id, row_no, cells`` of each file's header and its first ``n`` rows with data (10 at most): nothing
    after them is read."""
    if not 1 <= n <= 10:
        raise ValueError("a preview shows 1 to 10 rows")
    return preview(stream_cells(sources, delimiter, n).where("error is null"), n)


def preview(cells: DataFrame, n: int = 10) -> DataFrame:
    """Header and the first ``n`` rows with data, as arrays of display texts; 10 rows at most."""
    filled = cells.groupBy("file_id", "row_no").agg(F.count_if(F.col("lexeme") != "").alias("k"), F.transform(F.sort_array(F.collect_list(F.struct("col_no", "lexeme"))), lambda x: x["lexeme"]).alias("cells"))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("row_no"))
    return filled.where("k > 0 or row_no = 0").withColumn("r", rank).where(F.col("r") <= min(n, 10) + 1).select("file_id", "row_no", "cells")


def find_header_row(lines: DataFrame, most_lines: int = 100) -> DataFrame:
    """``file_id, line_no``: the first of a text's leading lines with a retention-time and an area
    column under some delimiter, bracketed units aside."""
    clean = F.lower(F.regexp_replace("line", r"[\[(][^\])]*[\])]", ""))

    def named(sep: str) -> Column:
        parts = F.transform(F.split(clean, sep), lambda c: T.normal_header(F.regexp_replace(c, r"[\".]", "")))
        rt, area = ("rt", "retention_time", "r_time", "rtime", "reten_time", "ret_time"), ("area", "peak_area")
        return F.exists(parts, lambda c: c.isin(*rt)) & F.exists(parts, lambda c: c.isin(*area))

    hit = named("\t") | named(",") | named(";") | named(r"\s{2,}")
    return lines.where((F.col("line_no") < most_lines) & hit).groupBy("file_id").agg(F.min("line_no").alias("line_no"))
