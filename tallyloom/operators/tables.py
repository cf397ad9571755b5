"""Result tables: samples, peaks, matrices, logs, manifest, digests and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import text as T
from tallyloom.operators import merkle
from tallyloom.operators.joins import BROADCAST_ROWS, keyed_join
from tallyloom.operators.order import first_seen, global_rank, occurrence_number

#: Columns of the peaks table, in order (fixed values).
PEAK_COLUMNS = (
    "sample_id", "source_file", "channel", "detector", "peak_number", "retention_time", "retention_time_unit", "area", "height",
    "compound", "compound_source", "status", "manufacturer", "observation_order", "start_time", "end_time", "area_unit", "height_unit",
)
SECONDARY_COLUMNS = ("secondary_retention_time", "secondary_retention_time_unit")
OK = ("success", "warning")


def successful(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the files that succeeded."""
    return rows.join(files.where(F.col("status").isin(*OK)).select("file_id"), "file_id", "left_semi")


def samples_table(files: DataFrame, samples: DataFrame, peaks: DataFrame) -> DataFrame:
    """Every file with its sample, its number of peaks and its detectors and channels."""
    counts = successful(peaks, files).groupBy("file_id").agg(F.count("*").alias("peak_count"))
    joined = files.join(samples, "file_id", "left").join(counts, "file_id", "left")
    return joined.withColumn("peak_count", F.coalesce("peak_count", F.lit(0))).withColumn(
        "detector_channels", F.array_join(F.concat(F.coalesce("detectors", F.array().cast("array<string>")), F.coalesce("channels", F.array().cast("array<string>"))), "; ")
    )


def peaks_table(peaks: DataFrame, files: DataFrame, samples: DataFrame, secondary: bool | None = None) -> DataFrame:
    """Peaks of the successful files in the fixed columns, the maker joined in.

    Secondary coordinates are columns only where any peak has one (``secondary`` None: looked up).
    """
    held = successful(peaks, files).join(samples.select("file_id", F.col("vendor").alias("manufacturer")), "file_id")
    if secondary is None:
        known = F.col("secondary_retention_time").isNotNull() | F.col("secondary_retention_time_unit").isNotNull()
        secondary = bool(held.agg(F.bool_or(known).alias("any")).first()["any"])
    missing = [c for c in (*PEAK_COLUMNS, *SECONDARY_COLUMNS) if c not in held.columns]
    held = held.withColumns({c: F.lit(None).cast("string") for c in missing})
    return held.select(*PEAK_COLUMNS, *(SECONDARY_COLUMNS if secondary else ()))


def compound_matrix_long(peaks: DataFrame, place: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``file_id, sample_id, column_name, ordinal, occurrence, area``: one row for each named peak.

    Equal compounds of a file are never summed: the k-th has a column of its own. Column names that
    are equal without case are told apart by ``__identity_N``, in first-seen order. Few identities are
    broadcast; of many, those that are on very many peaks are salted, so none of them fills a task.
    """
    named = occurrence_number(peaks.where("compound <> ''"), place)
    identity = ["compound", "detector", "channel"]
    seen = first_seen(named, identity, place)
    base = T.matrix_base(F.col("compound"), F.col("detector"), F.col("channel"))
    nth = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy("ordinal"))
    seen = seen.withColumn("base", base).withColumn("nth", nth)
    seen = seen.withColumn("base", F.when(F.col("nth") > 1, F.concat("base", F.lit("__identity_"), F.col("nth"))).otherwise(F.col("base")))
    joined = keyed_join(named.select("file_id", "sample_id", *identity, "occurrence", "area"), seen.select(*identity, "base", "ordinal"), identity, broadcast_rows)
    name = F.when(F.col("occurrence") > 1, F.concat("base", F.lit("_"), "occurrence")).otherwise(F.col("base"))
    return joined.select("file_id", "sample_id", name.alias("column_name"), "ordinal", "occurrence", "area")


def compound_matrix_wide(long: DataFrame, files: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each successful file, also without peaks, and one column for each of ``columns``."""
    wide = long.where(F.col("column_name").isin(columns)).groupBy("file_id").pivot("column_name", columns).agg(F.first("area"))
    return files.where(F.col("status").isin(*OK)).select("file_id", "sample_id").join(wide, "file_id", "left")


def order_matrix(peaks: DataFrame, place: list[str], two_dimensional: bool = False) -> DataFrame:
    """Peaks of each ordered stream as an array of pairs (or triples) in source order."""
    second = F.col("secondary_retention_time").isNotNull()
    rows = peaks.where(F.col("observation_order").isNotNull() & (second if two_dimensional else ~second))
    key = ["sample_id", "file_id", "detector", "channel", "retention_time_unit", "area_unit", *(["secondary_retention_time_unit"] if two_dimensional else [])]
    fields = ["retention_time", *(["secondary_retention_time"] if two_dimensional else []), "area"]
    parts = F.sort_array(F.collect_list(F.struct(*place, *[F.col(f).alias(f"v_{f}") for f in fields])))
    atoms = F.transform(parts, lambda x: F.struct(*[x[f"v_{f}"].alias(f) for f in fields]))
    return rows.groupBy(*key).agg(atoms.alias("peaks"))


def order_matrix_long(matrix: DataFrame) -> DataFrame:
    """One row for each peak of the matrix, with its number ``peak`` in its stream."""
    rest = [c for c in matrix.columns if c != "peaks"]
    rows = matrix.select(*rest, F.posexplode("peaks").alias("at", "p"))
    return rows.select(*rest, (F.col("at") + 1).cast("long").alias("peak"), "p.*")


def widen_order_matrix(matrix: DataFrame, n: int) -> DataFrame:
    """The arrays' first ``n`` atoms as columns ``peak_k_<field>``, null where there are fewer."""
    fields = matrix.schema["peaks"].dataType.elementType.fieldNames()
    cells = [F.get("peaks", F.lit(k))[f].alias(f"peak_{k + 1}_{f}") for k in range(n) for f in fields]
    return matrix.select(*[c for c in matrix.columns if c != "peaks"], *cells)


def column_segments(columns: DataFrame, capacity: int, fixed: int, atom: int) -> DataFrame:
    """``segment, place`` of data columns ``(ordinal)`` when tables hold ``capacity`` columns.

    Each segment repeats the ``fixed`` leading columns; atoms of ``atom`` columns are never split.
    """
    room = (capacity - fixed) - (capacity - fixed) % atom
    at = F.col("ordinal") - 1
    return columns.withColumn("segment", (F.floor(at / room) + 1).cast("long")).withColumn("place", (fixed + 1 + at % room).cast("long"))


def row_chunks(rows: DataFrame, rank: str, capacity: int, name: str) -> DataFrame:
    """``chunk`` and ``part_name`` (``name``, ``name_002``, ...) by rank."""
    chunk = (F.floor((F.col(rank) - 1) / capacity) + 1).cast("int")
    held = rows.withColumn("chunk", chunk)
    return held.withColumn("part_name", F.when(F.col("chunk") == 1, name).otherwise(F.format_string(f"{name}_%03d", "chunk")))


def issue_log(issues: DataFrame) -> DataFrame:
    """Per file: warning codes, error codes and messages, in issue order."""

    def listed(value: str, sep: str, severity: str | None = None) -> Column:
        keep = F.lit(True) if severity is None else F.col("severity") == severity
        pairs = F.sort_array(F.collect_list(F.when(keep, F.struct("issue_no", F.col(value).alias("v")))))
        return F.array_join(F.transform(pairs, lambda x: x["v"]), sep)

    out = issues.groupBy("file_id").agg(
        listed("code", ";", "warning").alias("warning_code"), listed("code", ";", "error").alias("error_code"), listed("message", " | ").alias("message"),
        F.count_if(F.col("severity") == "error").alias("n_errors"), F.count("*").alias("n_issues"),
    )
    over = F.length("message") > T.MAX_CELL_CHARACTERS
    return out.withColumn("message", F.when(over, "WORKBOOK_AUDIT_CELL_LIMIT").otherwise(F.col("message")))


def import_log(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Every file with its status (derived from its issues unless settled) and its codes."""
    joined = files.join(issue_log(issues), "file_id", "left")
    n, bad = F.coalesce("n_issues", F.lit(0)), F.coalesce("n_errors", F.lit(0))
    derived = F.when(bad > 0, "failed").when(n > 0, "warning").otherwise("success")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("warning_code", "error_code", "message")}
    return joined.withColumns(blank).withColumn("status", F.coalesce("status", derived)).drop("n_issues", "n_errors")


def quarantine(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows without those of files that have an error."""
    return rows.join(issues.where("severity = 'error'").select("file_id").distinct(), "file_id", "left_anti")


def batch_counts(files: DataFrame) -> DataFrame:
    """One row: how many files of each status, and the batch's outcome."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = files.agg(
        F.count("*").alias("total"), n(*OK).alias("success_count"), n("warning").alias("warning_count"), n("failed").alias("failure_count"),
        n("duplicate").alias("duplicate_count"), n("skipped").alias("skipped_count"),
    )
    outcome = F.when(F.col("success_count") == 0, "failed").when(F.col("failure_count") > 0, "partial_success").otherwise("success")
    return out.withColumn("outcome", outcome)


def code_summary(issues: DataFrame, severity: str, most: int = 100) -> DataFrame:
    """One row: the sorted codes of a severity, the first ``most`` shown, the rest counted."""
    codes = issues.where(F.col("severity") == severity).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return codes.select(F.array_join(F.slice("codes", 1, most), "; ").alias("shown"), F.greatest(F.size("codes") - most, F.lit(0)).alias("omitted"))


def numeric_safety(rows: DataFrame) -> DataFrame:
    """One row of counters over all cells and headers: formula-like, non-finite, over 15 digits."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    floats = [c for c, t in rows.dtypes if t in ("double", "float")]
    whole = [c for c, t in rows.dtypes if t in ("bigint", "int", "smallint", "tinyint") or t.startswith("decimal") and t.endswith(",0)")]
    total = lambda flags: reduce(lambda a, b: a + b, [F.sum(F.coalesce(f, F.lit(False)).cast("long")) for f in flags], F.lit(0).cast("long"))
    finite = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    headers = sum(c[:1] in "=+-@" for c in rows.columns)
    return rows.agg(
        (total([T.is_formula_like(F.col(c)) for c in texts]) + headers).alias("formula_like"),
        total([finite(c) for c in floats]).alias("non_finite"),
        total([F.abs(F.col(c)) >= F.lit(10**15) for c in whole]).alias("exact_integers"),
    )


def overlong_columns(rows: DataFrame) -> DataFrame:
    """``column, longest, to_csv``: columns with a text beyond one cell go to a CSV part."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    longest = rows.agg(*[F.max(F.length(c)).alias(c) for c in texts])
    out = longest.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("longest")) for c in texts])))
    return out.withColumn("to_csv", F.coalesce(F.col("longest") > T.MAX_CELL_CHARACTERS, F.lit(False)))


def cell_audit(rows: DataFrame) -> DataFrame:
    """``column, n_bad``: text cells that can't be held exactly."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    bad = rows.agg(*[F.count_if(~T.cell_text_is_exact(F.col(c))).alias(c) for c in texts])
    return bad.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_bad")) for c in texts])))


def write_csv_part(rows: DataFrame, path: str, overwrite: bool = False) -> dict:
    """Write rows as CSV with texts made formula-safe; number of rows and of escaped texts."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    changed = reduce(lambda a, b: a + b, [F.count_if(T.formula_safe(F.col(c)) != F.col(c)) for c in texts], F.lit(0))
    seen = Observation()
    held = rows.observe(seen, F.count(F.lit(1)).alias("row_count"), changed.alias("formula_escape_count"))
    safe = held.withColumns({c: T.formula_safe(F.col(c)) for c in texts})
    safe.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)
    return seen.get


def part_digests(spark, path: str) -> DataFrame:
    """``path, size, sha256`` of each file that a sink wrote."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def file_set_digest(files: DataFrame, range_rows: int = merkle.RANGE_ROWS) -> DataFrame:
    """``digest, n_files``: one digest of a set of files ``(relative_path, size, sha256)``, whatever their order.

    The root of a digest tree over ranges of hashed paths; a file's line is its path, size and hash between tabs.
    """
    line = F.concat_ws("\t", "relative_path", F.col("size").cast("string"), "sha256")
    nodes = merkle.tree(files, F.col("relative_path"), F.sha2(line, 256), None, range_rows)
    return nodes.where("level = 0").select("digest", F.col("n_rows").alias("n_files"))


def ordered_digest(rows: DataFrame, keys: list[str], text: Column, block: int = 1000) -> DataFrame:
    """``block, n_rows, digest``: a digest of each run of ``block`` rows in the order of ``keys``."""
    ranked = global_rank(rows.withColumn("__text", F.sha2(text, 256)), [F.col(k) for k in keys], "__rank")
    number = F.floor((F.col("__rank") - 1) / block).cast("long").alias("block")
    parts = F.sort_array(F.collect_list(F.struct("__rank", "__text")))
    return ranked.groupBy(number).agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.transform(parts, lambda x: x["__text"]), ""), 256).alias("digest"))


def manifest(facts: DataFrame) -> DataFrame:
    """``key, value`` rows of a one-row table of facts."""
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in facts.columns]
    return facts.select(F.inline(F.array(*pairs)))


def signal_datasets(points: DataFrame, place: list[str]) -> DataFrame:
    """Per series: number of points, label and rank by first appearance.

    The label is the detector, else the channel, else ``Unknown``.
    """
    key = ["channel", "detector", "x_unit", "y_unit"]
    firsts = points.groupBy(*key).agg(F.count("*").alias("n_points"), F.min(F.struct(*place)).alias("__first"))
    ranked = global_rank(firsts, [F.col("__first"), *[F.col(k) for k in key]], "series_no").drop("__first")
    return ranked.withColumn("label", F.coalesce("detector", "channel", F.lit("Unknown")))
