"""Order-dependent operators. Rows carry their place; every window has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.shared import cut
from tallyloom.functions.text import natural_key

STREAM = ("file_id", "detector", "channel")


def global_rank(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with its rank (1..n) by ``keys``, without bringing all rows into one task.

    Rows are range-partitioned by the keys and numbered inside each range; the ranges' sizes, one
    row for each range, give the offsets. The keys must be a total order.
    """
    numbered = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    ranged = df.select("*", *numbered).repartitionByRange(*names).withColumn("__range", F.spark_partition_id())
    ranged = cut(ranged)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*names))
    ranked = ranged.withColumn("__in", inside).join(F.broadcast(offsets), "__range")
    return ranked.withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__range", "__in", "__before", *names)


def observation_order(rows: DataFrame, place: list[str], name: str = "observation_order") -> DataFrame:
    """1..n in each file's (detector, channel) stream, in source order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*STREAM).orderBy(*place)))


def occurrence_number(rows: DataFrame, place: list[str], name: str = "occurrence") -> DataFrame:
    """k for the k-th peak of a file with the same compound, detector and channel."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("file_id", "compound", "detector", "channel").orderBy(*place)))


def first_seen(rows: DataFrame, identity: list[str], place: list[str], name: str = "ordinal") -> DataFrame:
    """Each identity once, numbered by where it is first seen in file and row order."""
    firsts = rows.groupBy(*identity).agg(F.min(F.struct(*place)).alias("__first"))
    return global_rank(firsts, [F.col("__first")], name).drop("__first")


def first_value_wins(rows: DataFrame, owner: list[str], field: str, place: list[str]) -> DataFrame:
    """``owner, value, n_conflicts``: the first known value of a field; later ones that differ count."""
    first = F.first(field, ignorenulls=True).over(Window.partitionBy(*owner).orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    held = rows.withColumn("__first", first)
    return held.groupBy(*owner).agg(F.first("__first").alias("value"), F.count_if(F.col(field).isNotNull() & (F.col(field) != F.col("__first"))).alias("n_conflicts"))


def elect_sample_id(rows: DataFrame, stem: Column, place: list[str]) -> DataFrame:
    """Rows rebound to the file's first explicit sample id, or its name's stem without one.

    ``other_ids`` tells whether the file names further ids.
    """
    named = F.when(F.col("sample_id").isNotNull(), F.struct(*place, "sample_id"))
    # One row for each file, joined back: a file's rows are never gathered, however many there are.
    told = rows.groupBy(F.col("file_id").alias("__file")).agg(F.min(named).alias("__first"), (F.min("sample_id") != F.max("sample_id")).alias("__others")).where("__first is not null")
    held = rows.join(told, rows["file_id"] == F.col("__file"), "left")
    return held.withColumn("other_ids", F.coalesce("__others", F.lit(False))).withColumn("sample_id", F.coalesce("__first.sample_id", stem)).drop("__first", "__file", "__others")


def ordered_distinct(value: str, place: list[str]) -> Column:
    """Aggregate: the distinct known values in the order in which they are first seen."""
    pairs = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*place, F.col(value).alias("__v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["__v"]))


#: Recorded reasons (fixed values).
REASONS = {
    "acquired_at": "All successful files have reliable, timezone-aware acquisition times.",
    "sequence": "Acquisition times were incomplete or unreliable; sequence is complete.",
    "filename": "Acquisition time and sequence were not complete; natural filename fallback used.",
    "fallback": " Unavailable outcomes use natural filename fallback.",
    "want_acquired_at": "Requested acquisition-time ordering; missing or unreliable values sort after available values using natural filename ties.",
    "want_sequence": "Requested sequence ordering; missing values sort after available values using natural filename ties.",
}


def sort_decision(files: DataFrame, requested: str = "auto") -> DataFrame:
    """One row ``requested, effective, reason`` for ``files (ok, acquired_at, reliable, sequence)``."""
    timed = F.col("acquired_at").isNotNull() & F.col("reliable")
    facts = files.agg(
        F.count_if("ok").alias("n_ok"), F.count("*").alias("n"),
        F.count_if(F.col("ok") & timed).alias("n_timed"), F.count_if(F.col("ok") & F.col("sequence").isNotNull()).alias("n_seq"),
    )
    some, lost = F.col("n_ok") > 0, F.col("n_ok") != F.col("n")
    all_timed, all_seq = some & (F.col("n_timed") == F.col("n_ok")), some & (F.col("n_seq") == F.col("n_ok"))
    tail = F.when(lost, REASONS["fallback"]).otherwise("")
    if requested == "auto":
        effective = F.when(all_timed, "acquired_at").when(all_seq, "sequence").otherwise("filename")
        reason = F.when(all_timed, F.concat(F.lit(REASONS["acquired_at"]), tail)).when(all_seq, F.concat(F.lit(REASONS["sequence"]), tail)).otherwise(REASONS["filename"])
    else:
        effective = F.lit(requested)
        whole = {"acquired_at": all_timed, "sequence": all_seq}.get(requested, F.lit(True)) & (~lost if requested in ("acquired_at", "sequence") else F.lit(True))
        reason = F.when(whole, f"User requested {requested} ordering.").otherwise(REASONS.get(f"want_{requested}", ""))
    return facts.select(F.lit(requested).alias("requested"), effective.alias("effective"), reason.alias("reason"))


def filename_keys() -> list[Column]:
    """Natural name order; an alias of a private source compares as plain lower-case text."""
    alias = F.array(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("size"), F.lower("public_id").alias("body")))
    key = lambda c: F.when(F.col("public_id").isNotNull(), alias).otherwise(natural_key(F.col(c)))
    return [key("name"), key("relative_path"), F.col("input_order")]


def order_files(files: DataFrame, effective: str) -> DataFrame:
    """``files`` with ``file_rank`` and the recorded ``sort_key`` under an effective mode."""
    public = F.coalesce("public_id", "relative_path")
    timed = F.col("ok") & F.col("acquired_at").isNotNull() & F.col("reliable")
    numbered = F.col("ok") & F.col("sequence").isNotNull()
    fallback = F.concat(F.lit("fallback:"), public)
    if effective == "acquired_at":
        keys = [F.when(timed, 0).otherwise(1), F.when(timed, F.col("acquired_at")), *filename_keys()]
        text = F.when(timed, F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(fallback)
    elif effective == "sequence":
        keys = [F.when(numbered, 0).otherwise(1), F.when(numbered, F.col("sequence")), *filename_keys()]
        text = F.when(numbered, F.col("sequence").cast("string")).otherwise(fallback)
    elif effective == "input_order":
        keys, text = [F.col("input_order")], F.col("input_order").cast("string")
    else:
        keys, text = filename_keys(), public
    return global_rank(files, keys, "file_rank").withColumn("sort_key", text)


def sort_files(files: DataFrame, requested: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Ranked files and the decision that ranked them."""
    decision = sort_decision(files, requested)
    return order_files(files, decision.first()["effective"]), decision


def stop_after_failure(files: DataFrame) -> DataFrame:
    """Files after the first failed one, in input order, become ``skipped`` unless settled before.

    The first failure is one number, so no global window is needed.
    """
    first = files.where("status = 'failed' and not settled").agg(F.min("input_order").alias("first_failed"))
    after = F.coalesce(F.col("input_order") > F.col("first_failed"), F.lit(False)) & ~F.col("settled")
    return files.join(F.broadcast(first)).withColumn("status", F.when(after, "skipped").otherwise(F.col("status"))).drop("first_failed")


def step_faults(points: DataFrame, series: list[str], place: list[str], x: str, step: float | None = None) -> DataFrame:
    """Points whose ``x`` does not rise over the one before, or not by ``step`` where given."""
    before = F.lag(x).over(Window.partitionBy(*series).orderBy(*place))
    held = points.withColumn("x_before", before).where("x_before is not null")
    wrong = F.col(x) <= F.col("x_before") if step is None else (F.col(x) - F.col("x_before")) != step
    return held.where(wrong)


def decode_deltas(words: DataFrame, series: list[str], place: list[str]) -> DataFrame:
    """Values of delta-of-delta records ``(is_abs, word)``.

    An absolute word sets the value and clears the slope; any other is added to the slope, and the
    slope to the value: two running sums in each stretch after an absolute word.
    """
    line = Window.partitionBy(*series).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    cut_up = words.withColumn("segment", F.sum(F.col("is_abs").cast("long")).over(line))
    inside = Window.partitionBy(*series, "segment").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    slope = cut_up.withColumn("slope", F.sum(F.when(F.col("is_abs"), F.lit(0).cast("long")).otherwise(F.col("word"))).over(inside))
    step = F.when(F.col("is_abs"), F.col("word")).otherwise(F.col("slope"))
    return slope.withColumn("value", F.sum(step).over(inside)).drop("slope")


def uniform_axis(points: DataFrame, delay_ms: str = "delay_ms", interval_ms: str = "interval_ms", point_no: str = "point_no") -> DataFrame:
    """``x`` in minutes of evenly spaced points."""
    return points.withColumn("x", (F.col(delay_ms) + F.col(point_no) * F.col(interval_ms)) / F.lit(60000.0))


def ordinal_axis(points: DataFrame, series: list[str], place: list[str]) -> DataFrame:
    """``x`` = 0..n-1 for records without an axis."""
    return points.withColumn("x", (F.row_number().over(Window.partitionBy(*series).orderBy(*place)) - 1).cast("double"))


def carry_section(lines: DataFrame, header: Column, owner: list[str], place: list[str]) -> DataFrame:
    """Each line with the last section header at or before it."""
    line = Window.partitionBy(*owner).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(line))


def header_tokens(headers: DataFrame, owner: list[str], label: str = "label", position: str = "position") -> DataFrame:
    """``k`` for the k-th column of a table with the same label."""
    return headers.withColumn("k", F.row_number().over(Window.partitionBy(*owner, label).orderBy(position)))


def latest_revision(blocks: DataFrame, owner: list[str], version: str = "version") -> DataFrame:
    """Blocks of each owner's newest version, and whether its versions run 1..n without gaps."""
    per = blocks.groupBy(*owner).agg(F.max(version).alias("__last"), F.count_distinct(version).alias("__n"), F.min(version).alias("__first"))
    whole = (F.col("__first") == 1) & (F.col("__last") == F.col("__n"))
    held = blocks.join(per, owner).where(F.col(version) == F.col("__last"))
    return held.withColumn("contiguous", whole).drop("__last", "__n", "__first")
