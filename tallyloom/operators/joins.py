"""Joins that measure their keys: small sides are broadcast, hot keys are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shared import cut

#: A side with this many rows at most is broadcast (rows of short columns: some tens of MB).
BROADCAST_ROWS = 200_000
#: A key with a thousandth of all rows or more is hot; there are a thousand of them at most.
HOT_SHARE = 1000


def keyed_join(rows: DataFrame, facts: DataFrame, keys: list[str], broadcast_rows: int = BROADCAST_ROWS, hot_share: int = HOT_SHARE) -> DataFrame:
    """``rows`` inner-joined with ``facts``, which has one row for each key; null keys equal each other.

    ``facts`` is broadcast where it has ``broadcast_rows`` rows at most. Otherwise the keys of ``rows`` are counted, the
    hot ones broadcast as a list, their rows salted by a hash of the row and their facts repeated for each salt; all
    other keys meet in one shuffle.
    """
    renamed = facts.select(*[F.col(k).alias(f"__f{i}") for i, k in enumerate(keys)], *[c for c in facts.columns if c not in keys])
    renamed = cut(renamed)
    same = lambda left: [left[k].eqNullSafe(F.col(f"__f{i}")) for i, k in enumerate(keys)]
    names = [f"__f{i}" for i in range(len(keys))]
    if renamed.count() <= broadcast_rows:
        return rows.join(F.broadcast(renamed), same(rows)).drop(*names)
    rows = cut(rows)
    salts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    floor = max(1, rows.count() // hot_share)
    counted = rows.groupBy(*[F.col(k).alias(f"__f{i}") for i, k in enumerate(keys)]).count().where(F.col("count") > floor)
    hot = cut(counted.select(*names, F.lit(True).alias("__hot")))
    marked = rows.join(F.broadcast(hot), same(rows), "left").drop(*names)
    salted = marked.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("__hot")
    again = [renamed[n].eqNullSafe(hot[n]) for n in names]
    repeated = renamed.join(F.broadcast(hot), again, "left").select(*[renamed[c] for c in renamed.columns], "__hot")
    each = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    repeated = repeated.withColumn("__at", F.explode(each)).drop("__hot")
    return salted.join(repeated, [*same(salted), F.col("__salt") == F.col("__at")]).drop(*names, "__salt", "__at")


def ranks_within(rows: DataFrame, keys: list[str], place: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 1 within each key in the order of ``place``, a total order, however many rows one
    key has: rows are sorted by range, and a key that begins in an earlier range goes on from its rows there."""
    from tallyloom.operators.order import global_rank

    ordered = [*keys, *place]
    ranked = cut(global_rank(rows, [F.col(c) for c in ordered], "__all"))
    firsts = ranked.groupBy(*keys).agg(F.min("__all").alias("__first"))
    joined = keyed_join(ranked, firsts, keys)
    return joined.withColumn(name, F.col("__all") - F.col("__first") + 1).drop("__all", "__first")
