"""Digests of signal series."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shared import cut
from tallyloom.operators.joins import ranks_within


def _digest_column(xs: Column, ys: Column) -> Column:
    @F.arrow_udf("struct<x:string,y:string,xy:string>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = []
        for x, y in zip(a, b, strict=True):
            x, y = (np.asarray(v.values.to_numpy(zero_copy_only=False), ">f8") for v in (x, y))
            both = np.column_stack([x, y]).astype(">f8").tobytes()
            rows.append({"x": hashlib.sha256(x.tobytes()).hexdigest(), "y": hashlib.sha256(y.tobytes()).hexdigest(), "xy": hashlib.sha256(both).hexdigest()})
        return pa.array(rows, pa.struct([(n, pa.string()) for n in ("x", "y", "xy")]))

    return run(xs, ys)


def series_fingerprints(points: DataFrame, key: list[str], place: list[str]) -> DataFrame:
    """``key, n_points, sha256_x, sha256_y, sha256_xy``: digests of the big-endian doubles of each
    series in point order. One series is one array, as instruments deliver them."""
    parts = F.sort_array(F.collect_list(F.struct(*place, "x", "y")))
    held = points.groupBy(*key).agg(parts.alias("p"))
    d = _digest_column(F.transform("p", lambda v: v["x"]), F.transform("p", lambda v: v["y"]))
    out = held.select(*key, F.size("p").cast("long").alias("n_points"), d.alias("d"))
    return out.select(*key, "n_points", F.col("d.x").alias("sha256_x"), F.col("d.y").alias("sha256_y"), F.col("d.xy").alias("sha256_xy"))


def series_tree_digests(points: DataFrame, key: list[str], place: list[str], text: Column, run: int = 65_536, fan: int = 4_096) -> DataFrame:
    """``key, n_points, digest``: a digest of each series' points in order, for series of any length.

    Points are numbered within their series by ranges, runs of ``run`` points are digested each for itself (the
    points' ``text`` between line feeds), and ``fan`` digests at a time are digested together until one is
    left; a digest alone stays as it is. No series is one row or one task, and the result depends neither on
    partitions nor on other series.
    """
    ranked = ranks_within(points.select(*key, *place, text.alias("__text")), key, place, "__rank")
    part = F.floor((F.col("__rank") - 1) / run).cast("long").alias("__part")
    ordered = lambda at, value: F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda x: x[value])
    level = ranked.groupBy(*key, part).agg(F.count("*").alias("n_points"), F.sha2(F.array_join(ordered("__rank", "__text"), "\n"), 256).alias("__d"))
    level = cut(level)
    most = (level.agg(F.max("__part")).first()[0] or 0) + 1
    while most > 1:
        joined = F.array_join(ordered("__part", "__d"), "")
        level = level.groupBy(*key, F.floor(F.col("__part") / fan).cast("long").alias("__up")).agg(F.sum("n_points").alias("n_points"), F.when(F.count("*") == 1, F.first("__d")).otherwise(F.sha2(joined, 256)).alias("__d"))
        level = level.withColumnRenamed("__up", "__part")
        most = -(-most // fan)
    return level.select(*key, "n_points", F.col("__d").alias("digest"))


def scan_statistics(points: DataFrame, key: list[str]) -> DataFrame:
    """Per scan: sum, least and greatest intensity, mass range and number of points."""
    return points.groupBy(*key).agg(
        F.sum("intensity").alias("total"), F.min("intensity").alias("least"), F.max("intensity").alias("greatest"),
        F.min("mass_raw").alias("mass_from"), F.max("mass_raw").alias("mass_to"), F.count("*").alias("n_points"),
    )


def duplicate_payloads(blocks: DataFrame, key: list[str], payload: str) -> DataFrame:
    """Keys whose stored copies of a block differ."""
    return blocks.groupBy(*key).agg(F.count_distinct(F.sha2(payload, 256)).alias("n")).where("n > 1").drop("n")
