"""Connected components of a link table, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written table, its number of rows and a sum over them that any change alters."""
    seen = Observation()
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")
    edges = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), mark))
    return edges, (seen.get.get("n") or 0, seen.get.get("mark"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of ``links (a, b)``; the root is the smallest node reached.

    Large-star and small-star rounds: each replaces a node's links by links to the smallest node
    it knows, so the table never grows beyond its first size and a chain of length n needs about
    log n rounds. Every round is written to the shared folder. Null ends and loops are
    left out; repeated links count once; an empty table gives an empty result.
    """
    start = links.where("a is not null and b is not null and a <> b")
    edges, seen = _counted(start.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds if seen[0] else 0):
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = _counted(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
