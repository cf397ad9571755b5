"""Digest trees over hash ranges: one digest for a table, and comparison that only reads what differs.

A row's place is the start of the hexadecimal digest of its key, as long as the number of rows asks for:
sixteen times the rows make it a digit longer, so a range never holds many. A node's digest is made of its
children's, from ranges of rows up to the root. Two trees are compared from the root, level by level, and of
two tables only the rows of differing ranges meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shared import cut

#: Rows in a range on average, at most. Ranges vary little around it, being dealt by a digest.
RANGE_ROWS = 2_048


def depth_for(n_rows: int, range_rows: int = RANGE_ROWS) -> int:
    """Digits of a range: the fewest with ``range_rows`` rows or less in a range on average."""
    depth = 0
    while n_rows > range_rows * 16**depth:
        depth += 1
    return depth


def placed(rows: DataFrame, key: Column, depth: int) -> DataFrame:
    """``rows`` with ``range``, their place's first digits."""
    return rows.withColumn("range", F.substring(F.sha2(key, 256), 1, depth))


def row_digest(columns: list[str]) -> Column:
    """A digest of a row's values: each as text with its length before it; null as no length."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(",", *parts), 256)


def tree(rows: DataFrame, key: Column, digest: Column, depth: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``level, range, n_rows, digest`` of all nodes: level 0 is the root, the deepest ones are ranges of rows.

    A range's digest is that of its rows' digests, sorted; a node's that of its children's in order. So the
    order and the partitioning of rows don't matter, and repeated rows count. An empty table has a root without rows.
    """
    if depth is None:
        depth = depth_for(rows.count(), range_rows)
    leaves = placed(rows.select(key.alias("__key"), digest.alias("__row")), F.col("__key"), depth).groupBy("range")
    level = leaves.agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.sort_array(F.collect_list("__row")), ""), 256).alias("digest"))
    level = cut(level.select(F.lit(depth).alias("level"), "range", "n_rows", "digest"))
    out = level
    for number in range(depth - 1, -1, -1):
        children = F.sort_array(F.collect_list(F.struct("range", "digest")))
        level = level.groupBy(F.substring("range", 1, number).alias("range")).agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest"))
        level = level.select(F.lit(number).alias("level"), "range", "n_rows", "digest")
        out = out.unionByName(level)
    if depth == 0:
        empty = F.struct(F.lit(0).alias("level"), F.lit("").alias("range"), F.lit(0).cast("long").alias("n_rows"), F.sha2(F.lit(""), 256).alias("digest"))
        out = out.groupBy().agg(F.coalesce(F.first(F.struct("level", "range", "n_rows", "digest")), empty).alias("r")).select("r.*")
    return cut(out)


def root(nodes: DataFrame) -> str:
    """The whole table's digest."""
    return nodes.where("level = 0").first()["digest"]


def differing_ranges(a: DataFrame, b: DataFrame, most_nodes: int = 4_096) -> tuple[list[str] | DataFrame, int, int]:
    """Ranges whose rows differ between two trees of one depth, the depth, and how many nodes were compared.

    From the root on, a level's nodes are looked at only below nodes that differ. The ranges come as a list
    while they are ``most_nodes`` at most, and as a table with a column ``range`` otherwise.
    """
    depths = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    if depths[0] != depths[1]:
        raise ValueError("trees of different depths: give both tables one depth")
    ranges: list[str] = [""]
    compared = 0
    for level in range(depths[0] + 1):
        below = [x + d for x in ranges for d in "0123456789abcdef"] if level else [""]
        if len(below) > most_nodes:  # so many differ that whole levels are compared
            leaf = lambda t: t.where(F.col("level") == depths[0]).select("range", "digest")
            apart = leaf(a).withColumnRenamed("digest", "__a").join(leaf(b).withColumnRenamed("digest", "__b"), "range", "full").where("not (__a <=> __b)")
            return apart.select("range"), depths[0], compared
        here = lambda t, side: t.where((F.col("level") == level) & F.col("range").isin(below)).select("range", F.col("digest").alias(side))  # noqa: E731, B023
        both = here(a, "__a").join(here(b, "__b"), "range", "full").collect()
        compared += len(both)
        ranges = sorted(r["range"] for r in both if r["__a"] != r["__b"])
        if not ranges:
            break
    return ranges, depths[0], compared


def write_ranges(rows: DataFrame, key: Column, depth: int, path: str) -> None:
    """Writes ``rows`` with their ``range``, sorted by it, so that reading a few ranges skips the rest."""
    placed(rows, key, depth).repartitionByRange("range").sortWithinPartitions("range").write.parquet(path)


def changes(reviewed: DataFrame, rebuilt: DataFrame, key: str, columns: list[str], range_rows: int = RANGE_ROWS, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``key, change, a, b``: rows that were added, removed or changed between two tables with unique keys.

    Only rows in differing ranges are compared. Tables that hold a column ``range`` of the trees' depth (see
    ``write_ranges``) are filtered on it in the scan. A null key is one key. Equal tables give no rows.
    """
    if trees is None:
        # Both tables are written once: their columns, which may be digests of contents, aren't made again for each reading.
        names = list(dict.fromkeys([key, *columns]))
        reviewed, rebuilt = (cut(t.select(*names)) for t in (reviewed, rebuilt))
        depth = depth_for(max(reviewed.count(), rebuilt.count()), range_rows)
        trees = tuple(tree(t, _text(key), row_digest(columns), depth) for t in (reviewed, rebuilt))
    found, depth, _ = differing_ranges(*trees)

    def side(t: DataFrame, name: str) -> DataFrame:
        held = t if "range" in t.columns else placed(t, _text(key), depth)
        held = held.where(F.col("range").isin(found)) if isinstance(found, list) else held.join(found, "range", "left_semi")
        return held.select(F.col(key).alias("__k"), F.struct(*columns).alias(name))

    a, b = side(reviewed, "a").withColumnRenamed("__k", "__ka"), side(rebuilt, "b").withColumnRenamed("__k", "__kb")
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("changed")
    both = a.join(b, F.col("__ka").eqNullSafe(F.col("__kb")), "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(F.coalesce("__ka", "__kb").alias(key), change.alias("change"), "a", "b")


def _text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))
