"""Line dedup through a deletion-neighbourhood join.

Lines within the edit bound share a deletion variant: both, with as many characters deleted as the
bound allows, can be made equal. Every variant is emitted as a hashed key, equal keys are joined and
the edit distance is verified. Before that, for the bound of one, lines that can't have a partner
are left out without loss: two lines within one edit agree in their first or in their last half,
where the half is taken of the longer one's length.

Equal lines are one row throughout, named by their earliest place, so a line that a third of all
documents share costs no more than any other. Within a variant's group, pairs are not emitted: each
member is compared with the group's earliest member first, and only the others with one another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import POWERS, SPACE, cut, free_names, mix, spread


def variant_hashes(line: str, max_edits: int) -> np.ndarray:
    """Hashes of a line and of all lines made from it by up to ``max_edits`` (0 to 2) deletions.

    Polynomial hashes over code points: what is left of a deleted character keeps its powers, what
    is right of it moves down by one for each deletion, so no variant is ever built.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    p = POWERS.upto(n + 2)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p.up[:n], out=total[1:])
    out = [np.array([total[n]], np.uint64)]
    down = p.down[1]
    if max_edits >= 1:
        out.append(total[:-1] + (total[n] - total[1:]) * down)
    if max_edits >= 2:
        for i in range(n - 1):
            mid, right = total[i + 1 : n] - total[i + 1], total[n] - total[i + 2 :]
            out.append(total[i] + mid * down + right * down * down)
    return mix(np.unique(np.concatenate(out)))


def deletion_variants(line: Column, max_edits: int) -> Column:
    """The variant hashes of a column of lines."""
    if max_edits not in (0, 1, 2):
        raise ValueError("max_edits is 0, 1 or 2")

    @F.arrow_udf("array<long>")
    def run(lines: pa.Array) -> pa.Array:
        return pa.array([variant_hashes(x, max_edits).view(np.int64) for x in lines.to_pylist()], pa.list_(pa.int64()))

    return run(line)


def _half_keys(line: Column) -> Column:
    """Keys that two lines within one edit share at least one of: first and last halves, for the
    longer one's length being this one's or one more."""

    def keys(longest: Column) -> list[Column]:
        half = F.floor((longest - 1) / 2).cast("int")
        return [
            F.xxhash64(F.lit(0), longest, F.substring(line, 1, half)),
            F.xxhash64(F.lit(1), longest, F.when(half > 0, F.right(line, half)).otherwise("")),
        ]

    return F.array(*keys(F.length(line)), *keys(F.length(line) + 1))


def _line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, at, line`` for each line that has a word; ``doc`` orders and names the row."""
    doc = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    rows = docs.select(doc.alias("doc"), F.posexplode_outer(F.split(F.col(text_col), "\n")).alias("at", "line"))
    return rows.where(F.trim("line", F.lit(" \t\n\x0b\f\r")) != "")


def line_facts(docs: DataFrame, id_col: str, text_col: str, max_edits: int, min_chars: int) -> DataFrame:
    """``doc, at, h, halves`` of each line with a word, written once for all later steps."""
    lines = _line_table(docs, id_col, text_col)
    able = (F.length("line") >= min_chars - max_edits) if max_edits == 1 else F.lit(False)
    halves = F.when(able, _half_keys(F.col("line"))).otherwise(F.array().cast("array<long>"))
    return cut(lines.select("doc", "at", _line_hash(F.col("line")).alias("h"), halves.alias("halves")))


def _line_hash(line: Column) -> Column:
    """128 bits: two lines are the same if these are."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def duplicate_lines(
    docs: DataFrame, facts: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 20
) -> DataFrame:
    """``h, first, n, near``: each distinct line's hash, its earliest place, how often it stands, and
    whether an earlier line is within the edit bound. ``facts`` are the documents' ``line_facts``.

    Places are ordered by document id, then text digest, then line number; null ids come last.
    Lines under ``min_chars`` characters are compared for equality only.
    """
    firsts = cut(facts.groupBy("h").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")))
    if not max_edits:
        return firsts.withColumn("near", F.lit(False))
    able = _line_table(docs, id_col, text_col).where(F.length("line") >= min_chars - max_edits).withColumn("h", _line_hash(F.col("line")))
    if max_edits == 1:
        halves = facts.select(F.col("h.a").alias("ha"), F.explode("halves").alias("k"))
        shared = halves.groupBy("k").agg(F.min("ha").alias("h0"), F.max("ha").alias("h1")).where("h0 <> h1").select("k")
        partnered = cut(halves.join(shared, "k", "left_semi").select("ha").distinct())
        able = able.join(partnered, F.col("h.a") == F.col("ha"), "left_semi")
    chosen = firsts.select(F.col("h").alias("fh"), "first")
    able = able.join(chosen, (F.col("h") == F.col("fh")) & (F.struct("doc", "at") == F.col("first"))).select("h", "first", "line")
    # Rows that agree in id and text share their places: one of them is enough.
    near = near_lines(cut(able.dropDuplicates(["h"])), max_edits, min_chars)
    near = near.select(F.col("h").alias("nh")).distinct()
    return firsts.join(near, F.col("h") == F.col("nh"), "left").select("h", "first", "n", F.col("nh").isNotNull().alias("near"))


def near_lines(lines: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """Those of the distinct ``lines (h, first, line)`` that an earlier one is within the bound of."""
    # A row makes as many variants as it has characters: deal the rows over all tasks first.
    lines = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
    keys = cut(lines.select("h", "first", F.explode(deletion_variants(F.col("line"), max_edits)).alias("v")))
    groups = keys.groupBy("v").agg(F.min("first").alias("lead"), F.max("first").alias("last")).where("lead <> last")
    groups = cut(groups.select("v", "lead"))
    text = lines.select(F.col("h").alias("th"), F.col("first").alias("tf"), F.col("line").alias("tl"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs ``(h, early)``, the hashes whose line is within the bound of the early one."""
        pairs = pairs.distinct().join(text.select("th", F.col("tl").alias("line_a")), F.col("h") == F.col("th")).drop("th")
        pairs = pairs.join(text.select("tf", F.col("tl").alias("line_b")), F.col("early") == F.col("tf")).drop("tf")
        close = F.levenshtein("line_a", "line_b", max_edits)
        long = F.greatest(F.length("line_a"), F.length("line_b")) >= min_chars
        return pairs.where(long & (close >= 0)).select("h").distinct()

    members = cut(keys.join(groups, "v"))
    found = cut(verified(members.where("first > lead").select("h", F.col("lead").alias("early"))))
    # Members that aren't near their group's earliest one, against the earlier ones of the group.
    open_ = members.where("first > lead").join(found, "h", "left_anti")
    early = members.select(F.col("v").alias("v2"), F.col("first").alias("early"))
    rest = open_.join(early, (F.col("v") == F.col("v2")) & (F.col("early") > F.col("lead")) & (F.col("early") < F.col("first")))
    return found.unionByName(verified(rest.select("h", "early")))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 20
) -> DataFrame:
    """``docs`` with repeated lines cut out of the texts; two columns ``n_exact, n_near`` are added.

    A line goes if an equal line stands earlier, or if it has ``min_chars`` characters or more and
    an earlier line is within ``max_edits`` edits (``n_near``; the earlier line may itself have
    gone). Earlier means a smaller document id, then a smaller text digest, then a smaller line
    number; null ids come last. Lines without a word always stay. Rows that agree in id and text
    have the same places, so all of them keep the same lines. Null texts stay null; a text that
    loses all lines becomes empty. All rows and columns stay; input columns named like the added
    ones are replaced. An empty table gives an empty result.
    """
    facts = line_facts(docs, id_col, text_col, max_edits, min_chars)
    firsts = cut(duplicate_lines(docs, facts, id_col, text_col, max_edits, min_chars))
    # A line that stands once, and isn't near another, stays.
    lines, firsts = spread(facts.select("doc", "at", "h"), firsts.where("n > 1 or near"), "h", "n", facts.count(), ["doc", "at"])
    judged = lines.join(firsts, ["h", "salt"]).where("near or struct(doc, at) <> first")
    own_gone, own_exact, own_d, own_doc, own_lines = free_names(docs, "__gone", "__exact", "__d", "__doc", "__lines")
    gone = judged.groupBy("doc").agg(
        F.sort_array(F.collect_set("at")).alias(own_gone),
        F.count_distinct(F.when(F.struct("doc", "at") != F.col("first"), F.col("at"))).alias(own_exact),
    )
    doc = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    held = docs.withColumn(own_doc, doc)
    joined = held.join(gone.withColumnRenamed("doc", own_d), F.col(own_doc).eqNullSafe(F.col(own_d)), "left")
    # The lines between one gone line and the next, joined again.
    split = F.split(F.col(text_col), "\n")
    gaps = F.zip_with(
        F.concat(F.array(F.lit(-1)), F.col(own_gone)), F.concat(F.col(own_gone), F.array(F.size(split))), lambda a, b: F.struct((a + 1).alias("from"), b.alias("to"))
    )
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col(own_lines), g["from"] + 1, g["to"] - g["from"])))
    joined = joined.withColumn(own_lines, F.when(F.col(own_gone).isNotNull(), split))
    text = F.when(F.col(own_gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n_exact = F.coalesce(own_exact, F.lit(0)).cast("long")
    columns = [c for c in docs.columns if c not in ("n_exact", "n_near")]
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in columns],
        n_exact.alias("n_exact"), (F.coalesce(F.size(own_gone), F.lit(0)).cast("long") - n_exact).alias("n_near"),
    )


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_exact, n_near, text_sha256`` (of the text that is left; null for a null text)."""
    out = dedup_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **options)
    return out.select("doc_id", "n_exact", "n_near", F.sha2("text", 256).alias("text_sha256"))


#: Ids must be unique here; a repeated id has no order in SQL.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, doc_id, pos, length(line) AS n FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM w) WHERE k = 1),
m AS (SELECT *, unnest([n, n + 1]) AS m FROM f WHERE n >= 19),
k AS (
  SELECT line, doc_id, pos, n, m, 0 AS side, substr(line, 1, CAST(floor((m - 1) / 2) AS BIGINT)) AS half FROM m
  UNION ALL SELECT line, doc_id, pos, n, m, 1, right(line, CAST(floor((m - 1) / 2) AS BIGINT)) FROM m),
c AS (
  SELECT DISTINCT a.line AS x, b.line AS y, a.n AS nx, b.n AS ny FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.half = b.half
  WHERE a.line <> b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.pos < a.pos)) AND greatest(a.n, b.n) >= 20),
e AS (
  SELECT DISTINCT x FROM c WHERE
    CASE WHEN nx = ny THEN len(list_filter(range(1, nx + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) <= 1
      WHEN nx = ny + 1 THEN len(list_filter(range(0, nx), lambda i: substr(x, 1, i) = substr(y, 1, i) AND substr(x, i + 2) = substr(y, i + 1))) > 0
      WHEN ny = nx + 1 THEN len(list_filter(range(0, ny), lambda i: substr(y, 1, i) = substr(x, 1, i) AND substr(y, i + 2) = substr(x, i + 1))) > 0
      ELSE false END),
j AS (
  SELECT w.doc_id, w.pos, (w.doc_id <> f.doc_id OR w.pos <> f.pos) AS exact, e.x IS NOT NULL AS near
  FROM w JOIN f ON w.line = f.line LEFT JOIN e ON w.line = e.x),
t AS (
  SELECT l.doc_id, count(*) FILTER (WHERE coalesce(exact, false)) AS n_exact, count(*) FILTER (WHERE coalesce(near AND NOT exact, false)) AS n_near,
    string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE NOT coalesce(exact OR near, false)) AS kept
  FROM l LEFT JOIN j ON l.doc_id = j.doc_id AND l.pos = j.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(t.n_exact, 0) AS BIGINT) AS n_exact, CAST(coalesce(t.n_near, 0) AS BIGINT) AS n_near,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(t.kept, '')) END AS text_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
