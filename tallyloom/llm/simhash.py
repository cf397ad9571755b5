"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within the bit limit differ by at
most one bit in some segment (limit // 2 + 1 segments). Each segment is indexed whole, and once
for each of its bits with that bit left out. Equal whole segments, or equal one-wildcard variants
whose left-out bits differ, bring each such pair together at least once; pairs are then verified.

A 64-bit fingerprint is too short to tell Jaccard similarities of 0.8: so many bits differ there that
segments would be a few bits wide. ``near_duplicates`` therefore takes the same deletion variants of
another signature: segments of min-hashes, each indexed once for each of its min-hashes left out, so
that texts meet where all but one of a segment's min-hashes agree. Pairs must then agree in a sketch
of single bits of further min-hashes and are verified exactly.

Exact copies share a fingerprint and are one row from the start. A group that shares a variant is
never expanded into pairs: first all of it is compared with one pivot, which merges what is near the
pivot; then, in a large group, only rows outside its leading class are compared with the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, mix
from .components import components

BITS = 64


def shingles(text: bytes | None, width: int) -> list[bytes]:
    """Space-joined word shingles of a text with A-Z lower-cased, repeats included."""
    words = (text or b"").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    whole = b" ".join(words)
    starts = [0, *(e + 1 for e in ends[: -width])]
    return [whole[s:e] for s, e in zip(starts, ends[width - 1 :], strict=True)]


def fingerprint(text: bytes | None, width: int) -> int:
    """Bitwise majority of the shingles' XXH64 (seed 42), as a signed 64-bit number."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles(text, width)], np.uint64)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.int64)[0]) if len(h) else 0


def fingerprint_column(text: Column, shingle_words: int) -> Column:
    """SimHash of a whole text. Null and wordless texts have fingerprint zero."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, shingle_words) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return run(text)


@dataclass(frozen=True)
class MinHashes:
    """``segments`` of ``width`` min-hashes for the variants, then a sketch of ``sketch`` longs with one
    bit of a min-hash each."""

    segments: int = 7
    width: int = 10
    sketch: int = 4

    def of(self, shingle_hashes: np.ndarray) -> np.ndarray:
        """The min-hashes of a set: the smallest of a * h + b (mod 2**64), for many odd a."""
        n = self.segments * self.width + self.sketch * BITS
        rng = np.random.default_rng(42)
        a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        if not len(shingle_hashes):
            return b
        out = np.full(n, ~np.uint64(0))
        for i in range(0, len(shingle_hashes), 512):
            out = np.minimum(out, (shingle_hashes[i : i + 512, None] * a + b).min(0))
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """A key for each segment and each of its min-hashes left out."""
        parts = mix(hashes[: self.segments * self.width].reshape(self.segments, self.width) + np.arange(1, self.width + 1, dtype=np.uint64))
        keys = parts.sum(1, dtype=np.uint64)[:, None] - parts  # the sum without one
        return mix(keys + np.arange(1, keys.size + 1, dtype=np.uint64).reshape(keys.shape)).reshape(-1)

    def bits(self, hashes: np.ndarray) -> np.ndarray:
        kept = mix(hashes[self.segments * self.width :]) & np.uint64(1)
        return np.packbits(kept.astype(np.uint8), bitorder="little").view(np.int64)


def signature_column(text: Column, shingle_words: int, kind: MinHashes) -> Column:
    """``size, keys, s0, s1...``: the number of a text's different shingles, its variants' keys and its sketch."""
    names = [f"s{i}" for i in range(kind.sketch)]

    @F.arrow_udf(f"struct<size:long,keys:array<long>,{','.join(f'{n}:long' for n in names)}>")
    def run(texts: pa.Array) -> pa.Array:
        size, keys, sketch = [], [], []
        for t in texts:  # one text at a time is a Python object
            h = np.array(list({xxhash.xxh64_intdigest(s, 42) for s in shingles((t.as_py() or "").encode(), shingle_words)}), np.uint64)
            minima = kind.of(h)
            size.append(len(h))
            keys.append(kind.keys(minima).view(np.int64))
            sketch.append(kind.bits(minima))
        sketch = np.array(sketch, np.int64).reshape(-1, kind.sketch)
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *[pa.array(sketch[:, i]) for i in range(kind.sketch)]], ["size", "keys", *names])

    return run(text)


def jaccard_column(a: Column, b: Column, shingle_words: int) -> Column:
    """Exact Jaccard similarity of two texts' shingle sets; two wordless texts are alike."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, known = [], None, frozenset()
        for x, y in zip(left.cast(pa.binary()).to_pylist(), right.cast(pa.binary()).to_pylist(), strict=True):
            if last is None or y != last:
                last, known = y, frozenset(shingles(y, shingle_words))
            s = frozenset(shingles(x, shingle_words))
            out.append(len(s & known) / len(s | known) if s or known else 1.0)
        return pa.array(out, pa.float64())

    return run(a, b)


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    n = max_bits // 2 + 1
    at = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def signed(x: int) -> int:
    """An unsigned 64-bit number as the signed one with the same bits."""
    return x - (1 << 64) if x >> 63 else x


def first_meeting(fp_a: Column, fp_b: Column, segment: Column, max_bits: int) -> Column:
    """Whether no segment before this one brings two fingerprints together too."""
    out = F.lit(True)
    for k, (first, width) in enumerate(_segments(max_bits)[:-1]):
        apart = F.bit_count(fp_a.bitwiseXOR(fp_b).bitwiseAND(F.lit(signed(((1 << width) - 1) << first)))) > min(1, max_bits)
        out = out & ((segment <= k) | apart)
    return out


def variants(fp: Column, max_bits: int) -> Column:
    """Array of ``(key, role, segment)``: role -1 for a whole segment, else the left-out bit's value."""

    def entry(segment: int, wildcard: int, mask: int, role: Column) -> Column:
        masked = fp.bitwiseAND(F.lit(signed(mask)))
        key = F.xxhash64(F.lit(segment * 100 + wildcard), masked)
        return F.struct(key.alias("key"), role.cast("byte").alias("role"), F.lit(segment).cast("byte").alias("segment"))

    out = []
    for k, (first, width) in enumerate(_segments(max_bits)):
        mask = ((1 << width) - 1) << first
        out.append(entry(k, 99, mask, F.lit(-1)))
        if max_bits:
            for bit in range(width):
                value = F.shiftrightunsigned(fp, first + bit).bitwiseAND(F.lit(1))
                out.append(entry(k, bit, mask & ~(1 << (first + bit)), value))
    return F.array(*out)


def link_classes(nodes: DataFrame, max_bits: int, large_group: int = 32) -> DataFrame:
    """``(node, root)`` of the nodes that are linked to others; ``nodes`` has ``node, fp`` (longs).
    Nodes are linked whose fingerprints differ in at most ``max_bits`` bits."""

    def like(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        return F.bit_count(a("fp").bitwiseXOR(b("fp"))) <= max_bits

    def once(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        return first_meeting(a("fp"), b("fp"), a("segment"), max_bits)

    return _link(nodes, ["fp"], variants(F.col("fp"), max_bits), like, once, lambda pairs: pairs, large_group)


def _link(nodes: DataFrame, carried: list[str], keys: Column, like: Callable, once: Callable | None, verify: Callable[[DataFrame], DataFrame], large_group: int, sparse: bool = False) -> DataFrame:
    """``(node, root)`` of linked nodes. ``keys`` are arrays of ``(key, role, segment)``; nodes meet at equal
    keys with role -1 or with differing roles. Pairs that are ``like`` by their ``carried`` columns,
    told ``once`` if that can be, go to ``verify``, which gets ``(a, b)`` and returns the links.

    In groups of ``large_group`` members or more the members of the leading class are compared with
    the others only. With ``sparse`` keys, of which few are shared, those of one node go first.

    Spark sizes a table as before its variants were inlined, some seventy times too low: joins on them ask for a merge
    join, as they would be broadcast otherwise.
    """
    # A row makes as many variants as it has bits or more: deal the rows over all tasks first.
    tasks = max(2, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inputs = [c for c in nodes.columns if c != "node" and not (sparse and c == "keys")]
    dealt = nodes.repartition(tasks, "node")
    keyed = dealt.select("node", *([] if sparse else carried), F.inline(keys))
    shared = keyed
    if sparse:
        some = F.hash("node")
        twice = keyed.groupBy("key").agg(F.min(some).alias("n0"), F.max(some).alias("n1")).where("n0 <> n1").select("key")
        shared = cut(keyed.join(cut(twice), "key", "left_semi"))
        keyed = shared.hint("merge").join(nodes.select("node", *carried), "node")
    named = lambda prefix: lambda c: F.col(f"{prefix}_{c}")

    # Every member of a group against the group's pivot: a whole segment's pivot is any member, a
    # wildcard group's pivot any member with the bit unset.
    pivots = keyed.where("role <= 0").groupBy(F.col("key").alias("p_key")).agg(*[F.max_by(c, "node").alias(f"p_{c}") for c in ("node", *carried)])
    same = (F.col("key") == F.col("p_key")) & (F.col("node") != F.col("p_node")) & like(F.col, named("p"))
    stars = keyed.where("role <> 0").hint("merge").join(pivots, same).select(F.col("node").alias("a"), F.col("p_node").alias("b")).distinct()
    stars = cut(verify(stars))
    first = cut(components(stars))

    # What is left: pairs across classes; in a large group, one of them is outside its leading class.
    sizes = first.groupBy("root").agg(F.count("*").alias("size"))
    placed = first.join(sizes, "root")
    known = cut(nodes.join(placed, "node", "left").select("node", *inputs, F.coalesce("root", "node").alias("root"), F.coalesce("size", F.lit(1)).alias("size")))
    keyed = shared.hint("merge").join(known, "node") if sparse else known.repartition(tasks, "node").select("node", *carried, "root", "size", F.inline(keys))
    leads = keyed.groupBy("key").agg(F.count("*").alias("members"), F.max_by("root", "size").alias("lead")).where(F.col("members") >= large_group)
    held = keyed.join(leads.select(F.col("key").alias("k"), "lead"), F.col("key") == F.col("k"), "left")
    left = held.where("lead is null or root <> lead").select(*[F.col(c).alias(f"a_{c}") for c in ("key", "node", "root", "role", "segment", *carried)], "lead")
    right = keyed.select(*[F.col(c).alias(f"b_{c}") for c in ("key", "node", "root", "role", *carried)])
    a, b = named("a"), named("b")
    meet = (
        (a("key") == b("key")) & (a("root") != b("root")) & ((a("role") == -1) | (a("role") != b("role"))) & like(a, b)
        & (F.coalesce(b("root") == F.col("lead"), F.lit(False)) | (a("node") < b("node")))
    )
    if once is not None:
        # Once for each pair: in the first segment that brings it together, from one side.
        meet = meet & once(a, b)
    rest = left.join(right.hint("merge"), meet).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    rest = verify(rest)
    stars = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.unionByName(rest.select("a", "b")))


def simhash_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Documents are linked when their fingerprints differ in at most ``max_bits`` bits; the component
    is the smallest id reachable. Null, empty and wordless texts have fingerprint zero and are
    linked like any other. Repeated rows each get a row. Null ids get a row, never name a component
    unless all ids of it are null. Other columns of ``docs`` are not read. An empty table gives an
    empty result.
    """
    prints = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col), shingle_words).alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = link_classes(distinct.select(F.col("fp").alias("node"), "fp"), max_bits)
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = cut(classes.join(named, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _text_key(text: Column) -> Column:
    """128 bits of a text; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, min_similarity: float = 0.8, kind: MinHashes = MinHashes(), max_bits: int = 36, large_group: int = 32,
) -> DataFrame:
    """One row per distinct text: ``text_key, doc_id, root, keep``.

    Texts are linked when the Jaccard similarity of their shingle sets is at least
    ``min_similarity``, verified exactly. Pairs are looked at that agree in all but one min-hash of a
    segment and whose sketches differ in at most ``max_bits`` bits: by computation 95 % of the pairs at
    a similarity of 0.8 and 99 % at 0.85 with the values given. ``doc_id`` is the smallest id with that
    text; ``keep`` marks the text with the smallest id of its class. Null and empty texts count as
    the same text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _text_key(F.col(text_col)).alias("text_key"))
    sketch = [f"s{i}" for i in range(kind.sketch)]
    # Every row is signed where it stands; signatures, not texts, meet their copies.
    prints = rows.select("text_key", "doc_id", signature_column(F.col("text"), shingle_words, kind).alias("p"))
    prints = prints.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("p").alias("p"))
    # Nodes are numbered by 64 bits of the key; a text without links is a class by its whole key.
    nodes = cut(prints.select(F.xxhash64("text_key").alias("node"), "text_key", "doc_id", F.col("p.size").alias("size_of"), "p.keys", *[F.col(f"p.{c}").alias(c) for c in sketch]))

    def like(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        apart = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in sketch[1:]), F.bit_count(a(sketch[0]).bitwiseXOR(b(sketch[0]))))
        return (apart <= max_bits) & (F.least(a("size_of"), b("size_of")) >= min_similarity * F.greatest(a("size_of"), b("size_of")))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        chosen = nodes.join(involved, "node").select("node", F.col("text_key").alias("k"), F.col("doc_id").alias("id"))
        # One carrier of each text: a row with the smallest id; its copies fold into it.
        texts = rows.join(chosen, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
        texts = cut(texts.dropDuplicates(["node"]))
        a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        scored = pairs.join(a, "a").join(b, "b")
        return scored.where(jaccard_column(F.col("text_a"), F.col("text_b"), shingle_words) >= min_similarity).select("a", "b")

    keys = F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(-1).cast("byte").alias("role"), F.lit(0).cast("byte").alias("segment")))
    roots = _link(nodes.select("node", "size_of", "keys", *sketch), ["size_of", *sketch], keys, like, None, verify, large_group, sparse=True)
    classes = nodes.select("node", "text_key", "doc_id").join(roots, "node", "left").select("text_key", "doc_id", F.coalesce(F.col("root").cast("string"), "text_key").alias("root"))
    # Ties on the id (null or repeated ids) fall to the smaller key; a null id loses to any other.
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    first = classes.groupBy("root").agg(F.min(order)["text_key"].alias("kept"))
    return classes.join(first, "root").select("text_key", "doc_id", "root", (F.col("text_key") == F.col("kept")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document left of each near-duplicate class, all columns kept.

    The document with the smallest id stays; among copies of its text, one row stays. Null and empty
    texts are one text; an empty table stays empty.
    """
    key, first = free_names(docs, "__key", "__first")
    verdict = near_duplicates(docs, id_col, text_col, **options).where("keep").select(F.col("text_key").alias(key), F.col("doc_id").alias(first))
    held = docs.withColumn(key, _text_key(F.col(text_col)))
    kept = held.join(cut(verdict), key).where(F.col(id_col).cast("long").eqNullSafe(F.col(first)))
    return kept.dropDuplicates([key]).select(*docs.columns)
