"""Exact substring dedup with sparse suffix arrays.

Suffixes are kept at minimiser positions only: of each run of consecutive k-mers (k words), the one
with the smallest hash. Any stretch of ``min_words`` words holds one, at the same place wherever the
stretch stands. Suffixes whose k-mer is nowhere else are left out; the others are sorted by what
follows and, a second time, by what precedes; neighbours in either order are compared, and a match
is extended right and left from the minimiser. Long matches are found piecewise, minimiser by
minimiser, so a bounded context of each suffix is enough, and pieces are merged.

A suffix's nearest neighbours can hide a partner that is good on both sides. So the windows of
``min_words`` words through a minimiser that no neighbour covers are looked up by their hashes, and
those that stand twice are matches too: no repeated window is missed.

Copies of a text are one text from the start and suffixes with equal contexts one suffix, so neither
copies nor a passage that a third of all documents share meet in one task; the sorts are by range of
the whole context, which splits what a hash of one key could not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, LOWER_BYTES, byte_words, cut, merge_spans, range_hashes, spread


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words, with A-Z in lower case."""
    data = LOWER_BYTES[np.frombuffer(text or b"", np.uint8)]
    return range_hashes(data, *byte_words(data))


def kmer_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    return range_hashes(words, np.arange(n), np.arange(k, k + n)) if n > 0 else np.zeros(0, np.uint64)


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the leftmost smallest hash of every run of ``window`` consecutive ones."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.concatenate([i + runs[i : i + 65536].argmin(1) + np.arange(len(runs[i : i + 65536])) for i in range(0, len(runs), 65536)]))


def retained_suffixes(texts: DataFrame, k: int, window: int) -> DataFrame:
    """``doc_id, digest, pos, g``: the minimisers of ``texts (doc_id, digest, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                g = kmer_hashes(word_hashes(text), k)
                pos = minimisers(g, window)
                found.append((pos, g[pos]))
            size = [len(p) for p, _ in found]
            row = np.repeat(np.arange(len(size)), size)
            pos = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
            g = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(g.view(np.int64))], ["doc_id", "digest", "pos", "g"]
            )

    return texts.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest long, pos int, g long")


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, digest, text`` of the rows with a text."""
    text = F.col(text_col)
    return docs.where(text.isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def repeated_kmers(suffixes: DataFrame) -> DataFrame:
    """``g, n`` of the k-mers that stand in two places or more, copies of a text being one.

    Three small numbers for each k-mer, so the aggregation combines before the shuffle.
    """
    place = F.hash("digest", "pos")
    seen = suffixes.groupBy("g").agg(F.min(place).alias("p0"), F.max(place).alias("p1"), F.count("*").alias("n"))
    return seen.where("p0 <> p1").select("g", "n")


def repeated_seeds(suffixes: DataFrame) -> DataFrame:
    """Per text, the positions whose k-mer also stands elsewhere: ``digest, first_doc, spots``."""
    repeated = cut(repeated_kmers(suffixes))
    held, repeated = spread(suffixes, repeated, "g", "n", suffixes.count(), ["digest", "pos"])
    return held.join(repeated, ["g", "salt"], "left_semi").groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.sort_array(F.collect_set("pos")).alias("spots"))


def _contexts(texts: DataFrame, spots: DataFrame, before: int, after: int) -> DataFrame:
    """``digest, pos, ahead, behind``: 4-byte word hashes from each spot on, and back from it."""
    chosen = spots.select(F.col("digest").alias("d"), "first_doc", "spots")
    rows = texts.join(chosen, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("digest", "text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for digest, text, at in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (word_hashes(text) >> np.uint64(32)).astype(">u4")
                for p in at:
                    for column, value in zip(out, (digest, p, words[p : p + after].tobytes(), words[max(0, p - before) : p][::-1].tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["digest", "pos", "ahead", "behind"]
            )

    return rows.mapInArrow(run, "digest long, pos int, ahead binary, behind binary").withColumn("c", F.xxhash64("ahead", "behind"))


def shared_prefix(a: bytes, b: bytes) -> int:
    """Words (4 bytes each) that two contexts share from their start."""
    n = min(len(a), len(b)) // 4
    differ = np.flatnonzero(np.frombuffer(a, ">u4", n) != np.frombuffer(b, ">u4", n))
    return int(differ[0]) if len(differ) else n


def _neighbours(contexts: DataFrame, order: list[str], min_words: int) -> DataFrame:
    """``c, left, right, other`` for neighbours in ``order`` that match over ``min_words`` words."""
    schema = "c long, left int, right int, other long, task int, edge int, ahead binary, behind binary"

    def compare(a: tuple, b: tuple) -> list[tuple]:
        left, right = shared_prefix(a[2], b[2]), shared_prefix(a[1], b[1])
        if left + right < min_words:
            return []
        return [(a[0], left, right, b[3]), (b[0], left, right, a[3])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last is not None:
                    out += compare(last, row)
                first, last = first or row, row
            yield table([(*x, None, None, None, None) for x in out])
        # The rows at the task's ends meet their neighbours in other tasks.
        if first:
            yield table([(x[0], None, None, x[3], task, e, x[1], x[2]) for e, x in ((0, first), (1, last))])

    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["c", "left", "right", "other", "task", "edge", "ahead", "behind"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    tasks = max(2, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = contexts.select("c", "ahead", "behind", "carrier", *[F.col(x).alias(f"o{i}") for i, x in enumerate(order)])
    keys = [f"o{i}" for i in range(len(order))] + ["c"]
    ranged = ranged.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select("c", "ahead", "behind", "carrier")
    seen = cut(ranged.mapInArrow(scan, schema))

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)]
        rows = [(c, a, z, o) for c, a, z, o, *_ in sorted(rows, key=lambda r: r[4:])]
        out = [x for a, b in zip(rows, rows[1:], strict=False) if a[0] != b[0] for x in compare(a, b)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types[:4])], names[:4])

    # Two rows for each task of the sort.
    ends = seen.where("task is not null").select("c", "ahead", "behind", "other", "task", "edge").coalesce(1).mapInArrow(join_ends, "c long, left int, right int, other long")
    return seen.where("task is null").select("c", "left", "right", "other").unionByName(ends)


def _open_windows(contexts: DataFrame, matches: DataFrame, min_words: int) -> DataFrame:
    """``c, left, h``: the windows of ``min_words`` words through each context's minimiser
    that no match covers, with the words before the minimiser and the window's hash."""
    found = matches.groupBy("c").agg(F.collect_set(F.struct("left", "right")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in kinds]
            for c, ahead, behind, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = np.concatenate([np.frombuffer(behind, ">u4")[::-1], np.frombuffer(ahead, ">u4")]).astype(np.uint64)
                before = len(behind) // 4
                start = np.arange(0, max(0, min(before, len(words) - min_words) + 1))
                for s in spans or []:
                    start = start[(before - start > s["left"]) | (start + min_words - before > s["right"])]
                # The minimiser's place counts: one place's window isn't two through two minimisers.
                h = (range_hashes(words, start, start + min_words) + (before - start).astype(np.uint64) * np.uint64(BASE)).view(np.int64)
                for part, value in zip(parts, (np.full(len(h), c), before - start, h), strict=True):
                    part.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), t) for p, t in zip(parts, kinds, strict=True)], ["c", "left", "h"])

    rows = contexts.join(found, "c", "left").select("c", "ahead", "behind", "found")
    return rows.mapInArrow(run, "c long, left int, h long")


def _window_matches(contexts: DataFrame, matches: DataFrame, min_words: int) -> DataFrame:
    """``c, left, right, other`` for the open windows that stand in two contexts or more."""
    windows = cut(_open_windows(contexts, matches, min_words))
    some = F.hash("c")
    seen = windows.groupBy("h").agg(F.min(some).alias("s0"), F.max(some).alias("s1"), F.count("*").alias("n")).where("s0 <> s1").select("h", "n")
    held, seen = spread(windows, cut(seen), "h", "n", windows.count(), ["c", "left"])
    twice = cut(held.join(seen, ["h", "salt"], "left_semi").select("h", "c", "left").join(contexts.select("c", "carrier", "last"), "c"))
    ends = twice.groupBy("h").agg(F.min("carrier").alias("d0"), F.max("last").alias("d1"), F.count("*").alias("n"))
    twice, ends = spread(twice, cut(ends), "h", "n", twice.count(), ["c", "left"])
    twice = twice.join(ends, ["h", "salt"])
    return twice.select("c", "left", (F.lit(min_words) - F.col("left")).alias("right"), F.explode(F.array("d0", "d1")).alias("other"))


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, k: int = 16
) -> DataFrame:
    """``doc_id, start, end, other_doc_id``: the stretches of each document, in words, that match
    ``min_words`` consecutive words or more elsewhere, and the smallest id of one place they match.

    Every word of every window of ``min_words`` words that stands twice or more is told. Words are
    runs of other than ASCII white space, A-Z in lower case. Touching stretches are one row. A match
    inside one document counts. Rows with equal texts are copies: with ``min_words`` words or more,
    all of the text is one stretch, and each copy gets the rows of its text. Null texts and texts
    under ``min_words`` words have no rows, and null ids stay null. An empty table gives an empty
    result; other columns are not read.
    """
    window = min_words - k + 1
    texts = distinct_texts(docs, id_col, text_col)
    suffixes = cut(retained_suffixes(texts, k, window))
    spots = repeated_seeds(suffixes)
    contexts = cut(_contexts(texts, spots, window - 1, min_words).dropDuplicates(["digest", "pos"]))
    place = F.struct("digest", "pos")
    distinct = cut(
        contexts.groupBy("c").agg(
            F.first("ahead").alias("ahead"), F.first("behind").alias("behind"), F.min("digest").alias("carrier"), F.max("digest").alias("last"), (F.min(place) != F.max(place)).alias("repeated"), F.count("*").alias("n")
        )
    )
    words = lambda c: (F.length(c) / 4).cast("int")
    same = distinct.where("repeated").select("c", words("behind").alias("left"), words("ahead").alias("right"), F.explode(F.array("carrier", "last")).alias("other"))
    same = same.where(F.col("left") + F.col("right") >= min_words)
    matches = cut(same.unionByName(_neighbours(distinct, ["ahead", "behind"], min_words)).unionByName(_neighbours(distinct, ["behind", "ahead"], min_words)))
    matches = matches.unionByName(_window_matches(distinct, matches, min_words))
    best = matches.groupBy("c", "left", "right").agg(F.min("other").alias("o0"), F.max("other").alias("o1"))
    best = best.groupBy("c").agg(F.collect_list(F.struct("left", "right", "o0", "o1")).alias("found"))
    places, best = spread(contexts.select("digest", "pos", "c"), cut(best.join(distinct.select("c", "n"), "c")), "c", "n", contexts.count(), ["digest", "pos"])
    spans = places.join(best, ["c", "salt"]).select("digest", "pos", F.inline("found")).select(
        "digest", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"),
        F.when(F.col("o0") != F.col("digest"), F.col("o0")).otherwise(F.col("o1")).alias("other"),
    )
    n_words = F.size(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    names = cut(texts.groupBy("digest").agg(F.min("doc_id").alias("other_doc_id"), F.count("*").alias("copies")))
    carriers = names.where("copies > 1").select(F.col("digest").alias("d"), "other_doc_id")
    whole = texts.join(carriers, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("other_doc_id"))).dropDuplicates(["digest"])
    whole = whole.select("digest", F.lit(0).alias("start"), n_words.alias("end"), F.col("digest").alias("other")).where(F.col("end") >= min_words)
    merged = spans.unionByName(whole).groupBy("digest").agg(merge_spans(F.collect_set(F.struct("start", "end"))).alias("spans"), F.min_by("other", F.when(F.col("other") == F.col("digest"), 1).otherwise(0)).alias("other"))
    merged = merged.join(names.select("digest", "copies"), "digest").join(names.select(F.col("digest").alias("other"), "other_doc_id"), "other")
    ids, merged = spread(texts.select("doc_id", "digest"), cut(merged), "digest", "copies", texts.count(), ["doc_id"])
    return ids.join(merged, ["digest", "salt"]).select("doc_id", F.inline("spans"), "other_doc_id")
