"""Phrase collocations: frequent n-grams by Misra-Gries summaries, then counted exactly.

First pass: tasks hash the n-grams of their texts and send, for each hash partition, a summary: sorted keys
with counts, packed. Summaries merge: counts of one key add up, and where more than the partition's capacity are left,
all lose as much as the first one over it has. The capacity exceeds the partition's mass divided
by the threshold, so no n-gram that stands as often as the threshold can be lost, whatever the order
of merging. What with its losses may come up to the threshold becomes a bitmap of bounded size.

Second pass: n-grams that the bitmap lets through are counted exactly, by their words. Keys only choose
what is counted: two n-grams of one key cost work and never a wrong count. Scores, cuts and the dropping of
parts of longer phrases are joins and groupings of the counted table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, joined, mix, range_hashes, spread

UNKNOWN = "und"
_WORD, _BLANK, _BREAK = range(3)
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = _BREAK
_KINDS = _KIND.tobytes()
#: The bitmap of surviving keys has as many bits at most: 128 MB, however much survives.
MOST_BITS = 30


class Grams:
    """The n-grams of a run of texts: exact words by number, and a hash of each n-gram."""

    def __init__(self, texts: list[bytes | None], langs: list[str]) -> None:
        data, starts = joined(texts)
        raw = data.tobytes()
        kind = np.frombuffer(raw.translate(_KINDS), np.uint8)
        word = kind == _WORD
        at = np.flatnonzero(word & np.append(True, ~word[:-1]))
        bounds = np.append(at, len(data))
        upto = np.append(0, np.cumsum(word))
        offsets = upto[bounds].astype(np.int64)  # words without what stands between them
        squeezed = np.frombuffer(raw.lower(), np.uint8)[word]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(squeezed)]).dictionary_encode()
        self.words = coded.dictionary
        number = coded.indices.to_numpy().astype(np.int64)
        # Each text's language, and the piece between breaks that a word stands in.
        self.langs = sorted(set(langs))
        index = {v: i for i, v in enumerate(self.langs)}
        own = np.array([index[v] for v in langs], np.int64)
        per_text = np.diff(np.searchsorted(at, starts))
        lang = np.repeat(own, per_text)
        self.totals = np.bincount(lang, minlength=len(self.langs))
        self.piece = np.cumsum(kind == _BREAK)[at]
        both, self.of = np.unique(lang * max(1, len(self.words)) + number, return_inverse=True)
        self.word_of, self.lang_of = both % max(1, len(self.words)), both // max(1, len(self.words))
        if len(self.words):
            place = np.frombuffer(self.words.buffers()[1], np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
            letters = np.frombuffer(self.words.buffers()[2], np.uint8)
            seeds = np.array([zlib.crc32(v.encode()) for v in self.langs], np.uint64)
            self.hash_of = mix(range_hashes(letters, place[:-1], place[1:])[self.word_of] + mix(seeds)[self.lang_of])

    def sizes(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``k``, first words' places and hashes of all n-grams of 1 to ``most`` words, by ``k``."""
        if not len(self.of):
            return
        own = self.hash_of[self.of]
        h, at = own, np.arange(len(own))
        for k in range(1, most + 1):
            if k > 1:
                stays = (at + k - 1 < len(own)) & (self.piece[np.minimum(at + k - 1, len(own) - 1)] == self.piece[at])
                at = at[stays]
                h = mix(h[stays] * np.uint64(0x9E3779B97F4A7C15) + own[at + k - 1])
            yield k, at, h

    def counted(self, k: int, at: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Languages, phrases and counts of the n-grams of ``k`` words at these places, by their words."""
        code, size, step = self.of[at], len(self.word_of), len(self.word_of)
        for j in range(1, k):
            if size * step >= 1 << 63:
                code = np.unique(code, return_inverse=True)[1]
                size = int(code.max()) + 1 if len(code) else 1
            code, size = code * step + self.of[at + j], size * step
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        place = at[first]
        parts = [pc.take(self.words, pa.array(self.word_of[self.of[place + j]])) for j in range(k)]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return pc.take(pa.array(self.langs, pa.string()), pa.array(self.lang_of[self.of[place]])), phrase.cast(pa.large_string()).cast(pa.string()), n


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        sizes = np.cumsum(np.asarray(pc.add(pc.fill_null(pc.binary_length(texts), 0), 1)).astype(np.int64))
        at = 0
        while at < len(batch):  # about 4 MB of texts at a time are Python objects
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4_000_000)))
            part = [t.as_py().encode() if t.is_valid else b"" for t in texts[at:upto]]
            for first, some in chunks(part, 4_000_000):
                yield Grams(some, langs[at + first : at + first + len(some)].to_pylist())
            at = upto


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences and counts, bytes of one place together, compressed."""
    steps = np.diff(keys.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(planes.tobytes() + counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").reshape(-1)
    return np.cumsum(steps, dtype=np.uint32), np.ascontiguousarray(raw[4 * n :].reshape(8, n).T).view("<i8").reshape(-1)


def merged(parts: list[tuple[np.ndarray, np.ndarray]], capacity: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries summaries as one, with ``capacity`` counters at most, and what each counter has lost in it."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
    counts = np.concatenate([c for _, c in parts])[order]
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    lost = 0
    if capacity is not None and len(keys) > capacity:
        lost = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
        counts = counts - lost
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts, lost


def summaries(rows: DataFrame, most_words: int, partitions: int, held: int = 1_500_000) -> DataFrame:
    """``p, mass, packed``: each task's summaries by hash partition; nothing is lost here, so they are exact.
    A task gives out what it has when it holds ``held`` keys."""
    bits = partitions.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, counts, _ = merged(parts)
            place = np.searchsorted(keys >> np.uint64(32), np.arange(partitions + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(place))
            blobs = [_packed(keys[place[p] : place[p + 1]] & np.uint64(0xFFFFFFFF), counts[place[p] : place[p + 1]]) for p in full]
            mass = [int(counts[place[p] : place[p + 1]].sum()) for p in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(mass, pa.int64()), pa.array(blobs, pa.binary())], ["p", "mass", "packed"])

        waiting = 0
        for grams in _runs(batches):
            found = [h >> np.uint64(32 - bits) for _, _, h in grams.sizes(most_words)]
            if found:
                parts.append(np.unique(np.concatenate(found), return_counts=True))
                waiting += len(parts[-1][0])
            if waiting > held:
                parts = [merged(parts)[:2]]
                waiting = len(parts[0][0])
                if waiting > held // 2:
                    yield out()
                    parts, waiting = [], 0
        if parts:
            yield out()

    return rows.mapInArrow(run, "p int, mass long, packed binary")


def surviving_keys(rows: DataFrame, most_words: int, threshold: int, partitions: int, slack: int = 4) -> tuple[int, bytearray]:
    """A bitmap of the keys of all n-grams that may stand ``threshold`` times, and its bits' logarithm.

    A hash partition's summaries meet in one task, which holds ``slack`` counters for each ``threshold`` of its mass at most:
    with twice as many partitions, half as many. A key survives where its counter and all that counters have
    lost there come up to the threshold. Only the finished bitmap, of bounded size, comes to the driver.
    """
    found = cut(summaries(rows, most_words, partitions))
    mass = found.groupBy("p").agg(F.sum("mass").alias("all"), F.count("*").alias("blobs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, total, lost, waiting = None, 0, 0, []

        def summed() -> None:
            nonlocal lost
            keys, counts, less = merged(waiting, slack * (total // threshold + 1))
            waiting[:] = [(keys, counts)]
            lost += less

        def out() -> pa.RecordBatch:
            summed()
            keys, counts = waiting[0]
            enough = counts + lost >= threshold
            return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([int(enough.sum())], pa.int64()), pa.array([_packed(keys[enough], counts[enough])], pa.binary())], ["p", "n", "packed"])

        for batch in batches:
            for q, every, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if q != p:
                    if p is not None:
                        yield out()
                    p, total, lost, waiting = q, every, 0, []
                waiting.append(_unpacked(packed.as_py()))
                if sum(len(k) for k, _ in waiting[1:]) > max(1_000_000, len(waiting[0][0])):
                    summed()
        if p is not None:
            yield out()

    dealt = found.select("p", "packed").join(F.broadcast(mass.select("p", "all")), "p").select("p", "all", "packed")
    kept = cut(dealt.repartition(partitions, "p").sortWithinPartitions("p").mapInArrow(run, "p int, n long, packed binary"))
    survivors = kept.agg(F.sum("n")).first()[0] or 0
    bits, by = min(MOST_BITS, max(16, (32 * survivors).bit_length())), partitions.bit_length() - 1
    # Each partition has its own stretch of the bitmap.
    own = max(3, bits - by)

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, _ = _unpacked(packed.as_py())
                marks = np.zeros(1 << own, bool)
                marks[keys >> np.uint32(32 - own)] = True
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([zlib.compress(np.packbits(marks).tobytes(), 1)], pa.binary())], ["p", "bits"])

    bitmap = bytearray(1 << (own + by - 3))
    for r in kept.select("p", "packed").mapInArrow(stretch, "p int, bits binary").toLocalIterator():
        bitmap[r["p"] << (own - 3) : (r["p"] + 1) << (own - 3)] = zlib.decompress(bytes(r["bits"]))
    return own + by, bitmap


def phrase_counts(rows: DataFrame, most_words: int, threshold: int, partitions: int) -> DataFrame:
    """``lang, k, phrase, a``: exact counts of all n-grams that stand ``threshold`` times or more in a
    language; rows with ``k`` = 0 have the number of all words."""
    bits, bitmap = surviving_keys(rows, most_words, threshold, partitions)
    sent = rows.sparkSession.sparkContext.broadcast(bytes(bitmap))
    names = ["lang", "k", "phrase", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, np.uint8)
        for grams in _runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(grams.langs, pa.string()), pa.array([0] * len(grams.langs), pa.int32()), pa.array([""] * len(grams.langs), pa.string()), pa.array(grams.totals, pa.int64())], names)
            for k, at, h in grams.sizes(most_words):
                key = h >> np.uint64(64 - bits)
                likely = held[key >> np.uint64(3)] >> (7 - (key & np.uint64(7)).astype(np.uint8)) & 1
                lang, phrase, n = grams.counted(k, at[likely == 1])
                yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), k), pa.int32()), phrase, pa.array(n, pa.int64())], names)

    counted = rows.mapInArrow(run, "lang string, k int, phrase string, c long").groupBy("lang", "k", "phrase").agg(F.sum("c").alias("a"))
    return counted.where((F.col("a") >= threshold) | (F.col("k") == 0))


def _key(lang: Column, phrase: Column) -> Column:
    """One string for both: no word holds a tab."""
    return F.concat(lang, F.lit("\t"), phrase)


def _with_counts(rows: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in ``key``; a word that begins a great many phrases is salted."""
    wanted = rows.groupBy(key).agg(F.count("*").alias("__n"))
    right = counts.select(_key(F.col("lang"), F.col("phrase")).alias(key), F.col("a").alias(name)).join(wanted, key)
    left, right = spread(rows, cut(right), key, "__n", rows.count(), ["lang", "phrase", "cut"])
    return left.join(right.drop("__n"), [key, "salt"]).drop("salt", key)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 3, min_count: int = 10, inside_percent: int = 50, first: int = 2000,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` phrases of 2 to ``most_words`` words.

    ``a`` is the phrase's count, ``n`` the language's number of words; ``l`` and ``r`` are the counts of the parts of
    the cut with the lowest ``score``, floor(1000000 * a * a / (l * r)). Phrases inside a longer one that stands at least
    ``inside_percent`` as often are left out. All is exact at any size: products are decimals of 38 digits.
    Null texts are empty, null languages count as ``und``; repeated rows count each. Ties of the score go by ``a``, then by the
    phrase's bytes. An empty table gives an empty result; other columns are not read.
    """
    if not 2 <= most_words <= 8 or min_count < 1:
        raise ValueError("phrases of 2 to 8 words that stand at least once")
    partitions = 1 << max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = cut(phrase_counts(rows, most_words, min_count, partitions))
    grams, found = counts.where("k > 0"), counts.where("k > 1")
    words = F.split("phrase", " ")
    part = lambda first_word, n: F.array_join(F.slice(words, first_word, n), " ")
    cuts = found.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", _key(F.col("lang"), part(F.lit(1), F.col("cut"))).alias("left_key"), _key(F.col("lang"), part(F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right_key"))
    cuts = _with_counts(_with_counts(cut(cuts), grams, "left_key", "l"), grams, "right_key", "r")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.select("*", (F.lit(1000000).cast("decimal(7,0)") * exact("a") * exact("a")).alias("over"), (exact("l") * exact("r")).alias("under"))
    lowest = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("low"))
    # The most frequent longer phrase around each phrase.
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    longer = found.where("k > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * inside_percent))
    kept = kept.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score"))
    # A language's best of each of 64 parts, then its best of those.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    totals = counts.where("k = 0").select(F.col("lang").alias("total_lang"), F.col("a").alias("n"))
    out = best.join(totals, F.col("lang") == F.col("total_lang"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, phrase, count(*) AS a
  FROM (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 10),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k > 1),
cuts AS (SELECT *, array_to_string(w[1 : cut], ' ') AS first_part, array_to_string(w[cut + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM found)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, c.cut, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.first_part JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS around
  FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM found WHERE k = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN longer b ON b.lang = s.lang AND b.phrase = s.phrase WHERE b.around IS NULL OR 100 * b.around < 50 * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""
