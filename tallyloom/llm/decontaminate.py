"""Benchmark decontamination: training token windows against a broadcast set of test n-grams.

DataFrame functions only. The hashes of a document's windows are first tested in place against a
bitmap of the benchmark's hashes, so only likely hits become rows. Those are looked up in a broadcast
table of the benchmark's windows and verified word by word. A window carries its own words only, so
the work grows with the text's length. A window set above the stated bounds isn't broadcast: all
windows are joined by a shuffle on their hashes instead, with the texts still read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, free_names, merge_spans, row_key

#: Runs of digits, lower-case letters and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_TYPE = "array<string>"


def normal_words(text: Column) -> Column:
    """Normalised words of a text; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() is quick but wrong beyond ASCII, where only A-Z may change.
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def with_window_hashes(frame: DataFrame, sizes: list[int]) -> DataFrame:
    """``frame`` with ``w<m>`` for each size: the 64-bit hashes of all runs of m of its ``words``.

    Hashes of 2, 4, 8... words are combined from those of half as many, and a run's from the powers
    of two that make it up: a few passes over each text, whatever the size.
    """
    def joined(a: str, b: str, ahead: int) -> Column:
        rest = F.slice(b, ahead + 1, F.greatest(F.size(b) - ahead, F.lit(0)))
        return F.slice(F.zip_with(a, rest, lambda x, y: F.xxhash64(x, y)), 1, F.greatest(F.size(b) - ahead, F.lit(0)))

    frame = frame.withColumn("p1", F.transform("words", lambda w: F.xxhash64(w)))
    power = 1
    while sizes and 2 * power <= max(sizes):
        frame = frame.withColumn(f"p{2 * power}", joined(f"p{power}", f"p{power}", power))
        power *= 2
    for m in sizes:
        parts = [1 << i for i in reversed(range(m.bit_length())) if m >> i & 1]
        name, done = f"p{parts[0]}", parts[0]
        for n in parts[1:]:
            frame = frame.withColumn(f"w{m}_{n}", joined(name, f"p{n}", done))
            name, done = f"w{m}_{n}", done + n
        frame = frame.withColumn(f"w{m}", F.col(name))
    return frame


def _windows(size: int, bitmap: Column | None = None, bits: int = 0) -> Column:
    """``(pos, h, gram)`` of each run of ``size`` words, of those in ``bitmap`` if one is given."""
    def at(h: Column, i: Column) -> Column:
        window = F.struct(i.alias("pos"), h.alias("h"), F.array(*[F.get("words", i + k) for k in range(size)]).alias("gram"))
        if bitmap is None:
            return window
        place = h.bitwiseAND(F.lit(bits - 1).cast("long"))
        return F.when(F.getbit(F.get(bitmap, F.shiftrightunsigned(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1, window)

    return F.filter(F.transform(f"w{size}", at), lambda x: x.isNotNull())


def hash_bitmap(grams: DataFrame, bits: int) -> Column:
    """An array of 64-bit words with the low bits of each ``h`` set, ``bits`` (a power of two, at least
    64) in all, as one constant of the plan. Its size follows from the bound on broadcast windows."""
    place = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long"))
    held = grams.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("v"))
    words = dict.fromkeys(range(bits // 64), 0) | {r["w"]: r["v"] for r in held.collect()}
    return F.split(F.lit(",".join(str(v) for v in words.values())), ",").cast("array<long>")


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``gram, size, h, items``: each distinct window with the ids (as text) of the items that hold it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), normal_words(F.col(text_col)).alias("words"))
    items = with_window_hashes(items.where(F.size("words") > 0), list(range(1, window + 1)))
    size = F.least(F.lit(window), F.size("words"))
    hashes = F.coalesce(*[F.when(size == m, F.col(f"w{m}")) for m in range(1, window + 1)])
    grams = items.select("item", "words", size.alias("size"), F.posexplode(hashes).alias("pos", "h"))
    gram = F.slice("words", F.col("pos") + 1, F.col("size")).alias("gram")
    return grams.select("item", gram, "size", "h").groupBy("gram", "size", "h").agg(F.collect_set("item").alias("items"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_broadcast_windows: int = 500_000, max_broadcast_bytes: int = 128_000_000,
) -> DataFrame:
    """``doc_id, digest, n_words, n_hit, n_items, items, spans`` for each document.

    A window is ``window`` consecutive words of an item, or all of a shorter one. ``n_hit`` counts
    the document's words inside any occurrence of a window, ``spans`` has the hit stretches as
    ``(start, end)`` in words, ``items`` the ids (text, sorted) of the items hit. At most
    ``max_broadcast_windows`` windows of ``max_broadcast_bytes`` together are broadcast; more are
    joined by a shuffle. Null and empty texts have no words and no hits; wordless items match
    nothing; items with a null id hit, but aren't listed. Repeated rows each get a row. Without
    items nothing is hit. Other columns are not read.
    """
    grams = cut(benchmark_windows(benchmark, item_id_col, item_text_col, window))
    size_of = lambda c: F.octet_length(F.array_join(c, " "))
    known = grams.agg(F.count("*").alias("n"), F.sum(size_of("gram") + size_of("items")).alias("bytes"), F.collect_set("size").alias("sizes")).first()
    small = known["n"] <= max_broadcast_windows and (known["bytes"] or 0) <= max_broadcast_bytes

    key = row_key(F.col(id_col), F.col(text_col))
    words = docs.select(key.alias("key"), normal_words(F.col(text_col)).alias("words"))
    words = with_window_hashes(words, sorted(known["sizes"]))
    # Each document also has one window of no words, which always hits and carries its length.
    blank = F.array().cast(WINDOW_TYPE)
    end = F.array(F.struct(F.size("words").alias("pos"), F.xxhash64(blank).alias("h"), blank.alias("gram")))
    bits = max(64, 1 << (8 * known["n"]).bit_length())
    bitmap = hash_bitmap(grams, bits) if small and known["n"] else None
    windows = [_windows(m, bitmap, bits) for m in sorted(known["sizes"])]
    nothing = docs.sparkSession.range(1).select(blank.alias("gram"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("items"), F.xxhash64(blank).alias("h"))
    looked = grams.select(F.col("gram").alias("known_gram"), "size", "items", "h")
    looked = F.broadcast(looked.unionByName(nothing.withColumnRenamed("gram", "known_gram"))) if small else looked.hint("merge")
    probes = reduce(F.concat, windows, end) if small else reduce(F.concat, windows)
    # The outer form keeps the optimizer from computing the windows twice, to drop empty arrays.
    probed = words.select("key", F.explode_outer(probes).alias("probe"))
    same = (F.col("probe.h") == F.col("h")) & (F.col("probe.gram") == F.col("known_gram"))
    found = probed.join(looked, same).select("key", F.col("probe.pos").alias("pos"), "size", "items")
    if not small:
        found = found.unionByName(words.select("key", F.size("words").alias("pos"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("items")))
    hit = F.col("size") > 0
    per_row = found.groupBy("key").agg(
        F.max(F.when(~hit, F.col("pos"))).cast("long").alias("n_words"),
        F.count(F.when(~hit, 1)).alias("copies"),
        F.collect_set(F.when(hit, F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end")))).alias("hits"),
        F.collect_set(F.when(hit, F.col("items"))).alias("lists"),
    )

    def covered(seen: Column, x: Column) -> Column:
        more = F.greatest(x["end"] - F.greatest(seen["end"], x["start"]), F.lit(0))
        return F.struct(F.greatest(seen["end"], x["end"]).alias("end"), (seen["n"] + more).alias("n"))

    nil = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    out = per_row.select(
        "key", "n_words", F.sequence(F.lit(1).cast("long"), "copies").alias("copies"),
        F.aggregate(F.sort_array("hits"), nil, covered)["n"].alias("n_hit"), merge_spans(F.col("hits")).alias("spans"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"),
    )
    out = out.select("*", F.explode("copies"))
    return out.select(F.col("key.id").alias("doc_id"), F.col("key.digest").alias("digest"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans")


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The figures of ``contamination`` with a digest of the items' ids in place of the list."""
    return contamination(docs, benchmark, **options).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def _with_spans(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, **options) -> tuple[DataFrame, str]:
    """``docs`` with the hit spans of each row, null where there is none, and the name of their column."""
    spans, hit_key, own_key = free_names(docs, "__spans", "__hit", "__key")
    hit = contamination(docs, benchmark, id_col, text_col, **options).where("n_hit > 0").groupBy("doc_id", "digest").agg(F.first("spans").alias(spans))
    hit = hit.select(F.struct(F.col("doc_id").alias("id"), "digest").alias(hit_key), spans)
    held = docs.withColumn(own_key, row_key(F.col(id_col), F.col(text_col)))
    same = F.col(own_key)["id"].eqNullSafe(F.col(hit_key)["id"]) & (F.col(own_key)["digest"] == F.col(hit_key)["digest"])
    return held.join(hit, same, "left"), spans


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns stay.

    Null and empty texts hold none and stay, as do repeated rows of clean documents.
    """
    joined, spans = _with_spans(docs, benchmark, id_col, text_col, **options)
    return joined.where(F.col(spans).isNull()).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the hit words cut out of each text; what stands between words stays.

    Null texts stay null; all rows and columns stay.
    """
    joined, spans = _with_spans(docs, benchmark, id_col, text_col, **options)
    lead, parts, cut_col = free_names(joined, "__leads", "__pieces", "__cut")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))
    leads = F.when(F.col(text_col).rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)

    def stays(piece: Column, i: Column) -> Column:
        k = ((i - F.col(lead)) / 2).cast("int")
        is_word = (i - F.col(lead)) % 2 == 0
        return ~(is_word & F.exists(spans, lambda s: (s["start"] <= k) & (k < s["end"])))

    cut_text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(parts, stays), ""))
    joined = joined.withColumn(lead, leads).withColumn(parts, F.when(F.col(spans).isNotNull(), pieces)).withColumn(cut_col, cut_text)
    return joined.select(*[F.col(cut_col).alias(c) if c == text_col else F.col(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (
  SELECT r, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS gram
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m)),
h AS (SELECT p.r, p.i, p.m, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.m = g.m),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS x FROM (SELECT DISTINCT r, i, m FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN t ON d.r = t.r
"""
