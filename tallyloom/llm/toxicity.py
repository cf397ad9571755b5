"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability (logistic in its known words),
and the document's is their noisy-or: one minus the product of the sentences' complements. Training
needs document labels only; scoring tells which sentences offend.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, bucket, byte_words, chunks, joined, range_hashes

_BREAKS = np.zeros(256, np.int64)
_BREAKS[[10, 33, 46, 63]] = 1
#: Lengths in bytes of the stems.
STEMS = (4, 5, 6, 7, 8)
_NOT_WORD = np.zeros(256, bool)
_NOT_WORD[[b for b in range(128) if not chr(b).isalpha()]] = True


def bag(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes, each feature's sentence, each sentence's first byte and text, of many texts.

    The features are the words and, as stems, the words' first ``STEMS`` bytes. Sentences end at a
    full stop, an exclamation or question mark, or a line end.
    """
    data, starts = joined(texts)
    data = LOWER_BYTES[data]
    begin, end = byte_words(data, _NOT_WORD)
    ends = np.flatnonzero(_BREAKS[data])
    sentence = np.searchsorted(ends, begin)
    size = end - begin
    froms, tos, sentences = [begin], [end], [sentence]
    for n in STEMS:
        longer = size > n
        froms.append(begin[longer])
        tos.append(begin[longer] + n)
        sentences.append(sentence[longer])
    hashes = range_hashes(data, np.concatenate(froms), np.concatenate(tos))
    sentence_start = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    sentence_text = np.searchsorted(starts, sentence_start, side="right") - 1
    return hashes, np.concatenate(sentences), sentence_start - starts[sentence_text], sentence_text


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted hashes of the known words, their weights and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Place among the known words, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def sentence_scores(self, texts: list[bytes | None]):
        """Probability, first byte and text of each sentence."""
        hashes, sentence, first, text = bag(texts)
        at = self.index(hashes)
        known = at >= 0
        z = np.bincount(sentence[known], self.weights[at[known]], minlength=len(first)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50))), first, text

    def predict(self, texts: list[bytes | None]) -> np.ndarray:
        """Noisy-or of each text's sentences."""
        out = np.zeros(len(texts))
        for start, part in chunks(texts, 1_000_000):
            p, _, text = self.sentence_scores(part)
            log = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(part))
            out[start : start + len(part)] = -np.expm1(log)
        return np.clip(out, 0, 1)


def fit_bags(
    bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, min_docs: int = 5, min_z: float = 5.0,
    most_words: int = 50_000, penalty: float = 1e-5, steps: int = 300, rate: float = 0.1,
) -> ToxicityModel:
    """Maximise the noisy-or likelihood of document labels (Adam steps on word weights).

    ``bags`` holds each document's feature hashes and their sentence numbers. Features take part
    that stand in ``min_docs`` documents or more, and in toxic ones ``min_z`` standard deviations
    more or less often than by chance.
    """
    seen = [np.unique(h) for h, _ in bags]
    sizes = [len(h) for h in seen]
    words, of = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_inverse=True)
    docs = np.bincount(of, minlength=len(words))
    toxic_docs = np.bincount(of, np.repeat(labels, sizes) if len(labels) else None, minlength=len(words))
    share = labels.mean() if len(labels) else 0.0
    # Standard deviations by which a feature's toxic documents differ from chance.
    z = (toxic_docs - docs * share) / np.sqrt(np.maximum(docs * share * (1 - share), 1e-9))
    chosen = np.flatnonzero((docs >= min_docs) & (np.abs(z) >= min_z))
    if len(chosen) > most_words:
        chosen = np.sort(chosen[np.argsort(-np.abs(z[chosen]), kind="stable")[:most_words]])
    words = words[chosen]
    blank = ToxicityModel(words, np.zeros(len(words)), 0.0)
    where, sentences, owner, base = [], [], [], 0
    for d, (h, s) in enumerate(bags):
        at = blank.index(h)
        n = int(s.max()) + 1 if len(s) else 1
        where.append(at[at >= 0])
        sentences.append(s[at >= 0] + base)
        owner.append(np.full(n, d))
        base += n
    if not base:
        return ToxicityModel(words, np.zeros(len(words)), -4.0)
    at, sentence, owner = np.concatenate(where), np.concatenate(sentences), np.concatenate(owner)
    w, b = np.zeros(len(words)), -4.0
    m = np.zeros(len(words) + 1)
    v = np.zeros(len(words) + 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, w[at], minlength=base) + b, -50, 50)))
        p = np.clip(p, 1e-9, 1 - 1e-9)
        none = np.exp(np.bincount(owner, np.log1p(-p), minlength=len(bags)))
        toxic = np.clip(1 - none, 1e-9, None)
        # d log-likelihood / d z of a sentence: p for its share of a toxic bag, -p for a clean one.
        g = (weight * np.where(labels == 1, none / toxic, -1.0))[owner] * p
        grad = np.append(np.bincount(at, g[sentence], minlength=len(words)) - penalty * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
    used = np.abs(w) > 1e-3
    return ToxicityModel(words[used], w[used], float(b))


def bag_column(text: Column) -> Column:
    """``h, s``: a text's features and the sentences they stand in, as 8-byte and 4-byte numbers."""

    @F.arrow_udf("struct<h:binary,s:binary>")
    def run(texts: pa.Array) -> pa.Array:
        hashes, sentences = [], []
        for t in texts:  # one text at a time is a Python object
            h, s, *_ = bag([(t.as_py() or "").encode()])
            hashes.append(h.astype("<u8").tobytes())
            sentences.append(s.astype("<u4").tobytes())
        return pa.StructArray.from_arrays([pa.array(hashes, pa.binary()), pa.array(sentences, pa.binary())], ["h", "s"])

    return run(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_chars: int = 50_000) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled documents of each class, weighted to the true shares.

    ``docs`` has ``doc_id, text``; ``labels`` has ``doc_id, toxic``. The sample is drawn by a hash
    of the id from documents of ``max_chars`` characters at most, so what comes to the driver, the
    sample's features, is bounded. An id with differing labels counts as toxic; of an id's several
    texts one is taken.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    held = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    known = known.join(held.groupBy("doc_id").agg(F.min(mark).alias("mark")), "doc_id")
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    parts = [known.where(F.col("toxic") == c).orderBy(draw, "doc_id").limit(per_class) for c in (0, 1)]
    drawn = parts[0].unionByName(parts[1])
    rows = held.withColumn("mark", mark).join(F.broadcast(drawn), ["doc_id", "mark"]).dropDuplicates(["doc_id"])
    rows = sorted(rows.select("doc_id", "toxic", bag_column(F.col("text")).alias("bag")).collect(), key=lambda r: r["doc_id"])
    bags = [(np.frombuffer(r["bag"]["h"], "<u8"), np.frombuffer(r["bag"]["s"], "<u4").astype(np.int64)) for r in rows]
    y = np.array([r["toxic"] for r in rows])
    share = {c: sizes.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)}
    return fit_bags(bags, y, np.array([share[c] for c in y], float) if len(y) else np.ones(0))


def toxicity_column(text: Column, model: ToxicityModel) -> Column:
    """Noisy-or score of a whole text."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.predict(texts.cast(pa.binary()).to_pylist()), pa.float64())

    return run(text)


def offending_column(text: Column, model: ToxicityModel, threshold: float = 0.5) -> Column:
    """``(sentence, score)`` of each sentence at or over ``threshold``, in the text's order."""

    @F.arrow_udf("array<struct<sentence:string,score:double>>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.cast(pa.binary()).to_pylist():
            p, first, _ = model.sentence_scores([t])
            ends = [*first[1:].tolist(), len(t or b"")]
            out.append([{"sentence": (t or b"")[a:b].decode("utf-8", "replace").strip(), "score": float(x)} for x, a, b in zip(p, first, ends, strict=True) if x >= threshold])
        return pa.array(out, pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())])))

    return run(text)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    modulus: int = 3, held: int = 1, per_class: int = 2000, threshold: float = 0.7,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row.

    Labels are learned only from ids that aren't held out (crc32 of the id modulo ``modulus`` equals
    ``held``), at most ``per_class`` documents of each class (see ``fit_toxicity``). Null and empty texts are scored as one
    sentence without words. Repeated rows each get a row; null ids are never held out. Without
    labels every text gets the same low score. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where(bucket(F.col("doc_id"), modulus) != held)
    model = fit_toxicity(rows, known, per_class)
    score = toxicity_column(F.col("text"), model)
    out = rows.select("doc_id", (bucket(F.col("doc_id"), modulus) == held).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
