"""Language identification by hierarchical discrimination.

Byte n-gram frequencies of whole texts feed linear support vector machines: first the language
family is predicted (one machine against the rest for each family), then one-versus-one machines
tell the family's languages apart by vote. The machines are fitted on the driver on a bounded
sample; every row is scored in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, bucket, chunks, free_names, joined

#: Families of common languages (fixed values); a language that isn't listed is a family by itself.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
    "turkic": ("tr", "az", "kk", "uz"),
}
UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 14

#: Bytes as they enter n-grams: letters in lower case, bytes beyond ASCII as they are, the rest as one.
_SEEN = LOWER_BYTES.copy()
_SEEN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"only-{lang}")


def gram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte (the data are padded at the end)."""
    h = np.full(len(data), order, np.uint32)
    padded = np.concatenate([data, np.full(order, 32, np.uint8)])
    for k in range(order):
        h = (h ^ padded[k : k + len(data)]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 14)


def has_letter(text: bytes) -> bool:
    seen = np.frombuffer(text, np.uint8)
    if ((LOWER_BYTES[seen] >= 97) & (LOWER_BYTES[seen] <= 122)).any():
        return True
    return bool((seen >= 128).any()) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def text_profile(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and frequencies of a whole text's n-grams of all orders."""
    data = _SEEN[np.frombuffer(text + b"\n", np.uint8)]
    counts = np.zeros(BUCKETS, np.int64)
    for order in ORDERS:
        counts += np.bincount(gram_buckets(data, order), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at] / (len(data) * len(ORDERS))


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Linear support vector machine (squared hinge), by accelerated gradient steps."""
    w = v = np.zeros(x.shape[1], x.dtype)
    weight = (weight / weight.sum()).astype(x.dtype)
    y = y.astype(x.dtype)
    reach = 2 * float(weight @ np.einsum("ij,ij->i", x, x)) + penalty
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        step = v - ((-2 * weight * slack * y) @ x + penalty * v) / reach
        v = step + t / (t + 3) * (step - w)
        w = step
    return w


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` has one column for each machine: families first, then pairs of languages."""

    families: tuple[str, ...]
    languages: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[int, str, str], ...]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Margins of every machine for each text."""
        out = np.zeros((len(texts), len(self.bias)))
        for first, part in chunks(texts, 1_000_000):
            data, starts = joined(part)
            data = _SEEN[data]
            for order in ORDERS:
                grams = gram_buckets(data, order)
                for k in range(len(self.bias)):
                    out[first : first + len(part), k] += np.add.reduceat(self.weights[:, k][grams], starts[:-1])
            out[first : first + len(part)] /= (np.diff(starts) * len(ORDERS))[:, None]
        return out + self.bias

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; ``und`` and 0 without a letter."""
        margins = self.scores([t or b"" for t in texts])
        sure = 1 / (1 + np.exp(-4 * margins))
        n_fam = len(self.families)
        fam = margins[:, :n_fam].argmax(1) if n_fam > 1 else np.zeros(len(texts), int)
        score = sure[np.arange(len(texts)), fam] if n_fam > 1 else np.ones(len(texts))
        lang = np.full(len(texts), UNKNOWN, object)
        for f, members in enumerate(self.languages):
            rows = np.flatnonzero(fam == f)
            votes = np.zeros((len(rows), len(members)))
            least = np.ones((len(rows), len(members)))
            for k, (of, a, b) in enumerate(self.pairs, n_fam):
                if of == f and len(rows):
                    i, j = members.index(a), members.index(b)
                    m, p = margins[rows, k], sure[rows, k]
                    # The margin only parts equal votes.
                    votes[:, i] += (m >= 0) + 1e-6 * np.tanh(m)
                    votes[:, j] += (m < 0) - 1e-6 * np.tanh(m)
                    least[:, i] = np.minimum(least[:, i], p)
                    least[:, j] = np.minimum(least[:, j], 1 - p)
            best = votes.argmax(1)
            lang[rows] = np.array(members, object)[best]
            score[rows] *= least[np.arange(len(rows)), best]
        for i, t in enumerate(texts):
            if not t or not has_letter(t):
                lang[i], score[i] = UNKNOWN, 0.0
        return lang.tolist(), np.clip(score, 0, 1)


def sample_profiles(docs: DataFrame, per_language: int) -> pd.DataFrame:
    """At most ``per_language`` rows of each language (chosen by a hash of the id), as profiles."""
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return pd.DataFrame({"lang": [], "profile": []})
    steps = 1 << 30
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, int(steps * min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(steps))

    @F.arrow_udf("binary")
    def profile(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.cast(pa.binary()).to_pylist():
            at, freq = text_profile(t)
            out.append(at.astype("<u2").tobytes() + freq.astype("<f4").tobytes())
        return pa.array(out, pa.binary())

    drawn = known.where(draw < F.element_at(share, F.col("lang"))).select("lang", draw.alias("draw"), "doc_id", profile(F.col("text")).alias("profile"))
    rows = drawn.toPandas().sort_values(["lang", "draw", "doc_id"])
    return rows.groupby("lang").head(per_language)


def fit_languages(docs: DataFrame, per_language: int = 300) -> LanguageModel:
    """Fit on at most ``per_language`` rows of each language of ``docs (doc_id, text, lang)``."""
    rows = sample_profiles(docs, per_language)
    x = np.zeros((len(rows), BUCKETS + 1), np.float32)  # the last column is the bias
    for i, p in enumerate(rows["profile"]):
        n = len(p) // 6
        x[i, np.frombuffer(p[: 2 * n], "<u2")] = np.frombuffer(p[2 * n :], "<f4")
    scale = 1 / np.sqrt(x[:, :-1].mean(0) + 1e-6) if len(rows) else np.ones(BUCKETS)
    x[:, :-1] *= scale
    x[:, -1] = 1
    lang = rows["lang"].to_numpy(object)
    names = sorted(set(lang))
    families = tuple(sorted({family_of(n) for n in names}))
    languages = tuple(tuple(n for n in names if family_of(n) == f) for f in families)
    fam = np.array([family_of(n) for n in lang], object)
    machines = []

    def machine(rows_in: np.ndarray, positive: np.ndarray) -> np.ndarray:
        y = np.where(positive, 1.0, -1.0)[rows_in]
        weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum()))
        return fit_svm(x[rows_in], y, weight)

    everywhere = slice(None)
    if len(families) > 1:
        machines += [machine(everywhere, fam == f) for f in families]
    else:
        machines += [np.zeros(BUCKETS + 1) for _ in families]
    pairs = tuple((f, a, b) for f, members in enumerate(languages) for a, b in combinations(members, 2))
    machines += [machine((lang == a) | (lang == b), lang == a) for _, a, b in pairs]
    w = np.array(machines).reshape(-1, BUCKETS + 1)
    return LanguageModel(families, languages, pairs, (w[:, :-1] * scale).T.astype(np.float32).copy(order="F"), w[:, -1])


def language_column(text: Column, model: LanguageModel) -> Column:
    """``(lang, score)`` of a whole text."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        lang, score = model.predict(texts.cast(pa.binary()).to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return run(text)


def _learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str, modulus: int, held: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.where(bucket(F.col("doc_id"), modulus) != held)


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2, per_language: int = 300
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row.

    The model learns from rows with a language whose id isn't held out (crc32 of the id modulo
    ``modulus`` equals ``held``), at most ``per_language`` of each language. Null texts and texts
    without a letter are ``und`` with score 0; without any row to learn from every text is. Repeated
    rows each get a row. Null ids are never held out. An empty table gives an empty result.
    """
    model = fit_languages(_learnable(docs, id_col, text_col, lang_col, modulus, held), per_language)
    guess = language_column(F.col(text_col), model) if model.families else F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    rows = docs.select(F.col(id_col).alias("doc_id"), (bucket(F.col(id_col), modulus) == held).alias("held_out"), guess.alias("guess"))
    return rows.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.3, **options
) -> DataFrame:
    """``docs`` without the documents that are ``und`` or whose score is under ``min_score``.

    Null texts and texts without a letter go. Where no row has a language to learn from, no language
    can be told: then all documents with a letter stay. Repeated rows and null ids are judged like any
    other; all columns stay; an empty table stays empty.
    """
    model = fit_languages(_learnable(docs, id_col, text_col, lang_col, options.get("modulus", 4), options.get("held", 2)), options.get("per_language", 300))
    if not model.families:
        return docs.where(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    (guess,) = free_names(docs, "__guess")
    held = docs.withColumn(guess, language_column(F.col(text_col), model))
    return held.where((F.col(guess)["lang"] != UNKNOWN) & (F.col(guess)["score"] >= min_score)).drop(guess)
