"""Phrase collocations against brute force and the registered SQL's rules."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from tallyloom.llm import phrases


def brute(rows, most_words=3, min_count=10, inside=50, first=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for k in range(1, most_words + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        around = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        kept = []
        for p, a in found.items():
            if 100 * around[p] >= inside * a and around[p]:
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def made(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["The", "the", "Été", "été", "a'b", "new"]
    texts = []
    for i in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(rng.randrange(60)))
        texts.append((text + " New York City " * (i % 3), rng.choice(["en", "fr", None, "und"])))
    return texts


def test_collocations_against_brute_force(spark):
    rows = made() + [(None, "en"), ("", "fr"), ("x", None), ("long run " * 30_000, "de"), ("same words here " * 12, "es")]
    docs = spark.createDataFrame([(t, v, 1, "z", "q") for t, v in rows], "text string, lang string, k int, phrase string, a string").repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs).collect()))
    assert got == brute(rows)
    for options in ({"most_words": 4, "min_count": 3}, {"most_words": 2, "min_count": 1, "first": 7}, {"inside_percent": 90}):
        named = {"most_words": "most_words", "min_count": "min_count", "first": "first", "inside_percent": "inside"}
        assert sorted(map(tuple, phrases.collocations(docs, **options).collect())) == brute(rows, **{named[k]: v for k, v in options.items()})


def test_repeated_rows_count_each_and_empty_tables_give_nothing(spark):
    rows = [("one two", "en")] * 11
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert [tuple(r) for r in phrases.collocations(docs).collect()] == [("en", 1, "one two", 11, 11, 11, 22, 1_000_000)]
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000_000, 3_000_000_000_001, 5_000_000_000_000)], "a long, l long, r long")
    exact = "(1000000BD * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    a, left, right = 3_000_000_000_000, 3_000_000_000_001, 5_000_000_000_000
    assert row.selectExpr(exact).first()[0] == 1_000_000 * a * a // (left * right)


def test_summaries_keep_whatever_stands_often_enough():
    rng = np.random.default_rng(1)
    for trial in range(20):
        keys = rng.zipf(1.3, 20_000).astype(np.uint64) % np.uint64(5000)
        parts = [np.unique(p, return_counts=True) for p in np.array_split(keys, 13)]
        threshold = 40
        capacity = len(keys) // threshold + 1
        held, lost = None, 0
        for p in parts:
            *held, less = phrases.merged([p] if held is None else [held, p], capacity)
            lost += less
            assert len(held[0]) <= capacity
        values, counts = np.unique(keys, return_counts=True)
        assert lost < threshold and set(values[counts >= threshold].tolist()) <= set(held[0][held[1] + lost >= threshold].tolist())


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 1000):
        keys = np.unique(rng.integers(0, 1 << 32, n).astype(np.uint32))
        counts = rng.integers(1, 1 << 40, len(keys))
        back = phrases._unpacked(phrases._packed(keys, counts))
        assert (back[0] == keys).all() and (back[1] == counts).all()
