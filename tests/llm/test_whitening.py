"""Embedding whitening against a dense solver and exact whole numbers."""

from __future__ import annotations

import numpy as np
import pytest

from tallyloom.llm import contour, whitening


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 30):
        a = rng.standard_normal((size, size))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in (*((values[1:] + values[:-1]) / 2), values[0] - 1, values[-1] + 1):
            assert contour.below(a, shift) == (values < shift).sum()
    assert contour.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # no pivot on the diagonal


@pytest.mark.parametrize("kind", ["random", "decay", "repeated", "cluster", "low rank", "wide"])
def test_leading_pairs(kind):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    a = {
        "random": lambda: np.cov(rng.standard_normal((300, 48)).T),
        "decay": lambda: np.cov((rng.standard_normal((300, 48)) * np.logspace(0, -5, 48)).T),
        "repeated": lambda: q @ np.diag([5.0] * 10 + [3.0] * 20 + [1.0] * 18) @ q.T,
        "cluster": lambda: q @ np.diag(np.append(1 + 1e-12 * np.arange(30), 0.01 * np.arange(18))) @ q.T,
        "low rank": lambda: np.cov(rng.standard_normal((12, 48)).T),
        "wide": lambda: np.cov(rng.standard_normal((400, 120)).T),
    }[kind]()
    a = (a + a.T) / 2
    values, vectors = contour.leading(a, 32)
    want = np.linalg.eigvalsh(a)[::-1][:32]
    assert np.abs(values - want).max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * want[0]


def test_products_are_exact():
    rng = np.random.default_rng(4)
    for most in (10, 1 << 20, 1 << 27, 1 << 45):
        y = rng.integers(-most, most, (40, 5))
        assert (whitening._products(y) == y.astype(object).T @ y.astype(object)).all()


def brute(vectors):
    x = np.array([[int(np.floor(64 * float(v))) + 1_000_000 for v in row] for row in vectors], object)
    n, s = len(x), x.sum(0)
    distance = n * x - s
    centred = np.array([[float(v) for v in row] for row in distance]) / n
    values, block = np.linalg.eigh(centred.T @ centred / n)
    return n, [int(sum(v * v for v in row)) for row in distance], values[::-1], block[:, ::-1], centred


def test_rows_against_a_dense_solver(spark):
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((120, 40)) @ np.diag(np.linspace(3, 0.3, 40))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(None, base[0].tolist()), (7, base[7].tolist())]  # a null id and a copy
    bad = [(900, None), (901, []), (902, [None] * 40), (903, [float("nan")] + [0.0] * 39), (904, [float("inf")] + [0.0] * 39), (905, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, v string, n int").repartition(4)
    got = whitening.whitened_rows(table).collect()
    n, deviations, values, block, centred = brute([v for _, v in rows])
    assert len(got) == n * 32 and {r["n"] for r in got} == {n}
    want = centred @ block[:, :32] / np.sqrt(values[:32])
    found = {(r["vec_id"], r["component"]): r for r in got}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    w = np.array([[found[i, k + 1]["whitened"] for k in range(32)] for i, _ in rows])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9
    assert [found[i, 1]["deviation"] for i, _ in rows] == deviations
    assert max(abs(found[0, k + 1]["explained"] - values[k] / values.sum()) for k in range(32)) < 1e-12


def test_no_variance_and_no_rows(spark):
    assert whitening.whitened_rows(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whitening.whitened_rows(same).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whitened_rows(line).collect()} == {1}


def test_deviations_beyond_a_long_stay_exact(spark):
    rows = [(i, [float(i * 2**40), float(-i)]) for i in range(4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(table)
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(table, model).collect()}
    assert [got[i] for i in range(4)] == brute([v for _, v in rows])[1]
