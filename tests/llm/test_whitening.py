"""Operator 12: eigenpairs against numpy's solver, rows against exact fractions in plain Python."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from airshed.llm import whitening
from tests.llm import cases


def check_spectrum(v, count=16, wanted=None):
    got = whitening.leading(v, count)
    values = np.linalg.eigvalsh(v)[::-1]
    m = len(got.values)
    norm = max(np.linalg.norm(v, 2), 1e-300)
    assert got.certified and m == (wanted if wanted is not None else min(count, len(v)))
    assert np.all(np.diff(got.values) <= 0)
    assert np.abs(got.values - values[:m]).max(initial=0) <= 1e-13 * norm
    assert np.abs(got.vectors.T @ got.vectors - np.eye(m)).max(initial=0) <= 1e-12
    assert np.abs(v @ got.vectors - got.vectors * got.values).max(initial=0) <= 1e-13 * norm


def test_inertia_counts_signs():
    rnd = np.random.default_rng(7)
    for _ in range(1000):
        n = int(rnd.integers(1, 12))
        a = rnd.integers(-3, 4, (n, n)) * (rnd.random((n, n)) < rnd.random())
        a = np.triu(a) + np.triu(a, 1).T
        w = np.linalg.eigvalsh(a)
        if np.abs(w).min() > 1e-9:  # zero pivots first, indefinite blocks
            assert whitening.inertia(a) == ((w > 0).sum(), (w < 0).sum())


@pytest.mark.parametrize("n", [1, 2, 5, 64, 130])
def test_spectrum_of_random_matrices(n):
    a = np.random.default_rng(n).standard_normal((n + 20, n))
    check_spectrum(a.T @ a / n)


def test_clusters_rank_and_decay():
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((40, 40)))
    for values, wanted in (([9.] * 3 + [5.] * 2 + [1 + 1e-10, 1, 1, .5] + [1e-3] * 31, 16), ([1.] * 40, 16),
                           ([1 + 1e-13 * i for i in range(40)], 16), ([9.] * 3 + [0.] * 37, 3)):
        v = q @ np.diag(values) @ q.T
        check_spectrum((v + v.T) / 2, wanted=wanted)
    assert len(whitening.leading(np.zeros((4, 4))).values) == 0


def brute(rows):
    """Exact numbers per usable row: (x, n, S, covariance as fractions)."""
    good = [(i, [math.floor(64.0 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dims)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in fit) / n for b in range(dims)] for a in range(dims)]
    return good, fit, n, sums, mean, cov


def vectors(seed, n, dims):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rnd.gauss(0, 1 + j) for j in range(dims)]
        v[0] = v[1] + rnd.gauss(0, 0.1)
        rows.append((i, v))
    return rows + [(n + i, list(rows[i % 3][1])) for i in range(n // 2)]  # copies of three rows


def test_rows_equal_exact_arithmetic(spark):
    rows = vectors(1, 60, 5) + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [1.0, float("nan"), 0.0, 0.0, 0.0]),
                                (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0]),
                                (None, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, [0.5, 0.25, 0.125, -0.015625, -1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    good, fit, n, sums, mean, cov = brute([r for r in rows if not r[1] or len(r[1]) == 5])
    w, q = np.linalg.eigh(np.array([[float(e) for e in r] for r in cov]))
    w, q = w[::-1], q[:, ::-1]
    got = whitening.whiten(spark, df).collect()
    assert len(got) == len(good) * 5 and {r["n"] for r in got} == {n}
    seen = {}
    for r in got:
        seen.setdefault((r["id"], r["deviation"]), []).append((r["component"], r["whitened"], r["explained"]))
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        rows_of = sorted(seen[(i, deviation)])
        centred = np.array([float(a - m) for a, m in zip(x, mean)])
        for c, value, share in rows_of:
            assert abs(abs(value) - abs(centred @ q[:, c - 1]) / math.sqrt(w[c - 1])) < 1e-9
            assert abs(share - w[c - 1] / w.sum()) < 1e-9
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_large_entries_and_big_sums_stay_exact(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1e30, 1e30, 1e9, -7e8, 3.0]) for _ in range(3)]) for i in range(40)]
    got = whitening.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.count() % 40 == 0
    held = np.array([[1 << 30, -5], [7, 1 << 39]])
    want = [sum((9 * int(a) - s) ** 2 for a, s in zip(x, (11, -(1 << 41)))) for x in held]
    assert whitening._deviations(held, 9, [11, -(1 << 41)]) == [v if v < 2 ** 63 else None for v in want]


def test_tables_without_variance_or_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(spark, one).collect() == []
    assert whitening.whiten(spark, one.where("false")).collect() == []
    only_bad = spark.createDataFrame([(1, None), (2, [None])], "vec_id long, embedding array<float>")
    assert whitening.whiten(spark, only_bad).collect() == []


def test_clashing_columns_and_other_id_types(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(f"v{i}", v) for i, v in vectors(2, 30, 4)], "vec_id string, embedding array<float>")
    clash = df.withColumns({c: F.lit(1) for c in (*cases.CLASH, "x", "vector", "component", "n") if c != "id"})
    a = {(r["id"], r["component"], r["deviation"]) for r in whitening.whiten(spark, clash).collect()}
    assert a == {(r["id"], r["component"], r["deviation"]) for r in whitening.whiten(spark, df).collect()}
    assert len(a) == 45 * 4
