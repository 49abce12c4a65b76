"""Kernel ridge of several features against dense solutions."""

import numpy as np
from pyspark.sql import functions as F

from heddle.operators import ridge


def dense(x, y, new, kind, alpha, gamma):
    kernel = (lambda a, b: a @ b.T) if kind == "linear" else (lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2)))
    return kernel(new, x) @ np.linalg.solve(kernel(x, x) + alpha * np.eye(len(x)), y)


def test_grid_equals_dense_solutions(spark):
    rng = np.random.default_rng(4)
    n, folds = 90, 3
    x = np.column_stack([rng.integers(0, 2, n), rng.integers(20, 30, n), rng.integers(60, 70, n)]).astype(float)
    y = np.round(60 + 3 * x[:, 0] + np.sin(x[:, 1]) * 5 + 0.3 * x[:, 2] + rng.normal(size=n), 3)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    rows += [(100 + i, *map(float, v), None) for i, v in enumerate(x[:20] + [0, 0.5, 0])] + [(200, None, 25.0, 65.0, None), (201, None, 25.0, 65.0, 80.0), (100, *map(float, x[0]), None)]
    df = spark.createDataFrame(rows, "k long, male double, age double, low double, high double")
    alphas, gammas = [0.1, 10.0], [0.1, 1.0]
    best, got = ridge.ridge_grid(df, ["male", "age", "low"], "high", "k", alphas, gammas, folds, size=32)
    z = (x - x.mean(0)) / x.std(0)
    fold = np.array([r["f"] for r in df.where("k < 100").orderBy("k").select(F.pmod(F.xxhash64("k"), F.lit(folds)).alias("f")).collect()])
    scores = {}
    for kind, alpha, gamma in [("linear", a, 0.0) for a in alphas] + [("rbf", a, g) for g in gammas for a in alphas]:
        each = []
        for f in range(folds):
            out = fold == f
            p = dense(z[~out], y[~out], z[out], kind, alpha, gamma)
            each.append(1 - ((y[out] - p) ** 2).sum() / ((y[out] - y[out].mean()) ** 2).sum())
        scores[kind, alpha, gamma] = np.mean(each)
    want = max(scores, key=scores.get)
    assert best[:3] == want and abs(best[3] - scores[want]) < 1e-6
    new = np.array([r[1:4] for r in rows if r[0] >= 100 and r[1] is not None])
    p = dense(z, y, (new - x.mean(0)) / x.std(0), *want)
    keys = [r[0] for r in rows if r[0] >= 100 and r[1] is not None]
    found = sorted((r["k"], r["predicted"]) for r in got.collect())
    want = sorted(zip(keys, map(float, p), strict=True))
    assert [k for k, _ in found] == [k for k, _ in want] and np.allclose([v for _, v in found], [v for _, v in want], rtol=0, atol=1e-6)
    assert ridge.ridge_grid(df.where("high IS NULL"), ["age"], "high", "k", alphas, gammas)[0] is None


def test_many_rows_a_point_take_few_passes(spark, monkeypatch):
    """Passes don't grow with the rows of a point: gradients are preconditioned."""
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), float(60 + 3 * np.sin(a) + b + rng.normal())) for i, (a, b) in enumerate(rng.integers(0, 20, (8000, 2)))]
    df = spark.createDataFrame([*rows, (9000, 3.0, 4.0, None)], "k long, a double, b double, y double").cache()
    names, plain = [], ridge.materialise
    monkeypatch.setattr(ridge, "materialise", lambda frame, name, **o: (names.append(name), plain(frame, name, **o))[1])
    best, got = ridge.ridge_grid(df, ["a", "b"], "y", "k", [1.0], [0.1], 3)
    x, y = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    mean, scale = x.mean(0), x.std(0)
    points, back = np.unique(x, axis=0, return_inverse=True)
    n, s = np.bincount(back), np.bincount(back, y)
    z, new = (points - mean) / scale, (np.array([[3.0, 4.0]]) - mean) / scale
    d = np.sqrt(n)
    kernel = (lambda a, b: a @ b.T) if best[0] == "linear" else (lambda a, b: np.exp(-best[2] * ((a[:, None] - b[None]) ** 2).sum(2)))
    want = kernel(new, z) @ (d * np.linalg.solve(d[:, None] * kernel(z, z) * d + best[1] * np.eye(len(z)), s / d))
    assert abs(got.first()["predicted"] - want[0]) < 1e-5 and names.count("product") <= 15
