"""Boosted trees of many classes against trees grown by brute force."""

import numpy as np
import pytest

from heddle.operators import trees

ROWS = "id long, vector array<double>, label int"


def planted(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    y = np.where(x[:, 0] > 0.3, 2, np.where(x[:, 1] * x[:, 2] > 0, 5, 7))
    return x, y


def grown(x, y, edges, classes, rounds, depth, rate, penalty, least):
    """Margins of the training rows, each node's rows looked at as they are."""
    margins = np.zeros((len(x), len(classes)))
    for _ in range(rounds):
        p = trees.softmax(margins)
        new = margins.copy()
        for k, c in enumerate(classes):
            g, h = p[:, k] - (y == c), p[:, k] * (1 - p[:, k])
            score = lambda at: g[at].sum() ** 2 / (h[at].sum() + penalty)

            def grow(at, left):
                best, cut = 0.0, None
                for f, cuts in enumerate(edges):
                    for e in cuts:
                        low, high = at & (x[:, f] < e), at & (x[:, f] >= e)
                        if left and h[low].sum() >= least and h[high].sum() >= least:
                            gain = round(score(low) + score(high) - score(at), 9)
                            if gain > best:
                                best, cut = gain, (low, high)
                if cut is None:
                    new[at, k] -= rate * g[at].sum() / (h[at].sum() + penalty)
                else:
                    grow(cut[0], left - 1)
                    grow(cut[1], left - 1)

            grow(np.ones(len(x), bool), depth)
        margins = new
    return margins


def test_equal_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trees, "REWRITE", 2)
    x, y = planted(160, 1)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], ROWS).repartition(3)
    model = trees.fit_boosted(rows, rounds=5, depth=2, bins=8)
    want = grown(x, y, model.edges, [2, 5, 7], 5, 2, 0.3, 1.0, 1.0)
    assert np.allclose(model.margins(model.bins(x.tolist())), want, atol=1e-9)
    got = {r["id"]: r for r in trees.predict_boosted(model, rows).collect()}
    assert [got[i]["prediction"] for i in range(len(x))] == [[2, 5, 7][k] for k in want.argmax(1)]
    assert np.allclose([got[i]["scores"] for i in range(len(x))], trees.softmax(want))


def test_awkward_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, None], 0), (1, [1.0, None], 0), (2, None, 1), (3, [float("nan"), 2.0], 1), (4, [], None), (5, [1.0, 2.0], 0)], ROWS)
    model = trees.fit_boosted(rows, rounds=3, depth=2, least=0.01)
    got = trees.predict_boosted(model, rows).collect()
    assert len(got) == 6 and all(r["prediction"] in (0, 1) and sum(r["scores"]) == pytest.approx(1) for r in got)
    assert {r["id"]: r["prediction"] for r in got}[2] == 1
    none = trees.fit_boosted(rows.where("id > 9"))
    assert none is None and [r["prediction"] for r in trees.predict_boosted(none, rows).collect()] == [None] * 6
    one = trees.fit_boosted(rows.where("label = 1"), rounds=1)
    assert {r["prediction"] for r in trees.predict_boosted(one, rows).collect()} == {1}


def test_chosen_on_mcc(spark):
    x, y = planted(300, 2)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], ROWS)
    boosted = lambda n: lambda train, new: trees.predict_boosted(trees.fit_boosted(train, rounds=n, depth=3, bins=16), new)
    got = trees.chosen_on_mcc({"few": boosted(1), "many": boosted(6)}, rows.where("id % 3 = 0"), rows.where("id % 3 = 1"), rows.where("id % 3 = 2"))
    assert [g[0] for g in got] == ["few", "many"] and sum(g[3] for g in got) == 1
    assert max(got, key=lambda g: g[1])[3] and max(g[2] for g in got) > 0.5
