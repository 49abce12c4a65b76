"""Communities, spectra, layouts, mutual neighbours, information and special functions, by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import special
from heddle.operators import communities, doublets, graph, information, kernel_machine, layout, mutual, neighbours, spectral

EDGES = "src long, dst long, weight double"


def planted(seed, n, groups, inside, outside):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, groups, n)
    edges = [(i, j, float(rng.uniform(0.5, 1.5))) for i in range(n) for j in range(i + 1, n) if rng.random() < (inside if label[i] == label[j] else outside)]
    return edges, label


def reached(edges, nodes):
    """Whether nodes are connected by edges among themselves."""
    nodes, seen = set(nodes), set()
    todo = [min(nodes)]
    around = {v: [] for v in nodes}
    for a, b, _ in edges:
        if a in nodes and b in nodes:
            around[a].append(b)
            around[b].append(a)
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += around[v]
    return seen == nodes


def test_communities_beat_moves_of_one_level_and_are_connected(spark):
    ring = [(5 * c + i, 5 * c + j, 1.0) for c in range(8) for i in range(5) for j in range(i + 1, 5)] + [(5 * c, (5 * c + 6) % 40, 1.0) for c in range(8)]
    for edges in (ring, planted(1, 60, 4, 0.5, 0.04)[0]):
        df = spark.createDataFrame(edges, EDGES)
        found = communities.communities(df)
        got = {r.node: r.community for r in found.collect()}
        assert set(got) == {v for e in edges for v in e[:2]}
        nodes, links = communities._graph(df)
        _, once = communities.local_moves(nodes, links, nodes.select("node", F.col("node").alias("community")))
        assert graph.modularity(df, found).first()["modularity"] >= once - 1e-9
        for c in set(got.values()):
            own = [v for v in got if got[v] == c]
            assert min(own) == c and reached(edges, own)


def test_modularity_of_moves_is_the_true_one(spark):
    edges, label = planted(2, 40, 3, 0.5, 0.1)
    df = spark.createDataFrame(edges, EDGES)
    nodes, links = communities._graph(df)
    labels, q = communities.local_moves(nodes, links, nodes.select("node", F.col("node").alias("community")))
    assert graph.modularity(df, labels).first()["modularity"] == pytest.approx(q, abs=1e-9)


def dense(edges, n):
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    d = w.sum(1)
    return w / np.sqrt(np.outer(d, d))


def test_eigenvalues_are_those_of_a_dense_solver(spark):
    edges, _ = planted(3, 40, 3, 0.6, 0.05)
    edges += [(i, i + 1, 0.2) for i in range(39)]
    a = dense([(x, y, sum(w for p, q, w in edges if (p, q) == (x, y))) for x, y, _ in edges], 40)
    links, nodes = spectral.normalised_links(spark.createDataFrame(edges, EDGES))
    values, vectors = spectral.top_eigen(links, nodes, 5)
    assert values == pytest.approx(np.sort(np.linalg.eigvalsh(a))[::-1][:5], abs=1e-6)
    v = np.array([r.vector for r in vectors.orderBy("id").collect()])
    assert np.abs(a @ v - v * values).max() < 1e-4 and v.T @ v == pytest.approx(np.eye(5), abs=1e-6)


def test_rounds_of_the_spectrum_hold_three_blocks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    edges = [(i, i + 1, float(rng.uniform(0.5, 1.5))) for i in range(63)]
    widest, write = [0], spectral.materialise

    def noted(df, name, **options):
        out = write(df, name, **options)
        if "vector" in out.columns:
            widest[0] = max(widest[0], out.agg(F.max(F.size("vector"))).first()[0])
        return out

    monkeypatch.setattr(spectral, "materialise", noted)
    links, nodes = spectral.normalised_links(spark.createDataFrame(edges, EDGES))
    values, _ = spectral.top_eigen(links, nodes, 3, tolerance=1e-4)
    assert values == pytest.approx(np.sort(np.linalg.eigvalsh(dense(edges, 64)))[::-1][:3], abs=1e-6)
    # Three blocks of five columns, and what the graph makes of them, however many rounds it takes.
    assert widest[0] <= 30
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1, 1.0) for i in range(30)], EDGES)
    assert spectral.top_eigen(*spectral.normalised_links(pairs), 3)[0] == pytest.approx(np.ones(3), abs=1e-9)


def test_modules_of_a_graph(spark):
    edges = [(10 * c + i, 10 * c + j, 1.0) for c in range(3) for i in range(10) for j in range(i + 1, 10)] + [(0, 10, 0.1), (10, 20, 0.1)]
    got = {r.node: r.module for r in spectral.spectral_modules(spark.createDataFrame(edges, EDGES)).collect()}
    assert len(set(got.values())) == 3 and all(got[v] == got[v - v % 10] for v in got)
    few = spark.createDataFrame([(0, 1, 1.0)], EDGES)
    assert {r.module for r in spectral.spectral_modules(few).collect()} == {0}
    assert spectral.module_count(np.array([3.0, 1.0, 0.9, 0.2]), 30) == 3


def test_shifts_by_brute_force(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 3)) * np.array([4.0, 1, 1])
    b = a[:30] + np.array([1.0, 2.0, 0.5]) + rng.normal(size=(30, 3)) * 0.05
    frame = lambda x, start: spark.createDataFrame([(start + i, v) for i, v in enumerate(x.tolist())], "id long, vector array<double>")
    got = {r.id: r.shift for r in mutual.shifts(frame(a, 0), frame(b, 100), 3, 5, 4).collect()}
    far = np.sqrt(((b[:, None] - a[None]) ** 2).sum(2))
    pairs = [(i, j) for i in range(30) for j in range(40) if j in far[i].argsort()[:5] and i in far[:, j].argsort()[:5]]
    ways = {i: np.mean([a[j] - b[i] for k, j in pairs if k == i], 0) for i in {i for i, _ in pairs}}
    anchors = sorted(ways)
    for i in range(30):
        d = np.sqrt(((b[anchors] - b[i]) ** 2).sum(1))
        near = d.argsort(kind="stable")[:4]
        w = np.exp(-d[near] ** 2 / (2 * (d[near] ** 2).mean()))
        assert got[100 + i] == pytest.approx((w[:, None] * np.array([ways[anchors[k]] for k in near])).sum(0) / w.sum(), abs=1e-6)


def test_mutual_pairs_search_other_batches_only(spark, monkeypatch):
    """Pairs as by brute force; no row is searched for in its own batch."""
    rng = np.random.default_rng(15)
    x, batch = rng.normal(size=(90, 3)), np.arange(90) % 3
    rows = spark.createDataFrame([(i, x[i].tolist(), int(batch[i])) for i in range(90)], "id long, vector array<double>, batch int")
    searched, plain = [], mutual.nearest
    monkeypatch.setattr(mutual, "nearest", lambda *a, **o: (searched.append(plain(*a, **o)), searched[-1])[1])
    got = {(r.src, r.dst) for r in mutual.mutual_pairs(rows, 4).collect()}
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    near = {(i, j) for i in range(90) for b in range(3) if b != batch[i] for j in np.where(batch == b, far[i], np.inf).argsort()[:4]}
    assert got == {(i, j) for i, j in near if (j, i) in near and batch[i] < batch[j]}
    assert searched[0].count() == 90 * 2 * 4


def test_merging_takes_batches_together(spark):
    rng = np.random.default_rng(6)
    kind, batch = rng.integers(0, 2, 180), np.arange(180) % 3
    x = rng.normal(size=(180, 4)) * 0.3 + kind[:, None] * 8 + batch[:, None] * np.array([1.0, 0.5, 0, 0])
    rows = spark.createDataFrame([(i, x[i].tolist(), int(batch[i])) for i in range(180)], "id long, vector array<double>, batch int")
    got = np.array([r.vector for r in mutual.merge_batches(rows, 8, 8).orderBy("id").collect()])
    gap = lambda z: max(np.abs(z[(batch == b) & (kind == k)].mean(0) - z[kind == k].mean(0)).max() for b in range(3) for k in range(2))
    assert gap(got) < 0.5 * gap(x) and np.abs(got[kind == 1].mean(0) - got[kind == 0].mean(0)).min() > 6
    assert mutual.merge_order({("a", "b"): 1, ("b", "c"): 5, ("a", "c"): 2}, ["a", "b", "c", "d"]) == ["b", "c", "a", "d"]
    assert mutual.merge_batches(rows.where("id < 0")).count() == 0


@pytest.mark.parametrize("options", [{"supervised": True}, {"spectral": True, "batch": 50}, {"rounds": 20, "steps": 25}])
def test_layout_keeps_neighbours(spark, monkeypatch, options):
    monkeypatch.setattr(layout, "PART", 60)
    rng = np.random.default_rng(10)
    label = np.arange(150) % 3
    x = rng.normal(size=(150, 5)) + 12 * np.eye(3, 5)[label]
    rows = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(150)], "id long, vector array<double>, label int")
    placed = layout.layout(rows, **({"rounds": 8, "steps": 40} | options))
    got = np.array([r.xy for r in placed.orderBy("id").collect()])
    centre = np.array([got[label == k].mean(0) for k in range(3)])
    near = ((got[:, None] - centre[None]) ** 2).sum(2).argmin(1)
    assert len(got) == 150 and np.isfinite(got).all() and (near == label).mean() > 0.95
    assert layout.trustworthiness(rows, placed) > 0.88
    assert layout.layout(rows.where("id < 0")).count() == 0


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def test_information_by_brute_force(spark):
    rng = np.random.default_rng(7)
    label = rng.integers(0, 4, 120)
    label[0] = 9
    x = [np.float32(np.round(rng.normal(size=120) + label, 1)), np.float32(rng.normal(size=120)), np.float32(np.where(rng.random(120) < 0.5, 0, rng.normal(size=120) * label))]
    rows = [(i, f, int(label[i]), float(x[f][i])) for i in range(120) for f in range(3)]
    df = spark.createDataFrame(rows, "id long, feature int, class int, value double")
    got = {r.feature: r.mi for r in information.neighbour_information(df).collect()}
    for f in range(3):
        v, use = x[f].astype(float), [i for i in range(120) if (label == label[i]).sum() > 1]
        parts = []
        for i in use:
            same = np.sort(np.abs(v[label == label[i]] - v[i]))[1:]
            k = min(3, len(same))
            within = (np.abs(v[use] - v[i]) < same[k - 1]).sum() if same[k - 1] > 0 else (v[use] == v[i]).sum()
            parts.append(digamma(k) - digamma(len(same) + 1) - digamma(int(within)))
        assert got[f] == pytest.approx(max(0, digamma(len(use)) + np.mean(parts)), abs=1e-9)
    chosen = information.most_informative(spark.createDataFrame([(i, i / 10) for i in range(10)], "feature int, mi double")).where("selected").collect()
    assert sorted(r.feature for r in chosen) == [8, 9]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tails(spark):
    for z in (0.0, 0.3, 1.69, 1.71, 1.959963984540054, -3.0, 6.0, 20.0):
        assert one(spark, special.normal_two_sided(F.lit(z))) == pytest.approx(math.erfc(abs(z) / 2**0.5), rel=1e-9)
    # Where the tail has a closed form: 1, 2 and 4 degrees of freedom.
    for t in (0.0, 0.2, 1.0, 4.0, -30.0):
        a = abs(t)
        closed = {1: 1 - 2 / math.pi * math.atan(a), 2: 1 - a / math.sqrt(2 + a * a), 4: 1 - a * (a * a + 6) / (a * a + 4) ** 1.5}
        for df, p in closed.items():
            assert one(spark, special.t_two_sided(F.lit(t), F.lit(float(df)))) == pytest.approx(p, abs=1e-9)
    assert one(spark, special.t_two_sided(F.lit(1.96), F.lit(2e6))) == pytest.approx(math.erfc(1.96 / 2**0.5), abs=1e-6)
    assert one(spark, special.t_two_sided(F.lit(None).cast("double"), F.lit(3.0))) is None
    for x in (0.5, 1.0, 4.25, 170.0):
        assert one(spark, special.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-10)
    for n in (1, 2, 63, 64, 1000):
        assert one(spark, special.digamma(F.lit(n))) == pytest.approx(digamma(n), abs=1e-12)


def test_recall_of_the_index_at_its_defaults(spark):
    """50,000 rows in groups that overlap: 24 cells, of which 8 are searched."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(200, 16))[rng.integers(0, 200, 50_000)] + rng.normal(size=(50_000, 16)) * 0.6).astype("float32")
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(50_000), "vector": x.tolist()}), "id long, vector array<float>").repartition(8)
    ask = np.arange(0, 50_000, 250)
    got = neighbours.nearest_by_index(df, 5, "euclidean", queries=df.where("id % 250 = 0")).collect()
    found = {(r.src, r.dst) for r in got}
    hits = 0
    for i in ask:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += sum((i, j) in found for j in np.argpartition(d, 5)[:5])
    assert hits / (5 * len(ask)) >= 0.9


def test_kernel_machine(spark):
    """Three rings, which no plane parts: the map is the kernel on its landmarks, and few landmarks agree
    with the exact machine of all rows."""
    rng = np.random.default_rng(12)
    label = np.arange(240) % 3
    angle = rng.uniform(0, 2 * np.pi, 240)
    x = (1 + 2 * label)[:, None] * np.stack([np.cos(angle), np.sin(angle)], 1) + rng.normal(size=(240, 2)) * 0.2
    rows = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(240)], "id long, vector array<double>, label int")
    lift = kernel_machine.kernel_map(rows, 240, 0.3)
    assert lift(x) @ lift(x).T == pytest.approx(np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2)), abs=1e-6)
    train, test = rows.where("id < 180"), rows.where("id >= 180")
    answer = lambda n: {r.id: r.prediction for r in kernel_machine.kernel_classifier(train, test, landmarks=n, gamma=0.3).collect()}
    exact, few = answer(180), answer(40)
    assert np.mean([exact[i] == label[i] for i in exact]) > 0.95 and np.mean([exact[i] == few[i] for i in exact]) > 0.95
    assert {r.prediction for r in kernel_machine.kernel_classifier(train.where("id < 0"), test).collect()} == {None}


def test_enrichment_tails(spark):
    for k, n, m, a in ((3, 10, 12, 50), (0, 5, 4, 9), (5, 5, 7, 9), (6, 5, 7, 9), (2, 4, 8, 9)):
        want = sum(math.comb(m, i) * math.comb(a - m, n - i) for i in range(k, min(n, m) + 1)) / math.comb(a, n)
        assert one(spark, special.hypergeometric_tail(*map(F.lit, (k, n, m, a)))) == pytest.approx(want, abs=1e-10)


def test_valley():
    assert doublets.valley([9, 12, 7, 3, 1, 2, 6, 8, 4]) == 4
    assert doublets.valley([9, 7, 5, 3, 1]) is None and doublets.valley([]) is None


def test_planted_doublets(spark):
    """Six sums of unlike cells among 90 cells of two kinds: by threshold and by enrichment."""
    rng = np.random.default_rng(8)
    x = rng.poisson(np.where(np.arange(90)[:, None] % 2 == np.arange(10) % 2, 20, 1))
    x[:6] = x[10:16] + x[11:17]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(float).tolist())], "id long, vector array<double>")
    called = {r.id: r.doublet for r in doublets.doublet_calls(rows).collect()}
    found = {r.id: r.doublet for r in doublets.enriched_doublets(rows).collect()}
    for got in (called, found):
        assert len(got) == 90 and sum(got[i] for i in range(6)) >= 5 and sum(got[i] for i in range(6, 90)) <= 9


def test_moves_take_few_rounds(spark, monkeypatch):
    """A graph that fits a part is done in one round of moves; cut into parts it has no less than its truth's
    modularity, but for a hundredth."""
    edges, label = planted(11, 120, 4, 0.4, 0.02)
    df = spark.createDataFrame(edges, EDGES)
    truth = graph.modularity(df, spark.createDataFrame([(i, int(g)) for i, g in enumerate(label)], "node long, community long")).first()["modularity"]
    names, plain = [], communities.materialise
    monkeypatch.setattr(communities, "materialise", lambda frame, name, **o: (names.append(name), plain(frame, name, **o))[1])
    found = communities.communities(df)
    assert graph.modularity(df, found).first()["modularity"] >= truth - 0.01
    assert names.count("moves_0") == names.count("state") and "moves_1" not in names
    monkeypatch.setattr(communities, "PART", 30)
    found = communities.communities(df)
    assert "moves_1" in names and graph.modularity(df, found).first()["modularity"] >= truth - 0.01


def test_a_graph_of_many_nodes_is_a_part(spark, monkeypatch):
    """20,000 nodes in a ring of groups take one round of moves a level, one after another, and rounds of names none;
    communities that their links don't connect are taken apart alike by parts and by rounds."""
    n = 20_000
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(*[F.pmod(F.col("id"), F.lit(10)) + i + 1 for i in range(4)])).alias("at"))
    edges = edges.where("at < 10").select("src", (F.col("src") - F.pmod("src", F.lit(10)) + F.col("at")).alias("dst"), F.lit(1.0).alias("weight"))
    edges = edges.union(spark.range(0, n, 10).select(F.col("id"), F.pmod(F.col("id") + 10, F.lit(n)), F.lit(0.1)))
    names, plain = [], communities.materialise
    monkeypatch.setattr(communities, "materialise", lambda frame, name, **o: (names.append(name), plain(frame, name, **o))[1])
    found = communities.communities(edges)
    assert graph.modularity(edges, found).first()["modularity"] > 0.98
    assert "moves_1" not in names and "labels" not in names
    links = communities._graph(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (2, 6, 1.0), (7, 7, 1.0)], EDGES))[1]
    labels = spark.createDataFrame([(i, 0 if i < 6 else 6) for i in range(8)], "node long, community long")
    for part in (65_536, 3):
        monkeypatch.setattr(communities, "PART", part)
        assert {tuple(r) for r in communities.connected_parts(links, labels).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7)}
