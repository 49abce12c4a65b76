"""Small cases with values worked out by hand, and properties."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from heddle.functions import text as T
from heddle.functions.special import t_two_sided
from heddle.operators import clusters, genomics, graph, metrics, ml, order, sweeps
from heddle.sources import readers
from heddle.streaming import weekly


def value(spark, column, **fields):
    return spark.createDataFrame([tuple(fields.values())], list(fields)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("No no nada", 2), ("", 0), ("  a  A b ", 2)])
def test_asr_length(spark, text, want):
    assert value(spark, T.asr_length(F.col("t")), t=text) == want


def test_intent_parts(spark):
    assert value(spark, T.intent_flow(F.col("t")), t="Bye - yes - open") == "bye"
    assert value(spark, T.intent_suffix(F.col("t")), t="Bye - yes - open") == "open"


@pytest.mark.parametrize(("text", "want"), [("no no sé", "no sé"), ("a b a b c", "a b c"), ("A a a", "A"), ("", ""), ("x y x y x y", "x y")])
def test_repeated_ngrams(spark, text, want):
    assert value(spark, T.drop_repeated_ngrams("t"), t=text) == want


def test_pressure_rule(spark):
    assert value(spark, T.is_systolic(F.col("x")), x=130.0) is True
    assert value(spark, T.is_systolic(F.col("x")), x=70.0) is False


def test_age_of_leap_day(spark):
    age = T.age_on(F.to_date("b"), F.to_date("d"))
    assert value(spark, age, b="2000-02-29", d="2001-02-28") == 0
    assert value(spark, age, b="2000-02-29", d="2001-03-01") == 1


def test_merge_pair(spark):
    words = F.split("t", " ")
    assert value(spark, T.merge_pair(words, "A", "A"), t="A A A") == ["AA", "A"]
    assert value(spark, T.merge_pair(words, "A", "B"), t="A A B B") == ["A", "AB", "B"]


def test_bigram_marks(spark):
    df = spark.createDataFrame([(1, i, "A") for i in range(4)], "doc long, index long, token string")
    assert sorted(r["index"] for r in genomics.pair_marks(df, "A", "A").collect()) == [0, 2]


def test_gaps(spark):
    df = spark.createDataFrame([(1, p) for p in (0, 1, 5, 6, 9)], "doc long, position long")
    assert sorted((r.start, r.end) for r in genomics.gaps_between(df).collect()) == [(2, 5), (7, 9)]


def test_set_scores(spark):
    a, b = F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (2, 3, 4, 5)))
    s = spark.range(1).select(*[v.alias(k) for k, v in metrics.set_scores(a, b).items()]).first()
    assert (s.jaccard, s.precision, round(s.recall, 6)) == (0.4, 0.5, 0.666667)


def test_efficiency(spark):
    assert value(spark, metrics.efficiency(F.col("s"), F.lit(None).cast("double")), s=300.0) == 50


def test_auc_and_ari_properties(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(y), round(float(s), 2)) for y, s in zip(rng.integers(0, 2, 200), rng.random(200), strict=True)], "y int, score double")
    up = metrics.auc(df, []).first()["auc"]
    down = metrics.auc(df.withColumn("score", -F.col("score")), []).first()["auc"]
    assert up == pytest.approx(1 - down)
    assert metrics.adjusted_rand(df.withColumn("z", F.col("y")), "y", "z").first()["ari"] == 1.0
    c = metrics.confusion(df.withColumn("yhat", F.lit(1)))
    assert metrics.per_class(c).agg(F.sum("support")).first()[0] == 200


def test_neighbours_by_blocks_agree_with_one_block(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(90)], "id long, vector array<double>")
    small = sorted((r.src, r.dst) for r in graph.nearest(df, 4, "euclidean", size=20).collect())
    assert small == sorted((r.src, r.dst) for r in graph.nearest(df, 4, "euclidean").collect())
    assert len(small) == 360


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(25)] + [(50, 60)], "src long, dst long")
    got = {r.node: r.component for r in graph.label_components(edges).collect()}
    assert got == {**{i: 0 for i in range(26)}, 50: 50, 60: 50}


def test_positions(spark):
    df = spark.createDataFrame([(i * 7 % 101, 1) for i in range(101)], "k long, one int")
    got = order.with_position(df, "k", "at").collect()
    assert all(r["at"] == r["k"] + 1 for r in got)


def matrix(spark, x, **more):
    rows = [(i, v, *[int(c[i]) for c in more.values()]) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, ", ".join(["id long", "vector array<double>", *[f"{n} int" for n in more]])).repartition(3).cache()


def found(df, name):
    return np.array([r[name] for r in df.orderBy("id").collect()])


def test_ica_finds_sources(spark):
    rng = np.random.default_rng(2)
    s = rng.laplace(size=(800, 3))
    got = found(ml.fast_ica(matrix(spark, s @ rng.normal(size=(3, 3))), 3), "sources")
    match = np.abs(np.corrcoef(got.T, s.T)[:3, 3:])
    assert match.max(1).min() > 0.95


def test_shared_factors_rebuild_blocks(spark):
    """Scores of rows made of two shared factors tell the factors apart."""
    rng = np.random.default_rng(4)
    w, side = rng.random((2, 12)) * (rng.random((2, 12)) > 0.4), rng.integers(0, 2, 200)
    h = np.where(side[:, None] == np.arange(2), 1.0, 0.05) * rng.uniform(0.5, 2, (200, 1))
    got = found(ml.shared_factors(matrix(spark, h @ w, block=np.arange(200) % 2), 2, 2), "scores")
    top = got.argmax(1)
    assert max((top == side).mean(), (top != side).mean()) > 0.95 and (got >= 0).all()


def test_batches_are_moved_together(spark):
    rng = np.random.default_rng(6)
    kind, batch = rng.integers(0, 2, 300), np.arange(300) % 3
    x = rng.normal(size=(300, 4)) * 0.1 + kind[:, None] * 5 + batch[:, None] * np.array([1.0, 0, 0, 0])
    got = found(ml.correct_batches(matrix(spark, x, batch=batch), 3, clusters=4, rounds=12), "vector")
    gap = lambda z: max(np.abs(z[(batch == b) & (kind == k)].mean(0) - z[kind == k].mean(0)).max() for b in range(3) for k in range(2))
    assert gap(got) < 0.3 * gap(x)
    assert np.abs(got[kind == 1].mean(0) - got[kind == 0].mean(0)).min() > 3


def test_doublets_lie_among_sums(spark):
    rng = np.random.default_rng(8)
    x = rng.poisson(np.where(np.arange(120)[:, None] % 2 == np.arange(10) % 2, 20, 1))
    x[:6] = x[10:16] + x[11:17]
    got = found(ml.doublet_scores(matrix(spark, x.astype(float))), "score")
    assert got[:6].mean() > 0.7 > 0.5 > got[6:].mean()


def test_smoothing_is_the_local_polynomial(spark):
    y = np.sin(np.arange(70) / 7) + np.random.default_rng(1).normal(size=70) * 0.1
    got = {r.k: r.smooth for r in ml.smooth(spark.createDataFrame([(3 * i, float(v)) for i, v in enumerate(y)], "k long, v double"), "k", "v").collect()}
    for i in range(70):
        at = np.arange(max(0, i - 15), min(70, i + 16))
        assert got[3 * i] == pytest.approx(np.polyval(np.polyfit(at - i, y[at], 3), 0), abs=1e-6)


def test_grouped_ridge_is_the_fit_to_all_rows(spark):
    rng = np.random.default_rng(12)
    x = rng.integers(60, 90, 300)
    y = 0.02 * (x - 70.0) ** 2 + rng.normal(size=300)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(900, 65, None), (901, None, 3.0)], "i long, x int, y double")
    alpha, gamma, got = ml.kernel_ridge(df, "x", "y", "i", [0.1, 100.0], [0.001, 0.01])
    k = np.exp(-gamma * (x[:, None] - x[None]) ** 2.0)
    weights = np.linalg.solve(k + alpha * np.eye(300), y)
    assert alpha == 0.1
    for r in got.collect():
        assert r.predicted == pytest.approx(np.exp(-gamma * (r.x - x) ** 2.0) @ weights, abs=1e-6)


def test_eigengap_counts_blocks():
    a = np.kron(np.eye(3), np.ones((10, 10)))
    laplacian = np.diag(a.sum(1)) - a
    assert ml.eigengap(np.linalg.eigvalsh(laplacian), 30) == 3


def leftmost(words, n):
    """Brute force: the leftmost repeat of n words goes, until there is none."""
    while at := [i for i in range(len(words) - 2 * n + 1) if [w.lower() for w in words[i : i + n]] == [w.lower() for w in words[i + n : i + 2 * n]]]:
        words = words[: at[0] + n] + words[at[0] + 2 * n :]
    return words


def test_repeated_ngrams_by_brute_force(spark):
    rng = np.random.default_rng(14)
    texts = [" ".join(rng.choice(list("abAB"), rng.integers(1, 14))) for _ in range(400)] + ["", "one"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.drop_repeated_ngrams(F.col("t")).alias("x")).collect()
    for r in got:
        assert r.x == " ".join(leftmost(leftmost(texts[r.i].split(" "), 1), 2))
    assert value(spark, T.drop_repeated_ngrams(F.col("t")), t="hola hola. ¿si si? no, no") == "hola. ¿si? no, no"
    assert value(spark, T.drop_repeated_ngrams(F.col("t")), t="que que va va, va va.") == "que va, va."


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = str(tmp_path / "in")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    weekly.append_stream(weekly.weekly_counts(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    whole = {tuple(r) for r in weekly.weekly_counts(events).collect()}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "event_type", "week", "n").collect()}
    assert got and got <= whole


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "gene_id" and df.count() == 10


def test_all_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_chunks_and_windows_keep_all_tokens(spark):
    from heddle.operators import sequences

    df = spark.createDataFrame([(1, "abcdefghijklm"), (2, "x")], "id long, s string")
    got = {r.id: r.s for r in sequences.shuffled_chunks(df, "id", "s", 4, 3).collect()}
    assert sorted(got[1]) == list("abcdefghijklm") and got[2] == "x"
    null = spark.createDataFrame([(None, "abc"), (3, None)], "id long, s string")
    assert sorted((r.id or 0, r.s is None) for r in sequences.shuffled_chunks(null, "id", "s", 4, 3).collect()) == [(0, False), (3, True)]
    words = spark.createDataFrame([(1, [str(i) for i in range(1500)])], "id long, t array<string>")
    rows = sorted(sequences.random_windows(words, "id", "t").collect(), key=lambda r: r.start)
    assert [w for r in rows for w in r.window] == [str(i) for i in range(1500)]
    assert sequences.dispatch("6-mer", "ACGTACG") == ["ACGTAC", "CGTACG"] and sequences.dispatch("other", "a b") == ["a", "b"]


def blobs(seed, n=240):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 3
    return rng.normal(size=(n, 2)) * 0.3 + np.array([[0, 0], [8, 0], [0, 8]])[label], label


def test_kmeans_sweep_by_brute_force(spark):
    x, label = blobs(16)
    got = {k: (i, s) for k, i, s in sweeps.kmeans_sweep(matrix(spark, x), range(2, 7))}
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    mean = np.array([[far[i, (label == c) & (np.arange(len(x)) != i)].mean() for c in range(3)] for i in range(len(x))])
    own = mean[np.arange(len(x)), label]
    other = np.where(np.eye(3)[label] == 1, np.inf, mean).min(1)
    inside = sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in range(3)) / len(x)
    assert got[3] == pytest.approx((inside, ((other - own) / np.maximum(own, other)).mean()), abs=1e-9)
    assert max(got, key=lambda k: got[k][1]) == 3 and sorted(got) == [2, 3, 4, 5, 6]
    assert sweeps.kmeans_sweep(matrix(spark, x).where("id < 0"), range(2, 4)) == []
    assert sweeps.kmeans_sweep(matrix(spark, np.zeros((4, 2))), range(2, 4)) == [(2, 0.0, 0.0), (3, 0.0, 0.0)]


def test_mixture_sweep_finds_the_number(spark):
    x, label = blobs(18)
    got = {(kind, k): bic for kind, k, _, bic in sweeps.mixture_sweep(matrix(spark, x), [(kind, 3) for kind in sweeps.KINDS] + [("full", k) for k in (2, 4, 5)])}
    assert min((k for k in got if k[0] == "full"), key=got.get) == ("full", 3)
    # Blobs far apart: the fit is that of each blob alone.
    n, loglik = len(x), 0.0
    for c in range(3):
        own = x[label == c]
        cov = np.cov(own.T, ddof=0) + 1e-6 * np.eye(2)
        z = own - own.mean(0)
        loglik += (np.log(len(own) / n) - np.log(2 * np.pi) - np.log(np.linalg.det(cov)) / 2 - (z @ np.linalg.inv(cov) * z).sum(1) / 2).sum()
    assert got["full", 3] == pytest.approx(sweeps.free_parameters("full", 3, 2) * np.log(n) - 2 * loglik, rel=1e-3)
    assert got["spherical", 3] < got["full", 3]


def test_dbscan_by_blocks(spark):
    """A chain, a border row between two clusters, equal rows and noise, in blocks of any size."""
    at = [0, 0.4, 0.8, 1.2, 1.6, 2.4, 3.2, 3.6, 4.0, 4.4, 4.8, 20, 30, 30, 30, 30]
    df = matrix(spark, np.array(at)[:, None])
    want = {i: 1 for i in range(6)} | {i: 6 for i in range(6, 11)} | {11: None} | {i: 12 for i in range(12, 16)}
    for size in (4, 2048):
        got = clusters.dbscan(df, 0.9, 4, size=size).collect()
        assert {r.id: r.cluster for r in got} == want, size
        assert sorted(r.id for r in got if not r.core) == [0, 5, 10, 11]
    assert clusters.dbscan(df.where("id < 0"), 1.0, 2).count() == 0
    grid = clusters.dbscan_grid(df, [(0.9, 4), (0.3, 4), (100.0, 2)], size=4).collect()
    assert {r.id: r.cluster for r in grid if (r.eps, r.least) == (0.9, 4)} == want
    assert {r.id: r.cluster for r in grid if r.eps == 0.3} == {i: 12 if i > 11 else None for i in want}
    assert {r.cluster for r in grid if r.eps == 100.0} == {0} and len(grid) == 3 * len(want)


def test_characterisation(spark):
    rng = np.random.default_rng(20)
    x = rng.normal(size=(60, 3)) * 0.2
    x[:20, 1] += 1.0
    active = spark.createDataFrame([(i, 0) for i in range(20)] + [(i, 1) for i in range(2)], "id long, component int")
    got = {(r.component, r.feature): (r.effect, r.n_rows) for r in metrics.characterise(matrix(spark, x), active).collect()}
    assert got[0, 1] == (pytest.approx(x[:20, 1].mean() - x[20:, 1].mean()), 20) and all(c == 0 for c, _ in got)
    for df, want in ((4, 2.776445), (10, 2.228139), (60, 2.000298)):
        assert value(spark, t_two_sided(F.col("t"), F.col("n")), t=want, n=float(df)) == pytest.approx(0.05, abs=1e-7)


def test_small_readers(spark, tmp_path):
    import gzip

    from heddle.sources import readers

    with gzip.open(tmp_path / "f.tsv.gz", "wt") as f:
        f.write("# comment\nchr1\t5\t9\tAAC-1\t2\nchr2\t0\t3\tGGT-1\t\n")
    assert [tuple(r) for r in readers.fragments(spark, str(tmp_path / "f.tsv.gz")).collect()] == [("chr1", 5, 9, "AAC-1", 2), ("chr2", 0, 3, "GGT-1", None)]
    (tmp_path / "h.csv").write_text("1,a\n2,b\n")
    assert [tuple(r) for r in readers.headerless_csv(spark, str(tmp_path / "h.csv")).collect()] == [("1", "a"), ("2", "b")]
    x = np.array([[0, 1.5], [2, 0]])
    np.save(tmp_path / "x.npy", x)
    np.savez(tmp_path / "x.npz", m=x)
    for name, of in (("x.npy", None), ("x.npz", "m")):
        assert sorted(tuple(r) for r in readers.numpy_matrix(spark, str(tmp_path / name), of).collect()) == [(0, 1, 1.5), (1, 0, 2.0)]


def test_index_of_neighbours(spark):
    """Exact with all cells probed; recall of 0.9 with a fifth of them; a third of the rows are equal."""
    from heddle.operators.neighbours import nearest_by_index

    rng = np.random.default_rng(22)
    x = rng.normal(size=(30, 8))[rng.integers(0, 30, 900)] * 2 + rng.normal(size=(900, 8))
    x[::3] = x[0]
    df = matrix(spark, x)
    for metric in ("cosine", "euclidean"):
        want = {(r.src, r.dst) for r in graph.nearest(df, 5, metric).collect()}
        every = nearest_by_index(df, 5, metric, probes=100, per_cell=15, block=40).collect()
        assert {(r.src, r.dst) for r in every} == want and len(every) == 4500
        some = nearest_by_index(df, 5, metric, probes=8, per_cell=15, block=40).collect()
        assert len(some) == 4500 and len(want & {(r.src, r.dst) for r in some if r.src % 3}) >= 0.9 * 3000
    few = nearest_by_index(df, 5, queries=df.where("id % 50 = 0")).collect()
    assert {r.src for r in few} == set(range(0, 900, 50))
    assert nearest_by_index(df.where("id < 0"), 5).count() == 0


def test_greedy_match_in_rounds(spark):
    """Against truths taken one after another; scores tie, and all want the same."""
    from heddle.operators.metrics import greedy_match

    rng = np.random.default_rng(8)
    for pairs in ([(g, d, float(rng.integers(0, 6)) / 5) for g in range(25) for d in range(20) if rng.random() < 0.5], [(g, d, 1 - d / 20) for g in range(8) for d in range(6)], []):
        want, used = [], set()
        for g in range(25):
            free = sorted((-s, d) for g2, d, s in pairs if g2 == g and d not in used and s > 0.1)
            if free:
                used.add(free[0][1])
                want.append((g, free[0][1], -free[0][0]))
        got = greedy_match(spark.createDataFrame(pairs, "gt long, disc long, score double"))
        assert sorted(tuple(r) for r in got.collect()) == want


def test_cells_are_not_broadcast(spark, sf):
    """Files of ascending ids look small to the planner."""
    from heddle.plans import catalogue

    got = catalogue.QUERIES["cell_dataset_bundle"](spark, sf)
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_repeated_words_are_linear(spark):
    """A long text is split once, not once a word."""
    from time import time

    n, began = 40_000, time()
    df = spark.createDataFrame([(" ".join(f"w{i // 2}" for i in range(n)),)], "t string")
    got = df.select(T.drop_repeated_words(F.col("t")).alias("t")).first()["t"]
    assert got.split(" ") == [f"w{i}" for i in range(n // 2)]
    assert time() - began < 30


def test_word_vectors_of_several_tasks(spark):
    """Words of one topic stay nearer than those of two, with the rows dealt to four tasks."""
    rng = np.random.default_rng(3)
    rows = [([f"{'ab'[i % 2]}{j}" for j in rng.integers(0, 6, 12)],) for i in range(2000)]
    got = ml.word_vectors(spark.createDataFrame(rows, "t array<string>"), "t", 8, rows_per_task=500).collect()
    unit = {r.word: np.array(r.vector) / np.linalg.norm(r.vector) for r in got}
    assert sorted(unit) == [f"{g}{j}" for g in "ab" for j in range(6)]
    inside = np.mean([unit[f"{g}{i}"] @ unit[f"{g}{j}"] for g in "ab" for i in range(6) for j in range(i)])
    across = np.mean([unit[f"a{i}"] @ unit[f"b{j}"] for i in range(6) for j in range(6)])
    assert inside > across + 0.2


def test_word_vectors_stay_in_tasks(spark, monkeypatch):
    """The number of words doesn't reach the driver: what comes to it is one row of counts. Copies of a row, of a word
    in a row, nulls and empty lists don't matter."""
    rng = np.random.default_rng(3)
    rows = [([f"{'ab'[i % 2]}{j}" for j in rng.integers(0, 6, 12)],) for i in range(1000)] + [(["c"] * 3000,), ([],), (None,), (["d", None],)]
    rows += [([f"once{i}", f"twice{i // 2}"],) for i in range(3000)]
    df = spark.createDataFrame(rows, "t array<string>").repartition(3)
    seen = []
    for name in ("collect", "toArrow", "toPandas"):
        plain = getattr(type(df), name)
        monkeypatch.setattr(type(df), name, lambda self, *a, plain=plain: (seen.append(1), plain(self, *a))[1])
    monkeypatch.setattr("pyspark.ml.wrapper.JavaEstimator.fit", lambda *a: pytest.fail("fits on the driver"), raising=False)
    found = ml.word_vectors(df, "t", 8, rows_per_task=2000)
    assert len(seen) <= 1
    monkeypatch.undo()
    got = {r.word: np.array(r.vector) for r in found.collect()}
    assert set(got) == {w for r in rows for w in r[0] or [] if w is not None} and all(np.isfinite(v).all() and len(v) == 8 for v in got.values())
    assert max(np.linalg.norm(v) for v in got.values()) < 20
    again = {r.word: np.array(r.vector) for r in ml.word_vectors(df, "t", 8, rows_per_task=2000).collect()}
    assert all(again[w] == pytest.approx(got[w], abs=1e-9) for w in got)
    assert ml.word_vectors(df.where("size(t) < 0"), "t", 8).count() == 0


def test_word_vectors_are_those_of_single_steps():
    """Pieces learn what steps of one pair after another do: the cosines of all words agree."""
    rng = np.random.default_rng(3)
    rows = [[f"{'ab'[i % 2]}{j}" for j in rng.integers(0, 6, 12)] for i in range(500)]
    words, got = ml._learnt(pa.chunked_array([pa.array(rows)]), 8, 42, 5, 0.025)
    at = {w: i for i, w in enumerate(words)}
    mine = ml._first_vectors(words, 8, 42).astype(float)
    out, noise = np.zeros_like(mine), np.cumsum(np.bincount([at[w] for r in rows for w in r]) ** 0.75)
    for n, row in enumerate(rows):
        for i, w in enumerate(row):
            b = rng.integers(1, 6)
            for j in [j for j in range(max(0, i - b), min(12, i + b + 1)) if j != i]:
                o = np.r_[at[row[j]], np.searchsorted(noise, rng.random(5) * noise[-1], side="right")]
                slope = (np.r_[1, 0, 0, 0, 0, 0] - 1 / (1 + np.exp(-out[o] @ mine[at[w]]))) * 0.025 * (1 - n / 500)
                turn = slope @ out[o]
                np.add.at(out, o, slope[:, None] * mine[at[w]])
                mine[at[w]] += turn
    cosines = lambda v: (lambda u: (u @ u.T).ravel())(v / np.linalg.norm(v, axis=1, keepdims=True))
    assert np.corrcoef(cosines(got), cosines(mine))[0, 1] > 0.95


def test_nearest_by_tiles(spark, monkeypatch):
    """Copies, ties, batches, some rows asked for, and tiles smaller than blocks; copies of rows by blocks are few."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 3)), 1)
    x[40:90] = x[7]
    monkeypatch.setattr(graph, "TILE", 7)
    monkeypatch.setattr(graph, "WIDE", 16)
    for metric in ("euclidean", "cosine"):
        norm = np.linalg.norm(x, axis=1)
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if metric == "euclidean" else -np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((120, 120)), where=np.outer(norm, norm) > 0)
        i, dst, score = graph._closest(x, np.arange(120), x, np.arange(120), 4, metric == "cosine")
        assert not np.isnan(score).any()
        for r in range(120):
            want = sorted((round(far[r, j], 9) + 0.0, j) for j in range(120) if j != r)[:4]
            assert dst[i == r].tolist() == [j for _, j in want], (metric, r)
    df = matrix(spark, x)
    every = {(r.src, r.dst) for r in graph.nearest(df, 4, "euclidean", size=50).collect()}
    some = {(r.src, r.dst) for r in graph.nearest(df, 4, "euclidean", size=50, asking=F.col("id") < 9).collect()}
    assert some == {p for p in every if p[0] < 9} and len(every) == 480
    assert graph._blocks(spark.range(40_000)).count() == 8 * 40_000


def test_nearest_takes_each_pair_of_blocks_once(spark, monkeypatch):
    """Both sides of a pair of blocks, copies, rows far off, and the other batches only: as by brute force, from half the copies."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4)) + 5
    x[40:60], x[100:160], x[200:210] = x[7], np.round(x[100:160]), x[200:210] * 1e6
    monkeypatch.setattr(graph, "TILE", 16)
    monkeypatch.setattr(graph, "WIDE", 64)
    monkeypatch.setattr(graph, "FIRST", 64)
    label = np.arange(300) % 3
    every = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = lambda r, ok: [j for _, j in sorted((round(every[r, j], 9), j) for j in range(300) if j != r and ok(j))[:4]]
    one, two = np.arange(0, 300, 2), np.arange(1, 300, 2)
    a, b = (graph._Distinct(x[i], i, np.ones(150, bool)) for i in (one, two))
    there, back = graph._each_other(a, b, 5, False)
    for found, mine, (p, q) in ((there, one, (a, b)), (back, two, (b, a))):
        row, dst, _ = graph._expanded(found, p, q, 4, False)
        for r in range(150):
            assert dst[row == r].tolist() == want(mine[r], lambda j, r=r, mine=mine: j % 2 != mine[r] % 2)
    df = matrix(spark, x).withColumn("batch", F.pmod("id", F.lit(3)))
    for across in (False, True):
        got = {}
        for r in graph.nearest(df, 4, "euclidean", batch="batch", size=100, across=across).orderBy("src", "batch", "rank").collect():
            got.setdefault((r.src, int(r.batch)), []).append(r.dst)
        assert got == {(r, g): want(r, lambda j, g=g: label[j] == g) for r in range(300) for g in range(3) if not (across and label[r] == g)}
    sent = []
    plain = type(df.groupBy("id")).applyInArrow
    monkeypatch.setattr(type(df.groupBy("id")), "applyInArrow", lambda self, f, schema: (sent.append(self._df.count()), plain(self, f, schema))[1])
    assert graph.nearest(df, 4, "euclidean", size=100).count() == 1200
    blocks = graph._blocks(df, 100).agg(F.max("own")).first()[0] + 1
    assert sent == [300 * blocks]


def test_dbscan_names_are_joined_by_few_links(spark, monkeypatch):
    """Random rows in many blocks against one; a dense cluster's blocks are joined by a link a pair of them,
    not by one for each row."""
    rng = np.random.default_rng(8)
    df = matrix(spark, rng.normal(size=(90, 2)))
    grid = [(0.2, 2), (0.2, 4), (0.5, 3), (3.0, 2)]
    one, many = ({tuple(r) for r in clusters.dbscan_grid(df, grid, size=n).collect()} for n in (2048, 9))
    assert one == many and len(one) == 4 * 90
    sent = []
    found = clusters.label_components
    monkeypatch.setattr(clusters, "label_components", lambda links: sent.append(links.count()) or found(links))
    clusters.dbscan_grid(df, [(100.0, 2)], size=9).count()
    assert sent[0] <= 10 * 9 / 2


def test_merge_pair_of_long_texts(spark):
    """200,000 tokens in a row: a fold that copies what it has would not end."""
    words = F.split("t", "")
    merged = F.array_join(T.merge_pair(F.filter(words, lambda x: x != ""), "t", "h"), "|")
    assert value(spark, merged, t="atthth") == "a|t|th|th"
    got = value(spark, F.size(T.merge_pair(F.filter(words, lambda x: x != ""), "t", "h")), t="thh" * 70_000)
    assert got == 140_000


def test_draws_are_dealt_to_all_cores(spark):
    from heddle.operators import generators

    made = generators.mechanisms(spark, spark.range(64).coalesce(1), 3, [])
    assert made.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert sorted(map(str, made.collect())) == sorted(map(str, generators.mechanisms(spark, 64, 3, []).collect()))


def test_draws_get_numbers_not_texts(spark):
    """Windows and chunks send Python seeds and lengths only."""
    from heddle.operators import sequences

    df = spark.createDataFrame([(i, "word " * (40 * i)) for i in range(5)] + [(9, None)], "id long, s string").repartition(2)
    split = df.select("id", F.split("s", " ").alias("t"))
    for made in (sequences.shuffled_chunks(df, "id", "s", 4, 3), sequences.random_windows(split, "id", "t", 30, 5)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    whole = {}
    for r in sorted(sequences.random_windows(split, "id", "t", 30, 5).collect(), key=lambda r: (r.id, r.start)):
        assert r.start == len(whole.setdefault(r.id, [])) and 1 <= len(r.window) <= 30
        whole[r.id] += r.window
    assert whole == {r.id: r.t for r in split.collect() if r.t}


def test_coordinate_file_in_parts(spark, tmp_path):
    """The sizes are those of the part with the banner, however small; lines of sidecars go on from part to part."""
    for name, text in {
        "matrix/a": "1 1 5\n2 3 7\n" + "1 2 4\n" * 40, "matrix/b": "%%MatrixMarket matrix coordinate real general\n% made\n2 3 43\n", "matrix/c": "2 1 9\n",
        "genes/a": "g1\tx\ng2\ty\n", "cells/a": "c1\n", "cells/b": "c2\nc3-with-a-longer-name\n",
    }.items():
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(text)
    rows = readers.matrix_market(spark, *[str(tmp_path / n) for n in ("matrix", "genes", "cells")]).collect()
    want = [("c1", "g1", 5.0), ("c3-with-a-longer-name", "g2", 7.0), ("c1", "g2", 9.0)] + [("c2", "g1", 4.0)] * 40
    assert sorted(tuple(r) for r in rows) == sorted(want)
