"""Models: Spark's own where it has them, else passes over all rows that sum up small arrays."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.workspace import materialise, ship_package

def features(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def pca(df: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """``df`` with ``pca`` array<double> of centred, scaled features, and the explained shares."""
    model = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="_z", withMean=True), PCA(k=k, inputCol="_z", outputCol="_p")]).fit(df)
    return model.transform(df).withColumn("pca", vector_to_array("_p")).drop("_z", "_p"), model.stages[-1].explainedVariance.toArray().tolist()


def classifier(name: str, **options):
    """LR (L1 logistic), RF, XG (boosted trees), SVM (linear); the last two by one-vs-rest."""
    made = {
        "LR": lambda: LogisticRegression(elasticNetParam=1.0, regParam=0.01, **options),
        "RF": lambda: RandomForestClassifier(seed=42, **options),
        "XG": lambda: GBTClassifier(seed=42, **options),
        "SVM": lambda: OneVsRest(classifier=LinearSVC(**options)),
    }
    return made[name]()


def grid_search(df: DataFrame, model, grid: dict, folds: int = 5, parallelism: int = 4):
    build = ParamGridBuilder()
    for param, values in grid.items():
        build = build.addGrid(getattr(model, param), values)
    cv = CrossValidator(estimator=model, estimatorParamMaps=build.build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, parallelism=parallelism, seed=42)
    return cv.fit(df)


#: Words of a task at most on the average; of a piece that is learnt from at once; drawn words of a piece, and for each pair.
WORDS_PER_TASK, PIECE, DRAWN, NEGATIVE = 4_194_304, 64, 64, 5


def _first_vectors(words: list[str], size: int, seed: int) -> np.ndarray:
    """Numbers within a half over ``size``, from each word's own bytes, so that all tasks start alike."""
    z = np.array([zlib.crc32(w.encode()) for w in words], dtype="uint64")[:, None] * np.uint64(2 * size) + np.arange(size, dtype="uint64") + np.uint64(seed << 44)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return (((z >> np.uint64(11)) / 2.0**53 - 0.5) / size).astype("float32")


def _learnt(lists: pa.ChunkedArray, size: int, seed: int, window: int, rate: float) -> tuple[list[str], np.ndarray]:
    """(words, a vector for each) of lists of words: skip-grams with drawn words, in one pass.

    A word is to tell the words at most ``window`` from it from ``NEGATIVE`` times as many that are drawn by
    the power 0.75 of their numbers; a piece of a list draws its own and learns as one product. Steps are cut by the
    curvature that the piece's pairs add up to, so that a word's repeats don't carry it too far.
    """
    coded = pa.chunked_array([c.flatten() for c in lists.chunks], lists.type.value_type).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    ids, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    mine, out, rng = _first_vectors(words, size, seed), np.zeros((len(words), size), "float32"), np.random.default_rng(seed)
    noise = np.cumsum(np.bincount(ids, minlength=len(words)) ** 0.75)
    apart = np.abs(np.arange(PIECE)[:, None] + window - np.arange(PIECE + 2 * window))
    for begin, end in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
        for s in range(begin, end, PIECE):
            e, low, high = min(s + PIECE, end), max(begin, s - window), min(end, s + PIECE + window)
            far = apart[: e - s, low - s + window : high - s + window]
            met = (far <= rng.integers(1, window + 1, e - s)[:, None]) & (far > 0)
            drawn = np.searchsorted(noise, rng.random(DRAWN) * noise[-1], side="right")
            own, i = np.unique(ids[s:e], return_inverse=True)
            others, j = np.unique(np.r_[ids[low:high], drawn], return_inverse=True)
            n, m = len(own), len(others)
            yes = np.bincount((i[:, None] * m + j[: high - low])[met], minlength=n * m).reshape(n, m).astype("float32")
            no = np.outer(yes.sum(1), np.bincount(j[high - low :], minlength=m) * (NEGATIVE / DRAWN)).astype("float32")
            a, b, step = mine[own], out[others], np.float32(rate * max(1e-4, 1 - s / len(ids)))
            both, slope = yes + no, yes - (yes + no) / (1 + np.exp(-a @ b.T))
            mine[own] += slope @ b * (step / (1 + step * (both @ (b**2).sum(1)) / 4))[:, None]
            out[others] += slope.T @ a * (step / (1 + step * ((a**2).sum(1) @ both) / 4))[:, None]
    return words, mine


def word_vectors(df: DataFrame, column: str, size: int = 32, seed: int = 42, rows_per_task: int = 16_384, window: int = 5, rate: float = 0.025) -> DataFrame:
    """word, vector of every word of lists. Each ``rows_per_task`` rows are learnt from by a task of its own, and
    the tasks' vectors of a word are averaged; up to that many rows there is one task (rows of very many words have
    more). Words and vectors stay in tasks; none comes to the driver."""
    ship_package(df.sparkSession)
    lists = materialise(df.select(F.filter(column, lambda w: w.isNotNull()).alias("words")), "words")
    many = lists.agg(F.count("*").alias("rows"), F.sum(F.greatest(F.size("words"), F.lit(0))).alias("words")).first()
    tasks = max(1, -(-many["rows"] // rows_per_task), -(-(many["words"] or 0) // WORDS_PER_TASK))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if kept:
            words, found = _learnt(pa.Table.from_batches(kept).column("words"), size, seed, window, rate)
            for s in range(0, len(words), 10_000):
                values = pa.array(found[s : s + 10_000].ravel().astype("float64"))
                vectors = pa.FixedSizeListArray.from_arrays(values, size).cast(pa.list_(pa.float64()))
                yield pa.record_batch([pa.array(words[s : s + 10_000], pa.string()), vectors], ["word", "vector"])

    dealt = lists.repartition(tasks).sortWithinPartitions(F.xxhash64("words"))
    found = materialise(dealt.mapInArrow(work, "word string, vector array<double>"), "learnt")
    return found.groupBy("word").agg(F.array(*[F.avg(F.col("vector")[j]) for j in range(size)]).alias("vector"))


def eigengap(values: np.ndarray, n: int) -> int:
    """Number of clusters from the largest gap of the ascending eigenvalues of a Laplacian."""
    gaps = np.diff(np.sort(values)[: max(3, n // 10) + 1])
    return int(np.argmax(gaps)) + 1


def summed(rows: DataFrame, f: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``f`` makes of a batch: its vectors as a matrix, and its frame.

    Every batch gives one array, arrays are added up by their elements in Spark, and the sum alone
    comes to the driver; its size is that of ``f``'s array, whatever the number of rows.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in frames:
            if len(batch):
                got = np.asarray(f(np.array(batch["vector"].tolist(), float), batch), float).ravel()
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "x": total})

    ship_package(rows.sparkSession)
    found = rows.mapInPandas(work, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    return np.array([r["x"] for r in found])


def mapped(rows: DataFrame, f: Callable[[np.ndarray, pd.DataFrame], np.ndarray], name: str) -> DataFrame:
    """id and an array: what ``f`` makes of each row of a batch."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], name: list(f(np.array(batch["vector"].tolist(), float), batch))})

    ship_package(rows.sparkSession)
    return rows.mapInPandas(work, f"id long, {name} array<double>")


def fast_ica(rows: DataFrame, k: int, seed: int = 42, steps: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """id, sources: independent components of rows (id, vector) by symmetric fixed-point iteration
    with tanh on whitened data. Each step is one pass over the rows that sums up a k x k matrix."""
    first = rows.first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "id long, sources array<double>")
    d = len(first["vector"])
    sums = summed(rows, lambda x, _: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))
    n, mean = sums[0], sums[1 : d + 1] / sums[0]
    values, axes = np.linalg.eigh(sums[d + 1 :].reshape(d, d) / n - np.outer(mean, mean))
    kept = [i for i in np.argsort(-values)[:k] if values[i] > 1e-9 * max(values.max(), 1e-300)]
    whiten = axes[:, kept] / np.sqrt(values[kept])
    k = len(kept)

    def decorrelate(w: np.ndarray) -> np.ndarray:
        a, _, b = np.linalg.svd(w)
        return a @ b

    w = decorrelate(np.random.default_rng(seed).normal(size=(k, k)))
    for _ in range(steps if k else 0):

        def moments(x: np.ndarray, _: pd.DataFrame, w: np.ndarray = w) -> np.ndarray:
            z = (x - mean) @ whiten
            g = np.tanh(z @ w.T)
            return np.concatenate([(g.T @ z).ravel(), (1 - g**2).sum(0)])

        s = summed(rows, moments) / n
        new = decorrelate(s[: k * k].reshape(k, k) - s[k * k :, None] * w)
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < tolerance
        w = new
        if done:
            break
    return mapped(rows, lambda x, _: (x - mean) @ whiten @ w.T, "sources")


def loadings(x: np.ndarray, both: np.ndarray, own: np.ndarray, penalty: float, inner: int = 30) -> np.ndarray:
    """Nonnegative scores of rows on factors ``both`` = shared + own, by multiplicative updates."""
    h = np.full((len(x), len(both)), x.mean() + 1e-3)
    top, gram = x @ both.T, both @ both.T + penalty * own @ own.T
    for _ in range(inner):
        h *= top / (h @ gram + 1e-9)
    return h


def shared_factors(rows: DataFrame, blocks: int, k: int, penalty: float = 5.0, steps: int = 50, seed: int = 42) -> DataFrame:
    """id, scores: integrative factorisation of nonnegative rows (id, vector, block 0..blocks-1).

    Scores of a row follow from the factors alone, so a step is one pass over the rows that sums up
    h'x and h'h of each block; shared and own factors are then updated on the driver, k x features
    numbers a block.
    """
    first = rows.first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "id long, scores array<double>")
    d, rng = len(first["vector"]), np.random.default_rng(seed)
    w, v = rng.random((k, d)), rng.random((blocks, k, d))
    for _ in range(steps):

        def sums(x: np.ndarray, frame: pd.DataFrame, w: np.ndarray = w, v: np.ndarray = v) -> np.ndarray:
            out, block = np.zeros((blocks, k, d + k)), frame["block"].to_numpy()
            for b in range(blocks):
                own = x[block == b]
                if len(own):
                    h = loadings(own, w + v[b], v[b], penalty)
                    out[b] = np.hstack([h.T @ own, h.T @ h])
            return out

        s = summed(rows, sums).reshape(blocks, k, d + k)
        hx, hh = s[:, :, :d], s[:, :, d:]
        for _ in range(10):
            v = v * hx / (hh @ (w + (1 + penalty) * v) + 1e-9)
            w = w * hx.sum(0) / ((hh @ (w + v)).sum(0) + 1e-9)

    def scores(x: np.ndarray, frame: pd.DataFrame) -> np.ndarray:
        out, block = np.zeros((len(x), k)), frame["block"].to_numpy()
        for b in range(blocks):
            out[block == b] = loadings(x[block == b], w + v[b], v[b], penalty)
        return out

    return mapped(rows, scores, "scores")


def correct_batches(rows: DataFrame, batches: int, clusters: int = 5, rounds: int = 5, seed: int = 42) -> DataFrame:
    """id, vector of rows (id, vector, batch 0..batches-1): soft clusters over all batches; each
    cluster's batch means are moved onto its own mean.

    A row's place after a round follows from the centres of the rounds so far, so each round is one
    pass that sums up members and places by batch and cluster.
    """
    picked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(clusters).collect()
    if not picked:
        return rows.select("id", F.col("vector").cast("array<double>").alias("vector"))
    centre = np.array([r["vector"] for r in picked], float)
    many, d = centre.shape
    scale = summed(rows, lambda x, _: np.array([len(x), ((x[:, None, :] - centre[None]) ** 2).sum(2).min(1).sum()]))
    width = scale[1] / scale[0] + 1e-9
    moves: list[tuple[np.ndarray, np.ndarray]] = []

    def members(z: np.ndarray, centre: np.ndarray) -> np.ndarray:
        far = ((z[:, None, :] - centre[None]) ** 2).sum(2)
        r = np.exp(-(far - far.min(1, keepdims=True)) / width)
        return r / r.sum(1, keepdims=True)

    def moved(x: np.ndarray, batch: np.ndarray, moves: list) -> np.ndarray:
        for at, shift in moves:
            x = x - np.einsum("nk,nkd->nd", members(x, at), shift[batch])
        return x

    for _ in range(rounds):

        def sums(x: np.ndarray, frame: pd.DataFrame, moves: tuple = tuple(moves), centre: np.ndarray = centre) -> np.ndarray:
            batch, out = frame["batch"].to_numpy(), np.zeros((batches, many, d + 1))
            z = moved(x, batch, moves)
            r = members(z, centre)
            for b in range(batches):
                own = batch == b
                out[b] = np.hstack([r[own].T @ z[own], r[own].sum(0)[:, None]])
            return out

        s = summed(rows, sums).reshape(batches, many, d + 1)
        centre_now = s[:, :, :d].sum(0) / (s[:, :, d].sum(0)[:, None] + 1e-9)
        shift = s[:, :, :d] / (s[:, :, d:] + 1e-9) - centre_now
        moves.append((centre, np.where(s[:, :, d:] > 1e-6, shift, 0.0)))
        centre = centre_now
    return mapped(rows, lambda x, frame: moved(x, frame["batch"].to_numpy(), moves), "vector")


def with_sums(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(cells: id, at; logarithms of cells and of as many sums of two, by id; number of cells) of counts
    (id, vector). A cell's id is its place, its sum's that and the number of cells. Cell number i is
    added to the cell a fixed pseudorandom step on."""
    from heddle.operators.order import with_position

    placed = materialise(with_position(rows.select("id", "vector"), "id", "at"), "cells")
    n = placed.count()
    other = placed.select(F.col("at").alias("_at"), F.col("vector").alias("_v"))
    step = 1 + F.pmod(F.xxhash64("at"), F.lit(max(1, n - 1)))
    pairs = placed.withColumn("_at", F.pmod(F.col("at") - 1 + step, F.lit(max(1, n))) + 1).join(other, "_at")
    log = lambda v: F.transform(v, lambda x: F.log1p(F.greatest(F.lit(0.0), x.cast("double"))))
    cells = placed.select(F.col("at").alias("id"), log("vector").alias("vector"), F.lit("cell").alias("kind"))
    sums = pairs.select((F.col("at") + n).alias("id"), log(F.zip_with("vector", "_v", lambda a, b: a + b)).alias("vector"), F.lit("sum").alias("kind"))
    return placed.select("id", "at"), materialise(cells.unionByName(sums), "every"), n


def doublet_scores(rows: DataFrame, k: int = 10) -> DataFrame:
    """id, score of rows (id, vector) of counts: share of simulated sums of two cells among each
    cell's nearest neighbours."""
    from heddle.operators.graph import nearest

    cells, every, n = with_sums(rows)
    if not n:
        return rows.sparkSession.createDataFrame([], "id long, score double")
    near = nearest(every, k, "euclidean", asking=F.col("id") <= n)
    share = near.groupBy("src").agg(F.avg((F.col("dst") > n).cast("double")).alias("score"))
    return cells.select("id", F.col("at").alias("src")).join(share, "src", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def grouped_ridge(x: np.ndarray, y: np.ndarray, n: np.ndarray, alpha: float, gamma: float):
    """Predictor of an RBF kernel ridge fit to rows given as distinct x with mean y and number n.

    Rows of one x share a kernel row, so this is the fit to all rows, of the size of the distinct x.
    """
    kernel = lambda a: np.exp(-gamma * (a[:, None] - x[None]) ** 2)
    weights = np.linalg.solve(kernel(x) + alpha * np.diag(1.0 / n), y)
    return lambda new: kernel(new) @ weights


def kernel_ridge(df: DataFrame, x: str, y: str, key: str, alphas: list[float], gammas: list[float], folds: int = 10) -> tuple[float, float, DataFrame]:
    """(alpha, gamma, table of x and predicted y): RBF kernel ridge of one whole-numbered feature,
    with the pair of least squared error over hash folds.

    Rows are summed up by fold and x in Spark; the driver gets a row per fold and distinct reading.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    sums = known.groupBy("fold", F.col(x).cast("double").alias("x")).agg(F.sum(F.col(y).cast("double")).alias("s"), F.sum(F.col(y).cast("double") ** 2).alias("q"), F.count("*").alias("n"))
    t = sums.toPandas().sort_values(["x", "fold"])

    def fit(rows: pd.DataFrame, alpha: float, gamma: float):
        g = rows.groupby("x")[["s", "n"]].sum()
        return grouped_ridge(g.index.to_numpy(float), (g["s"] / g["n"]).to_numpy(float), g["n"].to_numpy(float), alpha, gamma)

    def error(alpha: float, gamma: float) -> float:
        total = 0.0
        for f in sorted(set(t["fold"])):
            held, rest = t[t["fold"] == f], t[t["fold"] != f]
            if len(rest):
                p = fit(rest, alpha, gamma)(held["x"].to_numpy(float))
                total += float((held["q"] - 2 * p * held["s"] + held["n"] * p**2).sum())
        return total

    alpha, gamma = min(((a, g) for a in alphas for g in gammas), key=lambda p: (round(error(*p), 6), p))
    every = df.select(F.col(x).cast("double").alias("x")).where("x IS NOT NULL").distinct().toPandas()["x"].sort_values().to_numpy(float)
    predicted = fit(t, alpha, gamma)(every) if len(t) and len(every) else np.zeros(0)
    table = df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(every, predicted, strict=False)], "x double, predicted double")
    return alpha, gamma, table


def stencil(window: int = 31, order: int = 3) -> list[tuple[int, int, int, float]]:
    """(before, after, offset, weight): by how many rows of the window there are before and after a
    row, the weights of its neighbours in the value of the local polynomial there."""
    half, out = window // 2, []
    for before, after in itertools.product(range(half + 1), repeat=2):
        at = np.arange(-before, after + 1)
        fit = np.linalg.pinv(np.vander(at.astype(float), min(order, len(at) - 1) + 1, increasing=True))[0]
        out += [(before, after, int(o), float(x)) for o, x in zip(at, fit, strict=True)]
    return out


def smooth(df: DataFrame, key: str, value: str, window: int = 31, order: int = 3) -> DataFrame:
    """key, smooth: local polynomial smoothing in the order of ``key`` (unique); near the ends the
    window is cut. Every row gives its share to the rows of its window, so no task has them all."""
    from heddle.operators.order import with_position

    half = window // 2
    placed = materialise(with_position(df.select(key, value), key, "at"), "placed")
    size = placed.agg(F.max("at").alias("n"))
    spread = placed.withColumn("offset", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("to", F.col("at") - F.col("offset"))
    spread = spread.join(F.broadcast(size), how="cross").where((F.col("to") >= 1) & (F.col("to") <= F.col("n")))
    ends = {"before": F.least(F.lit(half).cast("long"), F.col("to") - 1), "after": F.least(F.lit(half).cast("long"), F.col("n") - F.col("to"))}
    weights = df.sparkSession.createDataFrame(stencil(window, order), "before long, after long, offset int, weight double")
    # A row per end and offset, window^3 / 4 at most.
    sums = spread.withColumns(ends).join(F.broadcast(weights), ["before", "after", "offset"]).groupBy("to").agg(F.sum(F.col(value) * F.col("weight")).alias("smooth"))
    return placed.select(key, F.col("at").alias("to")).join(sums, "to").select(key, "smooth")
