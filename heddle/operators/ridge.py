"""Kernel ridge of several features: conjugate gradients on kernels kept as products of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.graph import ROWS_PER_BLOCK
from heddle.workspace import materialise, ship_package

#: Points that the preconditioner sees all others through.
LANDMARKS = 256


def kernel_product(targets: DataFrame, sources: DataFrame, kernels: list[tuple[str, float]], size: int = ROWS_PER_BLOCK, counts: tuple[int, int] | None = None) -> DataFrame:
    """id, total of ``targets`` (id, vector): for each column c the sum over ``sources`` (id, vector, weight
    array) of kernel c of the pair times weight[c]. Kernels are ("linear", 0) or ("rbf", gamma).

    Blocks meet blocks: a row is copied once per block of the other side, and sends on one array a block.
    ``counts`` are the rows of both, where known.
    """
    ship_package(targets.sparkSession)
    a, b = [max(1, -(-n // size)) for n in counts or (targets.count(), sources.count())]
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = targets.select("id", "vector", F.array().cast("array<double>").alias("weight"), own(a).alias("a"), every(b).alias("b"), F.lit(0).alias("side"))
    right = sources.select("id", "vector", "weight", every(a).alias("a"), own(b).alias("b"), F.lit(1).alias("side"))
    kinds = sorted(set(kernels))
    columns = {k: [c for c, other in enumerate(kernels) if other == k] for k in kinds}

    def product(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        here, there = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        if not len(here) or not len(there):
            return pa.table({"id": pa.array([], "int64"), "total": pa.array([], pa.list_(pa.float64()))})
        x = np.array(table.column("vector").to_pylist(), float)
        w = np.array(table.column("weight").take(pa.array(there)).to_pylist(), float)
        dots = x[here] @ x[there].T
        gaps = np.maximum(0, (x[here] ** 2).sum(1)[:, None] + (x[there] ** 2).sum(1)[None] - 2 * dots)
        out = np.zeros((len(here), w.shape[1]))
        for kind, gamma in kinds:
            use = columns[kind, gamma]
            out[:, use] = (dots if kind == "linear" else np.exp(-gamma * gaps)) @ w[:, use]
        return pa.table({"id": table.column("id").take(pa.array(here)), "total": pa.array(list(out), pa.list_(pa.float64()))})

    parts = left.unionByName(right).groupBy("a", "b").applyInArrow(product, "id long, total array<double>")
    zero = F.array_repeat(F.lit(0.0), len(kernels))
    return parts.groupBy("id").agg(F.aggregate(F.collect_list("total"), zero, lambda s, x: F.zip_with(s, x, lambda i, j: i + j)).alias("total"))


def _columns(rows: DataFrame, f, names: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and arrays ``names``: what ``f`` makes of a frame's arrays, as matrices."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                got = f({c: np.array(frame[c].tolist(), float) for c in frame.columns if c != "id"})
                yield frame[keep].assign(**{n: list(x) for n, x in zip(names, got, strict=True)})

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(work, ", ".join([f"{c} {types[c]}" for c in keep] + [f"{n} array<double>" for n in names]))


def _sums(rows: DataFrame, f) -> np.ndarray:
    """Sum over all rows of an array made of a frame's arrays; it alone comes to the driver."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(f({c: np.array(frame[c].tolist(), float) for c in frame.columns if c != "id"}) for frame in frames if len(frame))
        if np.ndim(total):
            yield pd.DataFrame({"at": np.arange(total.size), "x": total.ravel()})

    found = rows.mapInPandas(work, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    return np.array([r["x"] for r in found])


def _kernel(x: np.ndarray, y: np.ndarray, kernel: tuple[str, float]) -> np.ndarray:
    dots = x @ y.T
    if kernel[0] == "linear":
        return dots
    return np.exp(-kernel[1] * np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * dots))


def solved(points: DataFrame, kernels: list[tuple[str, float]], alphas: np.ndarray, held: list[int | None], tolerance: float, size: int) -> DataFrame:
    """id, vector, n, s, q and weight array: for each column the dual weights of the fit with its kernel and
    alpha to all rows but those of the held fold.

    ``points``: distinct vectors with the numbers n, sums s and squares q of their rows by fold. Rows of one
    vector share a kernel row, so with d the root of their number the fit solves (d K d + alpha) u = d mean.
    All columns share each pass, which is one product and some sums of a few numbers a column. Gradients are
    preconditioned: kernels seen through ``LANDMARKS`` points, of which smooth ones lose little, are solved
    exactly, so passes are few however many rows a point has; what is lost only costs further passes.
    """
    folds = [f is not None for f in held]
    pick = np.array([f or 0 for f in held])

    def left_out(rows: dict, name: str) -> np.ndarray:
        return rows[name].sum(1)[:, None] - np.where(folds, rows[name][:, pick], 0.0)

    def begin(rows: dict) -> tuple:
        n = left_out(rows, "n")
        d = np.sqrt(n)
        b = np.divide(left_out(rows, "s"), d, out=np.zeros_like(d), where=n > 0)
        return d, np.zeros_like(b), b, np.zeros_like(b)

    marks = np.array([r["vector"] for r in points.orderBy(F.xxhash64("vector"), "vector").limit(LANDMARKS).select("vector").collect()], float)
    kinds = sorted(set(kernels))
    axes = {}
    for kind in kinds:
        power, turn = np.linalg.eigh(_kernel(marks, marks, kind))
        use = power > 1e-10 * power.max(initial=0)
        axes[kind] = turn[:, use] / np.sqrt(power[use])
    columns = {k: np.array([c for c, other in enumerate(kernels) if other == k]) for k in kinds}
    seen = {k: (lambda x, k=k: _kernel(x["vector"], marks, k) @ axes[k]) for k in kinds}
    outs = sorted({f for f in held if f is not None}) + [None]

    def grams(x: dict) -> np.ndarray:
        count = [x["n"].sum(1) - (0 if f is None else x["n"][:, f]) for f in outs]
        return np.concatenate([(v.T @ (c[:, None] * v)).ravel() for k in kinds for v in [seen[k](x)] for c in count])

    got, at, inverse = _sums(points, grams), 0, {}
    for k in kinds:
        m = axes[k].shape[1]
        for f in outs:
            power, turn = np.linalg.eigh(got[at : at + m * m].reshape(m, m))
            inverse[k, f] = (np.maximum(power, 0), turn)
            at += m * m

    def through(x: dict, r: np.ndarray) -> np.ndarray:
        """Of residuals, what the landmarks see, all kernels' columns side by side."""
        return np.concatenate([(seen[k](x).T @ (x["d"] * r)[:, columns[k]]).ravel() for k in kinds])

    def weighed(total: np.ndarray) -> dict:
        found, at = {}, 0
        for k in kinds:
            t = total[at : (at := at + axes[k].shape[1] * len(columns[k]))].reshape(-1, len(columns[k]))
            each = [(*inverse[k, held[c]], t[:, i], alphas[c]) for i, c in enumerate(columns[k])]
            found[k] = np.stack([turn @ ((turn.T @ v) / (power + alpha)) for power, turn, v, alpha in each], 1)
        return found

    def solution(x: dict, r: np.ndarray, found: dict) -> np.ndarray:
        z = np.empty_like(r)
        for k in kinds:
            use = columns[k]
            z[:, use] = (r[:, use] - x["d"][:, use] * (seen[k](x) @ found[k])) / alphas[use]
        return z

    table = ["d", "u", "r", "p"]
    kept = ["id", "vector", "n", "s", "q"]
    state = materialise(_columns(points, begin, table, kept), "state")
    n = points.count()
    first = np.maximum(_sums(state, lambda x: (x["r"] ** 2).sum(0)), 1e-300)
    found = weighed(_sums(state, lambda x: through(x, x["r"])))
    state = materialise(_columns(state, lambda x, found=found: (x["d"], x["u"], x["r"], solution(x, x["r"], found)), table, kept), "state")
    rz = _sums(state, lambda x: (x["r"] * x["p"]).sum(0))
    while True:
        weighted = _columns(state, lambda x: (x["d"] * x["p"],), ["weight"], ["id", "vector"])
        joined = state.join(kernel_product(points.select("id", "vector"), weighted, kernels, size, (n, n)), "id")
        with_product = materialise(_columns(joined, lambda x: (x["d"] * x["total"] + alphas * x["p"],), ["ap"], kept + table), "product")
        rr, pap = _sums(with_product, lambda x: np.stack([(x["r"] ** 2).sum(0), (x["p"] * x["ap"]).sum(0)])).reshape(2, -1)
        going = rr > tolerance**2 * first
        if not going.any():
            return _columns(state, lambda x: (x["d"] * x["u"],), ["weight"], kept)
        step = np.where(going & (pap > 0), rz / np.where(pap > 0, pap, 1.0), 0.0)
        after = lambda x, step=step: x["r"] - step * x["ap"]
        found = weighed(_sums(with_product, lambda x, after=after: through(x, after(x))))
        next_rz = _sums(with_product, lambda x, after=after, found=found: (after(x) * solution(x, after(x), found)).sum(0))
        turn = np.where(step > 0, next_rz / np.where(rz > 0, rz, 1.0), 0.0)

        def move(x: dict, step: np.ndarray = step, turn: np.ndarray = turn, found: dict = found, after=after) -> tuple:
            r = after(x)
            return x["d"], x["u"] + step * x["p"], r, np.where(step > 0, solution(x, r, found) + turn * x["p"], x["p"])

        state, rz = materialise(_columns(with_product, move, table, kept), "state"), np.where(step > 0, next_rz, rz)


def ridge_grid(df: DataFrame, features: list[str], y: str, key: str, alphas: list[float], gammas: list[float], folds: int = 10, tolerance: float = 1e-8, size: int = ROWS_PER_BLOCK) -> tuple[tuple[str, float, float, float] | None, DataFrame]:
    """The best (kernel, alpha, gamma, score) and key, predicted of the rows whose ``y`` is null.

    Kernels are the linear one and a radial one for each gamma, of features scaled by mean and deviation of
    the complete rows. Settings are compared by the mean over hash folds of the share of variance
    explained (folds without any are left out), ties by order. Complete rows are summed up by
    distinct features; all settings and folds share each pass. Rows with a null feature have no
    prediction; without complete rows nothing has, and there is no setting.
    """
    ship_package(df.sparkSession)
    whole = " AND ".join(f"`{f}` IS NOT NULL" for f in features)
    known = df.where(f"{whole} AND `{y}` IS NOT NULL")
    scale = known.agg(*[F.struct(F.avg(f), F.stddev_pop(f)).alias(f) for f in features]).first()
    none = df.sparkSession.createDataFrame([], df.select(key).schema).withColumn("predicted", F.lit(0.0))
    if scale[0][0] is None:
        return None, none
    vector = F.array(*[(F.col(f).cast("double") - F.lit(float(scale[f][0]))) / F.lit(float(scale[f][1]) or 1.0) for f in features])
    v = F.col(y).cast("double")
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    by_fold = lambda x: F.array(*[F.sum(F.when(F.col("fold") == f, x).otherwise(0.0)) for f in range(folds)])
    points = known.select(vector.alias("vector"), v.alias("v"), fold.alias("fold")).groupBy("vector").agg(by_fold(F.lit(1.0)).alias("n"), by_fold(F.col("v")).alias("s"), by_fold(F.col("v") ** 2).alias("q"))
    points = materialise(points.withColumn("id", F.monotonically_increasing_id()), "points")

    settings = [("linear", a, 0.0) for a in alphas] + [("rbf", a, g) for g in gammas for a in alphas]
    parts = [(s, f) for s in settings for f in [*range(folds), None]]
    kernels, shift = [(s[0], s[2]) for s, _ in parts], np.array([s[1] for s, _ in parts])
    fitted = materialise(solved(points, kernels, shift, [f for _, f in parts], tolerance, size), "fitted")
    pick = np.array([f or 0 for _, f in parts])
    found = fitted.join(kernel_product(points.select("id", "vector"), fitted.select("id", "vector", "weight"), kernels, size), "id")
    gone = lambda x: x["q"][:, pick] - 2 * x["total"] * x["s"][:, pick] + x["n"][:, pick] * x["total"] ** 2
    sums = _sums(found, lambda x: np.stack([gone(x).sum(0), x["n"][:, pick].sum(0), x["s"][:, pick].sum(0), x["q"][:, pick].sum(0)])).reshape(4, -1)
    scores = []
    for i in range(len(settings)):
        at = slice(i * (folds + 1), i * (folds + 1) + folds)
        lost, n, s, q = sums[:, at]
        spread = q - s**2 / np.maximum(n, 1)
        use = spread > 1e-12 * np.maximum(q, 1)
        scores.append(round(float(np.mean(1 - lost[use] / spread[use])), 9) if use.any() else 0.0)
    best = int(np.argmax(scores))
    column = best * (folds + 1) + folds
    new = df.where(f"{whole} AND `{y}` IS NULL").select(key, vector.alias("vector"))
    places = materialise(new.select("vector").distinct().withColumn("id", F.monotonically_increasing_id()), "places")
    weight = fitted.select("id", "vector", F.array(F.col("weight")[column]).alias("weight"))
    got = places.join(kernel_product(places, weight, [kernels[column]], size), "id").select("vector", F.col("total")[0].alias("predicted"))
    return (*settings[best], scores[best]), new.join(got, "vector").select(key, "predicted")
