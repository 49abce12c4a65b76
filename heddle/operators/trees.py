"""Boosted trees of many classes: histograms of gradients are summed up, and splits chosen, in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.metrics import confusion, matthews
from heddle.workspace import materialise, ship_package

#: Rounds after which the margins of all rows are written anew; until then new trees are applied in the pass.
REWRITE = 8


@dataclass
class Tree:
    """Nodes in the order of a heap: the feature and bin of a split (left: bins up to it), -1 without one, and
    the value of a row that ends there."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.full(n, -1), np.zeros(n))

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row of ``bins`` ends."""
        at = np.zeros(len(bins), int)
        rows = np.arange(len(bins))
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            right = bins[rows, np.maximum(f, 0)] > self.bin[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class Boosted:
    """classes ascending, cut points of each feature, and rounds of one tree a class."""

    classes: list[int]
    edges: list[np.ndarray]
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, vectors: list) -> np.ndarray:
        """Number of cut points up to each component; those without a value are below all, missing ones too."""
        out = np.zeros((len(vectors), max(1, len(self.edges))), np.int16)
        x = np.full(out.shape, -np.inf)
        for i, v in enumerate(vectors):
            if v is not None:
                part = np.array([np.nan if c is None else c for c in v[: len(self.edges)]], float)
                x[i, : len(part)] = np.where(np.isnan(part), -np.inf, part)
        for f, cuts in enumerate(self.edges):
            out[:, f] = np.searchsorted(cuts, x[:, f], side="right")
        return out

    def margins(self, bins: np.ndarray, start: int = 0) -> np.ndarray:
        """Sums of the trees' values, rows x classes, from round ``start`` on."""
        out = np.zeros((len(bins), len(self.classes)))
        for trees in self.rounds[start:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.leaf(bins)]
        return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut_points(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each component, ``bins`` - 1 at most."""
    shares = [i / bins for i in range(1, bins)]
    spread = rows.select(F.posexplode(F.col("vector").cast("array<double>")).alias("feature", "x")).where("x IS NOT NULL AND NOT isnan(x)")
    found = spread.groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile_approx("x", shares, 10_000))).alias("cuts"))
    # A row a feature.
    got = {r["feature"]: np.array(r["cuts"], float) for r in found.collect()}
    return [got.get(f, np.zeros(0)) for f in range(max(got, default=-1) + 1)]


def best_splits(histograms: DataFrame, penalty: float, least: float) -> DataFrame:
    """class, node, feature, bin, gain, g, h, gl, hl: the split of most gain of each node, ties by feature
    and bin; ``g`` and ``h`` are the node's sums and ``gl`` and ``hl`` those of its left part. From sums by
    class, node, feature and bin."""
    key = ["class", "node", "feature"]
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    sums = histograms.groupBy(*key, "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    sums = sums.select(*key, "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(whole).alias("g"), F.sum("h").over(whole).alias("h"))
    score = lambda g, h: g * g / (h + penalty)
    gain = score(F.col("gl"), F.col("hl")) + score(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - score(F.col("g"), F.col("h"))
    # Sums in another order differ in their last digits, which mustn't choose.
    gain = F.when((F.col("hl") >= least) & (F.col("h") - F.col("hl") >= least), F.round(gain, 9)).otherwise(F.lit(0.0))
    order = F.struct(F.col("gain"), -F.col("feature"), -F.col("bin"))
    row = F.struct("feature", "bin", "gain", "g", "h", "gl", "hl")
    return sums.withColumn("gain", gain).groupBy("class", "node").agg(F.max_by(row, order).alias("s")).select("class", "node", "s.*")


def fit_boosted(train: DataFrame, rounds: int = 20, depth: int = 3, rate: float = 0.3, penalty: float = 1.0, least: float = 1.0, bins: int = 32) -> Boosted | None:
    """Trees on the softmax of many classes by gradients and curvatures p(1 - p), from rows (vector, label int).

    Each level of all classes' trees is one pass: partitions give sums by class, node, feature and bin, Spark
    adds them up and picks each node's split, and only the splits come to the driver. A node is split
    where that gains, each side keeping a curvature of ``least`` or more. A partition holds classes x nodes
    of a level x features x bins sums. Rows without a label are left out; a null vector or component, or one
    that is no number, is below all cut points. None without labelled rows.
    """
    rows = train.where("label IS NOT NULL").select(F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("int").alias("label"))
    rows = materialise(rows, "labelled")
    # A row a class.
    classes = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if not classes:
        return None
    model = Boosted(classes, cut_points(rows, bins))
    n_classes, n_features = len(classes), max(1, len(model.edges))
    ship_package(train.sparkSession)

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                place = np.searchsorted(classes, frame["label"].to_numpy())
                yield pd.DataFrame({"bins": list(model.bins(frame["vector"].tolist())), "place": place.astype(np.int32), "margins": [[0.0] * n_classes] * len(frame)})

    shape = "bins array<smallint>, place int, margins array<double>"
    table, written = materialise(rows.mapInPandas(binned, shape), "binned"), 0

    def moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                new = np.array(frame["margins"].tolist()) + model.margins(np.array(frame["bins"].tolist()), written)
                yield frame.assign(margins=list(new))

    def level_sums(trees: list[Tree], level: int) -> Callable:
        first, n_nodes = 2**level - 1, 2**level

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            size = (n_classes, n_nodes, n_features, bins)
            g, h = np.zeros(size), np.zeros(size)
            for frame in frames:
                if not len(frame):
                    continue
                b = np.array(frame["bins"].tolist(), int)
                p = softmax(np.array(frame["margins"].tolist()) + model.margins(b, written))
                y = frame["place"].to_numpy()
                for k, tree in enumerate(trees):
                    node = tree.leaf(b) - first
                    there = node >= 0
                    cell = ((node[there, None] * n_features + np.arange(n_features)) * bins + b[there]).ravel()
                    for total, x in ((g, p[:, k] - (y == k)), (h, p[:, k] * (1 - p[:, k]))):
                        total[k] += np.bincount(cell, np.repeat(x[there], n_features), total[k].size).reshape(size[1:])
            k, node, f, b = np.nonzero(h)
            yield pd.DataFrame({"class": k, "node": node + first, "feature": f, "bin": b, "g": g[k, node, f, b], "h": h[k, node, f, b]})

        return work

    for _ in range(rounds):
        trees = [Tree.empty(depth) for _ in classes]
        for level in range(depth):
            found = table.mapInPandas(level_sums(trees, level), "class int, node int, feature int, bin int, g double, h double")
            grown = False
            # A row a class and node.
            for s in best_splits(found, penalty, least).collect():
                tree, at = trees[s["class"]], s["node"]
                value = lambda g, h: -rate * g / (h + penalty)
                tree.value[at] = value(s["g"], s["h"])
                if s["gain"] > 0:
                    grown = True
                    tree.feature[at], tree.bin[at] = s["feature"], s["bin"]
                    tree.value[2 * at + 1] = value(s["gl"], s["hl"])
                    tree.value[2 * at + 2] = value(s["g"] - s["gl"], s["h"] - s["hl"])
            if not grown:
                break
        model.rounds.append(trees)
        if len(model.rounds) - written == REWRITE and len(model.rounds) < rounds:
            table, written = materialise(table.mapInPandas(moved, shape), "margins"), len(model.rounds)
    return model


def predict_boosted(model: Boosted | None, rows: DataFrame) -> DataFrame:
    """id, prediction, scores (a probability a class, ascending) of rows (id, vector); ties go to the lesser
    class. Null and empty without a model."""
    if model is None:
        return rows.select("id", F.lit(None).cast("int").alias("prediction"), F.array().cast("array<double>").alias("scores"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                p = softmax(model.margins(model.bins(frame["vector"].tolist())))
                yield pd.DataFrame({"id": frame["id"], "prediction": np.array(model.classes, np.int32)[p.argmax(1)], "scores": list(p)})

    ship_package(rows.sparkSession)
    return rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInPandas(work, "id long, prediction int, scores array<double>")


def chosen_on_mcc(models: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], train: DataFrame, validation: DataFrame, test: DataFrame) -> list[tuple[str, float, float, bool]]:
    """(name, MCC on validation rows, MCC on test rows, chosen) of each model, by name.

    ``models`` take training rows (id, vector, label) and rows to score, and give id and prediction. The
    chosen one has the largest MCC on the validation rows, ties by name; test rows decide nothing.
    """
    held = validation.select("id", "vector", "label", F.lit(False).alias("test")).unionByName(test.select("id", "vector", "label", F.lit(True).alias("test")))
    held = materialise(held, "held")
    scored = []
    for name in sorted(models):
        found = materialise(held.join(models[name](train, held.select("id", "vector")).select("id", "prediction"), "id"), "predicted")
        mcc = [matthews(confusion(found.where(F.col("test") == last), "label", "prediction")).first()["mcc"] or 0.0 for last in (False, True)]
        scored.append((name, round(mcc[0], 6), round(mcc[1], 6)))
    best = max(scored, key=lambda s: s[1])[0] if scored else None
    return [(*s, s[0] == best) for s in scored]
