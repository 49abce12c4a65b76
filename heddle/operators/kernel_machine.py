"""A classifier of many classes with a radial kernel: landmarks, one map of all rows, shared passes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.ml import mapped, summed
from heddle.workspace import materialise

#: Rows that the kernel's map is fitted on; every row is mapped.
LANDMARKS = 256


def kernel_map(rows: DataFrame, landmarks: int = LANDMARKS, gamma: float | None = None, seed: int = 42) -> Callable[[np.ndarray], np.ndarray] | None:
    """The map (Nystroem's) of vectors to features whose products are the kernel exp(-gamma d^2), exactly for
    the ``landmarks`` rows of the least hashes and nearly for others. ``gamma`` is by default one over the
    number of components times their variance. None without rows."""
    base = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(landmarks).select("vector").toPandas()
    if base.empty:
        return None
    points = np.array(base["vector"].tolist(), float)
    if gamma is None:
        n, total, squares = summed(rows, lambda x, _: np.array([x.size, x.sum(), (x**2).sum()]))
        gamma = 1.0 / (points.shape[1] * max(squares / n - (total / n) ** 2, 1e-12))
    kernel = lambda x: np.exp(-gamma * np.maximum(0, (x**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * x @ points.T))
    values, axes = np.linalg.eigh(kernel(points))
    use = values > 1e-10 * values.max()
    turn = axes[:, use] / np.sqrt(values[use])
    return lambda x: kernel(x) @ turn


def kernel_classifier(train: DataFrame, rows: DataFrame, cost: float = 1.0, landmarks: int = LANDMARKS, gamma: float | None = None, tolerance: float = 1e-5) -> DataFrame:
    """id, prediction, scores of ``rows`` (id, vector), learned from ``train`` (id, vector, label int).

    One machine a class against the rest, by squared hinge loss; all classes share each pass over the
    mapped rows, which sums up one gradient, features x classes. A step solves the loss's upper bound by
    a fixed square matrix, with momentum that starts anew where it overshoots, until the gradients are
    small. Scores are in the order of labels; ties go to the lesser. A prediction is null without
    labelled rows.
    """
    train = materialise(train.where("label IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("int").alias("label")), "train")
    # One row a class.
    classes = np.array(sorted(r["label"] for r in train.select("label").distinct().collect()))
    lift = kernel_map(train, landmarks, gamma)
    if lift is None:
        return rows.select("id", F.lit(None).cast("int").alias("prediction"), F.array().cast("array<double>").alias("scores"))
    ones = lambda x: np.hstack([lift(x), np.ones((len(x), 1))])
    table = materialise(mapped(train, lambda x, _: ones(x), "vector").join(train.select("id", "label"), "id"), "mapped")
    gram = summed(table, lambda x, _: x.T @ x)
    m = int(round(len(gram) ** 0.5))
    bound = np.linalg.inv(np.eye(m) + 2 * cost * gram.reshape(m, m))

    def gradient(w: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray, frame: pd.DataFrame) -> np.ndarray:
            y = np.where(frame["label"].to_numpy()[:, None] == classes[None], 1.0, -1.0)
            return -2 * cost * x.T @ (y * np.maximum(0, 1 - y * (x @ w)))

        return w + summed(table, work).reshape(m, len(classes))

    w = ahead = np.zeros((m, len(classes)))
    pace, first = 1.0, None
    while True:
        slope = gradient(ahead)
        size = np.abs(slope).max()
        first = first or size
        new = ahead - bound @ slope
        if size <= tolerance * max(first, 1e-12):
            break
        # Against the way just gone: momentum starts anew.
        if (slope * (new - w)).sum() > 0:
            pace = 1.0
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = new + (pace - 1) / faster * (new - w)
        w, pace = new, faster
    scored = materialise(mapped(rows.select("id", F.col("vector").cast("array<double>").alias("vector")), lambda x, _: ones(x) @ new, "scores"), "scored")
    at = F.array_position("scores", F.array_max("scores")).cast("int")
    return scored.select("id", F.element_at(F.array(*[F.lit(int(c)) for c in classes]), at).alias("prediction"), "scores")
