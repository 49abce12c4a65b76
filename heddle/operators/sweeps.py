"""Clusterings for many numbers of clusters at once: all of them share each pass over the rows.

A pass adds up a small array per model (counts, sums, second moments of its clusters), and only
that comes to the driver: its size is that of the models, whatever the number of rows. Starts are
drawn from a sample of at most ``sample`` rows, those of the least hashes; every row is in every
pass. A model that has settled drops out of the passes that follow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.ml import summed

KINDS = ("full", "tied", "diag", "spherical")


def _sample(rows: DataFrame, sample: int, seed: int) -> np.ndarray:
    picked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("vector").toPandas()
    return np.array(picked["vector"].tolist(), float)


def _starts(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of the sample, each drawn by its squared distance to those before it."""
    rng = np.random.default_rng([seed, k])
    at = [int(rng.integers(len(x)))]
    far = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < k and far.sum() > 0:
        at.append(int(rng.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None])


def _split(total: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(total, np.cumsum(sizes)[:-1])


def kmeans_sweep(rows: DataFrame, ks: range, steps: int = 100, sample: int = 4_096, seed: int = 42) -> list[tuple[int, float, float]]:
    """(k, inertia per row, silhouette by squared distances) of each k, for rows (id, vector).

    Fewer different rows in the sample than k give as many clusters as there are. No rows, no result.
    """
    rows = rows.select("id", "vector")
    base = _sample(rows, sample, seed)
    if not len(base):
        return []
    d, centres = base.shape[1], {k: _starts(base, k, seed) for k in ks}
    settled: dict[int, np.ndarray] = {}
    for step in range(steps + 1):
        live = [k for k in ks if k not in settled]
        if not live:
            break
        now = {k: centres[k] for k in live}

        def moments(x: np.ndarray, _: pd.DataFrame, now: dict = now) -> np.ndarray:
            out, norm = [], (x**2).sum(1)
            for c in now.values():
                far = _far(x, c)
                own = far.argmin(1)
                to = np.zeros((len(x), len(c)))
                to[np.arange(len(x)), own] = 1
                out.append(np.column_stack([to.sum(0), to.T @ norm, to.T @ far.min(1), to.T @ x]).ravel())
            return np.concatenate(out)

        parts = _split(summed(rows, moments), [len(centres[k]) * (d + 3) for k in live])
        for k, part in zip(live, parts, strict=True):
            part = part.reshape(-1, d + 3)
            moved = np.where(part[:, :1] > 0, part[:, 3:] / np.maximum(part[:, :1], 1), centres[k])
            if step == steps or np.abs(moved - centres[k]).max() < 1e-6:
                settled[k] = part
            else:
                centres[k] = moved

    def widths(x: np.ndarray, _: pd.DataFrame) -> np.ndarray:
        """The sum of silhouettes: mean squared distances to clusters follow from their moments."""
        out, norm = np.zeros(len(settled)), (x**2).sum(1)
        for i, k in enumerate(ks):
            n, q, s = settled[k][:, 0], settled[k][:, 1], settled[k][:, 3:]
            many = np.maximum(n, 1)
            mean = np.maximum(0, norm[:, None] - 2 * x @ (s / many[:, None]).T + (q / many)[None])
            own = _far(x, centres[k]).argmin(1)
            at = np.arange(len(x))
            a = mean[at, own] * n[own] / np.maximum(n[own] - 1, 1)
            mean[:, n == 0] = np.inf
            mean[at, own] = np.inf
            b = mean.min(1)
            some = (n[own] > 1) & np.isfinite(b)
            out[i] = np.divide(b - a, np.maximum(a, b), out=np.zeros(len(x)), where=some & (np.maximum(a, b) > 0)).sum()
        return out

    score = summed(rows, widths)
    return [(k, float(settled[k][:, 2].sum() / settled[k][:, 0].sum()), float(s / settled[k][:, 0].sum())) for k, s in zip(ks, score, strict=True)]


def _log_density(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for j, (w, m, c) in enumerate(zip(weights, means, covs, strict=True)):
        root = np.linalg.cholesky(c)
        z = np.linalg.solve(root, (x - m).T)
        out[:, j] = np.log(w) - (z**2).sum(0) / 2 - np.log(np.diag(root)).sum() - x.shape[1] * np.log(2 * np.pi) / 2
    return out


def _refit(n: np.ndarray, s: np.ndarray, ss: np.ndarray, kind: str, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances of the kind from moments of weighted rows."""
    n, d = n + 1e-12, s.shape[1]
    means = s / n[:, None]
    covs = ss / n[:, None, None] - means[:, :, None] * means[:, None, :]
    if kind == "tied":
        covs = np.repeat((covs * n[:, None, None]).sum(0, keepdims=True) / n.sum(), len(n), 0)
    elif kind != "full":
        spread = np.maximum(np.diagonal(covs, axis1=1, axis2=2), 0)
        if kind == "spherical":
            spread = np.repeat(spread.mean(1, keepdims=True), d, 1)
        covs = spread[:, :, None] * np.eye(d)
    return n / n.sum(), means, (covs + covs.transpose(0, 2, 1)) / 2 + floor * np.eye(d)


def free_parameters(kind: str, k: int, d: int) -> int:
    shape = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[kind]
    return shape + k * d + k - 1


def mixture_sweep(rows: DataFrame, models: list[tuple[str, int]], steps: int = 100, tolerance: float = 1e-3, floor: float = 1e-6, sample: int = 4_096, seed: int = 42) -> list[tuple[str, int, float, float]]:
    """(covariance, k, AIC, BIC) of a Gaussian mixture for each (covariance, k), for rows (id, vector).

    Covariances are full, tied, diag or spherical, with ``floor`` on their diagonal. A model has
    settled once a pass adds less than ``tolerance`` to its mean log-likelihood, or after ``steps``.
    """
    rows = rows.select("id", "vector")
    base = _sample(rows, sample, seed)
    if not len(base):
        return []
    d, fits = base.shape[1], {}
    for kind, k in models:
        to = np.eye(k)[_far(base, _starts(base, k, seed)).argmin(1)]
        fits[kind, k] = _refit(to.sum(0), to.T @ base, np.einsum("nk,nd,ne->kde", to, base, base, optimize=True), kind, floor)
    last, settled, n = {m: -np.inf for m in models}, {}, 0.0
    for step in range(steps + 1):
        live = [m for m in models if m not in settled]
        if not live:
            break
        now = [fits[m] for m in live]

        def moments(x: np.ndarray, _: pd.DataFrame, now: list = now) -> np.ndarray:
            out, square = [np.array([len(x)])], (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            for weights, means, covs in now:
                p = _log_density(x, weights, means, covs)
                top = p.max(1, keepdims=True)
                every = top[:, 0] + np.log(np.exp(p - top).sum(1))
                r = np.exp(p - every[:, None])
                out += [np.array([every.sum()]), r.sum(0), (r.T @ x).ravel(), (r.T @ square).ravel()]
            return np.concatenate(out)

        total = summed(rows, moments)
        n = total[0]
        for m, part in zip(live, _split(total[1:], [1 + k * (1 + d + d * d) for _, k in live]), strict=True):
            kind, k = m
            mean = part[0] / n
            if step == steps or mean - last[m] < tolerance:
                settled[m] = part[0]
            else:
                last[m] = mean
                fits[m] = _refit(part[1 : 1 + k], part[1 + k : 1 + k + k * d].reshape(k, d), part[1 + k + k * d :].reshape(k, d, d), kind, floor)
    free = {m: free_parameters(*m, d) for m in models}
    return [(*m, float(2 * free[m] - 2 * settled[m]), float(free[m] * np.log(n) - 2 * settled[m])) for m in models]
