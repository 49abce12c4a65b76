"""A plane layout of all rows from their neighbour graph: fuzzy memberships, then descent by parts.

Rows are dealt to parts of near rows. The places of all rows are a table. In a round each part gets
its rows, their links with the places at the links' other ends, and a bounded sample of places of
all rows to keep away from; it takes some steps of descent on its own rows, and the places are
written and exchanged for the next round. Work is in proportion to links, and every row is moved
by its own links: none is placed by the help of others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.neighbours import _centres, _far, nearest_by_index
from heddle.operators.spectral import normalised_links, top_eigen
from heddle.workspace import materialise, ship_package

#: The curve 1 / (1 + a d^2b) of the plane.
A, B = 1.577, 0.895
#: Rows of a part at most about, places that all parts keep away from, rows that parts' centres come from.
PART, AWAY, SAMPLE = 4_096, 2_048, 4_096


def widths(near: DataFrame, k: int, steps: int = 20, most: float = 1000.0) -> DataFrame:
    """src, rho, sigma of neighbours (src, dst, score): the nearest distance, and the width found by
    ``steps`` bisections of [0, most] by which 2 to the sum of memberships is k."""
    per = near.groupBy("src").agg(F.collect_list("score").alias("d"), F.min("score").alias("rho"))
    over = per.select("src", "rho", F.transform("d", lambda x: F.greatest(F.lit(0.0), x - F.col("rho"))).alias("over"))

    def halved(s, _):
        middle = (s["low"] + s["high"]) / 2
        total = F.aggregate("over", F.lit(0.0), lambda a, x: a + F.exp(-x / F.greatest(middle, F.lit(1e-9))))
        wide = total > F.log2(F.lit(float(k)))
        return F.struct(F.when(wide, s["low"]).otherwise(middle).alias("low"), F.when(wide, middle).otherwise(s["high"]).alias("high"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("low"), F.lit(most).alias("high")), halved)
    return over.withColumn("ends", ends).select("src", "rho", ((F.col("ends.low") + F.col("ends.high")) / 2).alias("sigma"))


def memberships(near: DataFrame, k: int) -> DataFrame:
    """src, dst, p: (p + p') / 2 of the fuzzy memberships of neighbours, both ways."""
    wide = widths(near, k)
    own = near.join(wide, "src").select("src", "dst", F.exp(-F.greatest(F.lit(0.0), F.col("score") - F.col("rho")) / F.greatest("sigma", F.lit(1e-9))).alias("p"))
    both = own.union(own.select("dst", "src", "p"))
    return both.groupBy("src", "dst").agg((F.sum("p") / 2).alias("p"))


def _dealt(rows: DataFrame, part: int, sample: int, seed: int) -> DataFrame:
    """id, part: rows of near vectors together, large groups split by hash."""
    n = rows.count()
    base = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).toPandas()
    centres = _centres(np.array(base["vector"].tolist(), float), min(sample, max(1, n // part)))

    def cells(frames):
        for f in frames:
            if len(f):
                x = np.array(f["vector"].tolist(), float)
                cell = np.concatenate([_far(x[a : a + 1024], centres).argmin(1) for a in range(0, len(x), 1024)])
                yield pd.DataFrame({"id": f["id"], "cell": cell})

    celled = materialise(rows.select("id", "vector").mapInPandas(cells, "id long, cell int"), "cells")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / part).alias("blocks"))
    return celled.join(sizes, "cell").select("id", F.concat_ws(":", "cell", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("part"))


def _descend(places: np.ndarray, links: tuple, halo: np.ndarray, away: np.ndarray, rates: np.ndarray, draw: np.random.Generator, batch: int | None, mean: np.ndarray | None) -> np.ndarray:
    """Places after a step for each rate. ``links``: own row, other row (own rows, then halo), p."""
    src, dst, p = links
    n, y = len(places), places.copy()
    mass = np.maximum(np.bincount(src, p, n), 1e-9)
    for rate in rates:
        every = np.vstack([y, halo])
        diff = every[dst] - y[src]
        r = np.maximum((diff**2).sum(1), 1e-9)
        pull = p * 2 * A * B * r ** (B - 1) / (1 + A * r**B)
        move = np.stack([np.bincount(src, np.clip(pull * diff[:, c], -4, 4), n) for c in (0, 1)], 1) / mass[:, None]
        pool = np.vstack([y, away])
        for _ in range(5):
            diff = y - pool[draw.integers(0, len(pool), n)]
            r = (diff**2).sum(1)
            push = 2 * B / ((0.001 + r) * (1 + A * r**B))
            move += np.clip(push[:, None] * diff, -4, 4) / 5 * (r > 0)[:, None]
        if mean is not None:
            move += 0.1 * (mean - y)
        if batch and n > batch:
            still = np.ones(n, bool)
            still[draw.permutation(n)[: max(batch, n // 4)]] = False
            move[still] = 0
        y = y + rate * move
    return y


def _round(rates: np.ndarray, away: np.ndarray, batch: int | None, seed: list[int]):
    """The steps of one part: rows of kind 0 are its own, those of kind 1 links with the other end's place."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, links = pdf[pdf["kind"] == 0].sort_values("src"), pdf[pdf["kind"] == 1].sort_values(["src", "dst"])
        ids = mine["src"].to_numpy()
        y = mine[["x", "y"]].to_numpy(float)
        src, dst = np.searchsorted(ids, links["src"].to_numpy()), links["dst"].to_numpy().astype("int64")
        at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
        inside = ids[at] == dst
        far, first, back = np.unique(dst[~inside], return_index=True, return_inverse=True)
        at[~inside] = len(ids) + back
        halo = links[["x", "y"]].to_numpy(float)[~inside][first]
        mean = np.where(np.isnan(mine[["mx", "my"]].to_numpy(float)), y, mine[["mx", "my"]].to_numpy(float)) if "mx" in pdf else None
        draw = np.random.default_rng([*seed, int(ids[0]) & 0xFFFFFFFF])
        moved = _descend(y, (src, at, links["p"].to_numpy(float)), halo, away, rates, draw, batch, mean)
        return pd.DataFrame({"id": ids, "x": moved[:, 0], "y": moved[:, 1], "part": [pdf["part"].iloc[0]] * len(ids)})

    return work


def layout(rows: DataFrame, k: int = 15, rounds: int = 20, steps: int = 25, rate: float = 0.5, supervised: bool = False, spectral: bool = False, batch: int | None = None, seed: int = 42) -> DataFrame:
    """id, xy of all rows (id, vector, and label if supervised).

    ``rounds`` exchanges of places, ``steps`` steps of descent in each, at a rate that falls to 0. With
    ``supervised`` rows are drawn to the mean place of their label's rows. With ``spectral`` places start
    at the second and third eigenvectors of the graph, else at digests of ids. With ``batch`` a step
    moves a random batch of a part's rows.
    """
    ship_package(rows.sparkSession)
    spark = rows.sparkSession
    base = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *(["label"] if supervised else []))
    base = materialise(base, "rows")
    if base.isEmpty():
        return spark.createDataFrame([], "id long, xy array<double>")
    near = materialise(nearest_by_index(base.select("id", "vector"), k, "euclidean").select("src", "dst", "score"), "near")
    graph = materialise(memberships(near, k), "memberships")
    parts = materialise(_dealt(base.select("id", "vector"), PART, SAMPLE, seed), "parts")
    unit = lambda j: F.xxhash64("id", F.lit(seed), F.lit(j)) / float(2**63)
    start = base.select("id", (10 * unit(0)).alias("x"), (10 * unit(1)).alias("y"))
    if spectral:
        links, nodes = normalised_links(graph.select("src", "dst", F.col("p").alias("weight")))
        _, axes = top_eigen(links, nodes, 3, tolerance=1e-3)
        scale = axes.agg(*[F.max(F.abs(F.get("vector", F.lit(j)))).alias(f"m{j}") for j in (1, 2)]).first()
        axis = lambda j: F.coalesce(10 * F.get("vector", F.lit(j)) / F.lit(scale[f"m{j}"] or 1.0), F.lit(0.0)) + 0.01 * unit(j)
        start = base.select("id").join(axes, "id", "left").select("id", axis(1).alias("x"), axis(2).alias("y"))
    places = materialise(start.join(parts, "id").select("id", "x", "y", "part"), "places")
    labels = materialise(base.select("id", "label"), "labels") if supervised else None
    dealt = materialise(graph.join(parts.withColumnRenamed("id", "src"), "src").select("part", "src", "dst", "p"), "dealt")

    for r in range(rounds):
        rates = rate * (1 - (r * steps + np.arange(steps)) / (rounds * steps))
        away = places.orderBy(F.xxhash64("id", F.lit(seed + r))).limit(AWAY).select("x", "y").toPandas().to_numpy(float)
        own = places.select("part", F.lit(0).alias("kind"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("p"), "x", "y")
        if supervised:
            means = places.join(labels, "id").groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
            mine = labels.join(means, "label", "left").select(F.col("id").alias("src"), "mx", "my")
            own = own.join(mine, "src", "left")
        other = places.select(F.col("id").alias("dst"), "x", "y")
        met = dealt.join(other, "dst").select("part", F.lit(1).alias("kind"), "src", "dst", "p", "x", "y")
        both = own.unionByName(met, allowMissingColumns=True)

        places = materialise(both.groupBy("part").applyInPandas(_round(rates, away, batch, [seed, r]), places.schema), f"places_{r}")
    return places.select("id", F.array("x", "y").alias("xy"))


def trustworthiness(rows: DataFrame, placed: DataFrame, k: int = 10) -> float:
    """The share of true nearness among the k nearest in the plane, by ranks in the space of vectors.
    For small tables: ranks are exact."""
    x = rows.select("id", "vector").orderBy("id").toPandas()
    y = placed.orderBy("id").toPandas()
    v, w = np.array(x["vector"].tolist(), float), np.array(y["xy"].tolist(), float)
    n = len(v)
    far = lambda a: ((a[:, None] - a[None]) ** 2).sum(2) + np.diag(np.full(n, np.inf))
    rank = far(v).argsort(1, kind="stable").argsort(1) + 1
    near = far(w).argsort(1, kind="stable")[:, :k]
    worse = np.maximum(0, np.take_along_axis(rank, near, 1) - k).sum()
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * worse
