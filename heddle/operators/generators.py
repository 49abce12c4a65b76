"""Synthetic data with known mechanisms, drawn from digests of indices: the same on any cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from heddle.workspace import ship_package


def _ids(spark: SparkSession, rows: int | DataFrame) -> DataFrame:
    """``id`` of each row to draw: a table's own, or so many numbers. Ids are few bytes and draws long, so
    they are dealt to all cores, however few files or row groups they come from."""
    if isinstance(rows, int):
        return spark.range(rows)
    return rows.select("id").repartition(4 * spark.sparkContext.defaultParallelism, "id")


def mechanisms(spark: SparkSession, samples: int | DataFrame, genes: int, spec: list[dict], seed: int = 42, dropout: float = 0.3) -> DataFrame:
    """sample_id, y, active array<int>, values array<double>: counts of ``genes`` genes a sample.

    Base counts are negative binomial (5, 5/7). Each mechanism {type, drivers, redundant, effects}
    is active with 0.7 (disease; the sample is then a case) or 0.4 (common); an effect e above 0
    makes x (1 + e) + Poisson(|e|), else x max(0.1, 1 + e); redundant genes take e times a number
    from 0.5 to 0.8. Dropout, gamma noise, rounding half to even, and a floor of 0 follow.
    """
    ship_package(spark)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i in f["id"]:
                rng = np.random.default_rng([seed, int(i)])
                x, y, active = rng.negative_binomial(5, 5 / 7, genes).astype(float), 0, []
                for m in spec:
                    on = rng.random() < (0.7 if m["type"] == "disease" else 0.4)
                    active.append(int(on))
                    if not on:
                        continue
                    y = 1 if m["type"] == "disease" else y
                    for g, e in zip(m["drivers"], m["effects"], strict=True):
                        x[g] = x[g] * (1 + e) + rng.poisson(abs(e)) if e > 0 else x[g] * max(0.1, 1 + e)
                    for k, g in enumerate(m["redundant"]):
                        e = m["effects"][k % len(m["effects"])] * rng.uniform(0.5, 0.8)
                        x[g] = x[g] * (1 + e) + rng.poisson(abs(e)) if e > 0 else x[g] * max(0.1, 1 + e)
                x[rng.random(genes) < dropout] = 0
                out.append((int(i), y, active, np.maximum(0, np.round(x + rng.gamma(1, 0.5, genes))).tolist()))
            yield pd.DataFrame(out, columns=["sample_id", "y", "active", "values"])

    return _ids(spark, samples).mapInPandas(draw, "sample_id long, y int, active array<int>, values array<double>")


def redundant_families(spark: SparkSession, samples: int | DataFrame, noise: int = 10, seed: int = 42) -> DataFrame:
    """Six negative binomial families, genes that follow from them, uniform noise, and a label: 1 with
    0.95 if the third is above 25 and the fifth above 30, else with 0.05."""
    ship_package(spark)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i in f["id"]:
                rng = np.random.default_rng([seed, int(i), 2])
                g = rng.negative_binomial(10, 0.3, 6).astype(float)
                p = 0.95 if g[2] > 25 and g[4] > 30 else 0.05
                rows.append((int(i), int(rng.random() < p), [*g.tolist(), 7 * g[0] + g[1], *rng.uniform(0, 50, noise).tolist()]))
            yield pd.DataFrame(rows, columns=["sample_id", "y", "values"])

    return _ids(spark, samples).mapInPandas(draw, "sample_id long, y int, values array<double>")


def classification_set(spark: SparkSession, rows: int | DataFrame = 1200, features: int = 200, classes: int = 3, informative: float = 0.75, seed: int = 42) -> DataFrame:
    """Gaussian classes around random corners; features beyond the informative ones are noise."""
    ship_package(spark)
    corners = np.random.default_rng(seed).choice([-1.0, 1.0], (classes, int(features * informative)))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i in f["id"]:
                rng = np.random.default_rng([seed, int(i), 3])
                y = int(i) % classes
                x = rng.normal(size=features)
                x[: corners.shape[1]] += corners[y]
                out.append((int(i), y, x.tolist()))
            yield pd.DataFrame(out, columns=["row_id", "y", "values"])

    return _ids(spark, rows).mapInPandas(draw, "row_id long, y int, values array<double>")
