"""Splits, folds and shuffles from digests of ids: the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def unit_hash(key: Column, seed: int) -> Column:
    """A number from 0 to below 1."""
    return F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("long") / 4294967296.0


def stratified(df: DataFrame, key: str, label: str, shares: dict[str, float], seed: int) -> DataFrame:
    """``part``: of each label, in digest order, the shares named, and 'train' for the rest."""
    w = Window.partitionBy(label)
    ranked = df.withColumns({"_k": F.row_number().over(w.orderBy(digest(F.col(key), seed), key)), "_n": F.count("*").over(w)})
    part, upto = F.when(F.lit(False), ""), 0.0
    for name, share in shares.items():
        upto += share
        part = part.when(F.col("_k") <= F.floor(F.lit(upto) * F.col("_n")), name)
    return ranked.withColumn("part", part.otherwise("train")).drop("_k", "_n")
