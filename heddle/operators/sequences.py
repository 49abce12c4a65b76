"""Seeded draws on sequences, and batch calls of a pluggable model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.workspace import ship_package


def _seed(key: str) -> Column:
    """A number of the key; null keys share one."""
    return F.pmod(F.xxhash64(key), F.lit(2**62))


def _draws(df: DataFrame, key: str, length: Column, draw: Callable[[int, int], list[int]]) -> DataFrame:
    """``df`` with ``_length`` and ``_drawn``: what ``draw`` makes of the key's seed and the length. Python
    gets these two numbers, not the rows' texts."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<int>")
    def drawn(seeds: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([draw(int(own), int(n)) for own, n in zip(seeds, lengths, strict=True)], dtype=object)

    counted = df.withColumn("_length", F.coalesce(length, F.lit(0)))
    return counted.withColumn("_drawn", drawn(_seed(key), F.col("_length")))


def shuffled_chunks(df: DataFrame, key: str, column: str, chunks: int, moved: int, seed: int = 42) -> DataFrame:
    """``column`` cut into chunks of a k-th of its length (a rest makes one more); ``moved`` of them,
    drawn by the row's key, change places among themselves. Null texts stay null."""

    def order(own: int, n: int) -> list[int]:
        parts = list(range(-(-n // max(1, n // chunks))))
        rng = np.random.default_rng([seed, own])
        at = rng.choice(len(parts), min(moved, len(parts)), replace=False)
        for to, part in zip(at, [parts[i] for i in rng.permutation(at)], strict=True):
            parts[to] = part
        return parts

    made = _draws(df.select(key, column), key, F.char_length(column), order)
    size = F.greatest(F.lit(1), F.floor(F.col("_length") / chunks)).cast("int")
    text = F.array_join(F.transform("_drawn", lambda p: F.substring(F.col(column), p * size + 1, size)), "")
    return made.select(key, F.when(F.col(column).isNotNull(), text).alias(column))


def random_windows(df: DataFrame, key: str, column: str, longest: int = 510, shortest: int = 20, seed: int = 42) -> DataFrame:
    """key, start, window of a token array: half of the windows have ``longest`` tokens, the others a
    random number; the rest of ``longest`` or fewer is the last. Null and empty arrays have none."""

    def starts(own: int, many: int) -> list[int]:
        rng, at, found = np.random.default_rng([seed, own, 1]), 0, []
        while at < many:
            found.append(at)
            at += longest if many - at <= longest or rng.random() < 0.5 else int(rng.integers(shortest, longest + 1))
        return found

    made = _draws(df.select(key, column), key, F.when(F.col(column).isNotNull(), F.size(column)), starts)
    end = lambda i: F.coalesce(F.get("_drawn", i + 1), F.col("_length"))
    window = lambda at, i: F.struct(at.cast("long").alias("start"), F.slice(column, at + 1, end(i) - at).alias("window"))
    return made.select(key, F.explode(F.transform("_drawn", window)).alias("w")).select(key, "w.start", "w.window")


def predict(df: DataFrame, key: str, column: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """key, answer, seconds: a model called once per batch, with its share of the batch's time."""
    ship_package(df.sparkSession)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            began = time.perf_counter()
            answers = model(f[column].fillna("").tolist())
            yield pd.DataFrame({key: f[key], "answer": answers, "seconds": (time.perf_counter() - began) / max(1, len(f))})

    return df.select(key, column).mapInPandas(work, f"{key} {df.schema[key].dataType.simpleString()}, answer string, seconds double")


def hashed_embedding(texts: list[str], size: int = 16) -> list[list[float]]:
    """A stand-in for a remote embedding: counts of words by hash, of unit length."""
    import zlib

    out = []
    for t in texts:
        v = np.zeros(size)
        for w in t.split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1 if h & 0x10000 else -1
        out.append((v / max(1e-9, np.linalg.norm(v))).tolist())
    return out


def embed(df: DataFrame, key: str, column: str, model: Callable[[list[str]], list[list[float]]] = hashed_embedding) -> DataFrame:
    ship_package(df.sparkSession)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "vector": model(f[column].fillna("").tolist())})

    return df.select(key, column).mapInPandas(work, f"{key} {df.schema[key].dataType.simpleString()}, vector array<double>")


#: Strategies by name: selection modes, classifiers, tokenisers.
STRATEGIES: dict[str, Callable] = {}


def strategy(name: str):
    def add(f: Callable) -> Callable:
        STRATEGIES[name] = f
        return f

    return add


def dispatch(name: str, *args, **kwargs):
    """The strategy whose name is in ``name``; the longest such name, else 'default'."""
    found = [k for k in STRATEGIES if k != "default" and k in name]
    return STRATEGIES[max(found, key=len) if found else "default"](*args, **kwargs)


@strategy("default")
def _words(text: str) -> list[str]:
    return text.split()


@strategy("mer")
def _six(text: str) -> list[str]:
    return [text[i : i + 6] for i in range(max(0, len(text) - 5))]
