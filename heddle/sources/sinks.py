"""Sinks, and the bundle of tables that make up a cell data set."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.sources.partitioned import located
from heddle.workspace import ship_package


@dataclass
class CellDataset:
    """counts (cell_id, gene_id, value), obs (cells), var (genes), obsm (embeddings), uns (scalars)."""

    counts: DataFrame
    obs: DataFrame
    var: DataFrame
    obsm: DataFrame | None = None
    uns: dict[str, str] = field(default_factory=dict)

    SLOTS = ("counts", "obs", "var", "obsm")

    def write(self, path: str) -> None:
        for slot in self.SLOTS:
            if (df := getattr(self, slot)) is not None:
                df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{slot}")
        self.counts.sparkSession.createDataFrame(sorted(self.uns.items()), "key string, value string").write.mode("overwrite").parquet(f"{path}/uns")

    @classmethod
    def read(cls, spark: SparkSession, path: str, slots: tuple[str, ...] = ("counts", "obs", "var")) -> CellDataset:
        got = {s: spark.read.parquet(f"{path}/{s}") for s in slots}
        return cls(**got, uns={r["key"]: r["value"] for r in spark.read.parquet(f"{path}/uns").collect()})


def append_table(df: DataFrame, path: str, types: dict[str, str]) -> None:
    """Append with explicit types instead of a round trip through text."""
    df.selectExpr(*[f"try_cast({c} AS {t}) AS {c}" for c, t in types.items()]).write.mode("append").parquet(path)


def write_text(df: DataFrame, path: str, kind: str, **options) -> None:
    """csv, json or text; gzip unless told otherwise."""
    getattr(df.write.mode("overwrite").options(**{"compression": "gzip", **options}), kind)(path)


@contextmanager
def part_file(path: str, ending: str):
    """An open file that gets its name, by partition, once it is whole; attempts don't meet."""
    system, folder = located(path)
    system.create_dir(folder)
    task = TaskContext.get()
    name = f"{folder}/part-{task.partitionId():05}{ending}"
    half = f"{name}.{task.taskAttemptId()}"
    with system.open_output_stream(half) as out:
        yield out
    system.move(half, name)


def write_numpy(rows: DataFrame, path: str) -> None:
    """``rows`` (id, vector) as a folder of NPY files, one a partition: ids, then components, as float64.

    Files are named by partition, so a task that runs again writes the same one. All vectors of a partition
    are of one length, and a partition fits in a task's memory. Empty partitions have no file.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [np.column_stack([f["id"].to_numpy(float), np.array(f["vector"].tolist(), float)]) for f in frames if len(f)]
        if parts:
            with part_file(path, ".npy") as out:
                np.lib.format.write_array(out, np.concatenate(parts))
            yield pd.DataFrame({"n": [sum(map(len, parts))]})

    ship_package(rows.sparkSession)
    rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(write, "n long").agg(F.sum("n")).collect()


def write_archives(text: DataFrame, path: str) -> None:
    """Lines (column ``line``) as a folder of tar archives, one a partition, with a gzip member a batch."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        with part_file(path, ".tar") as out, tarfile.open(fileobj=out, mode="w|") as archive:
            for i, frame in enumerate(frames):
                data = gzip.compress("".join(f"{line}\n" for line in frame["line"]).encode(), mtime=0)
                member = tarfile.TarInfo(f"part-{part:05}-{i:05}.tsv.gz")
                member.size = len(data)
                archive.addfile(member, io.BytesIO(data))
        yield pd.DataFrame({"n": [1]})

    ship_package(text.sparkSession)
    text.select("line").mapInPandas(write, "n long").agg(F.sum("n")).collect()
