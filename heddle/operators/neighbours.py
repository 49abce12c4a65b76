"""Nearest neighbours by an index of cells: each row meets the rows of a few cells, not all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.graph import _nth
from heddle.workspace import materialise, ship_package

#: Rows of a cell, of a task's block of a cell, and of the sample that the cells' centres come from.
ROWS_PER_CELL, BLOCK, SAMPLE = 2_048, 4_096, 4_096


def _vectors(column, unit: bool) -> np.ndarray:
    x = np.array(column.to_pylist(), dtype="float64")
    if unit and len(x):
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return x


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T)


def _centres(base: np.ndarray, cells: int, steps: int = 5) -> np.ndarray:
    """Centres of the sample, moved to the means of what is nearest to them."""
    centres = base[:cells].copy()
    for _ in range(steps):
        own = _far(base, centres).argmin(1)
        many = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, base)
        centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
    return centres


def nearest_by_index(
    rows: DataFrame, k: int, metric: str = "cosine", queries: DataFrame | None = None, probes: int = 8, per_cell: int = ROWS_PER_CELL, block: int = BLOCK, sample: int = SAMPLE, seed: int = 42
) -> DataFrame:
    """src, dst, score, rank of the k nearest other rows (id, vector) of each query, by default of each row.

    Rows are dealt to cells by their nearest centre, one cell for each ``per_cell`` rows and at most
    ``sample`` cells (beyond ``sample`` * ``per_cell`` rows cells grow; raise ``sample``); centres come from the ``sample`` rows of the least hashes, and every row is in a
    cell. A query is ranked exactly against the rows of its ``probes`` nearest cells, so with one cell,
    or ``probes`` of them, the result is exact. Ties go by dst.

    Of equal vectors only the k + 1 least ids can be among the k nearest of anything, so only those
    are searched, and equal queries are asked once: a vector that a third of all rows have costs no
    more than another. Large cells are cut into blocks of rows and of queries.
    """
    ship_package(rows.sparkSession)
    unit = metric == "cosine"

    def keyed(df: DataFrame) -> DataFrame:
        vector = F.col("vector").cast("array<double>")
        return df.select(F.col("id").cast("long").alias("id"), vector.alias("vector")).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})

    least = Window.partitionBy("h1", "h2").orderBy("id")
    kept = materialise(keyed(rows).withColumn("_nth", F.row_number().over(least)).where(F.col("_nth") <= k + 1).drop("_nth"), "kept")
    cells = min(sample, max(1, kept.count() // per_cell))
    base = kept.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("vector").toArrow()
    if not base.num_rows:
        return rows.sparkSession.createDataFrame([], "src long, dst long, score double, rank int")
    centres = _centres(_vectors(base.column("vector"), unit), cells)

    def celled(df: DataFrame, many: int) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    far = _far(_vectors(batch.column("vector"), unit), centres)
                    order = np.argsort(far, axis=1, kind="stable")[:, :many]
                    yield batch.append_column("cells", pa.array(order.tolist(), pa.list_(pa.int32())))

        return df.mapInArrow(work, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), "cells array<int>"]))

    asking = keyed(rows if queries is None else queries)
    asked = celled(asking.groupBy("h1", "h2").agg(F.first("vector").alias("vector")), probes)
    asked = materialise(asked.select("h1", "h2", "vector", F.explode("cells").alias("cell")), "asked")
    stored = materialise(celled(kept.select("id", "vector"), 1).select("id", "vector", F.col("cells")[0].alias("cell")), "stored")
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    # A row per cell: ``sample`` at most.
    sizes = F.broadcast(materialise(blocks(stored, "blocks").join(blocks(asked, "turns"), "cell"), "sizes"))
    count = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = lambda name, *by: F.pmod(F.xxhash64(*by), F.col(name)).cast("int")
    left = asked.join(sizes, "cell").select("cell", count("blocks").alias("a"), own("turns", "h1", "h2").alias("b"), "h1", "h2", "vector")
    right = stored.join(sizes, "cell").select("cell", own("blocks", "id").alias("a"), count("turns").alias("b"), F.col("id").alias("h1"), F.lit(None).cast("long").alias("h2"), "vector")

    def best(table: pa.Table) -> pa.Table:
        side = np.array(table.column("h2").is_valid())
        h1, h2, x = table.column("h1").to_numpy(), table.column("h2").fill_null(0).to_numpy(), _vectors(table.column("vector"), unit)
        ids = h1[~side]
        asking, base, out = x[side], x[~side], []
        for s in range(0, len(asking), 256):
            far = -(asking[s : s + 256] @ base.T) if unit else _far(asking[s : s + 256], base)
            i, j = np.divmod(np.arange(far.size), max(1, far.shape[1]))
            if far.shape[1] > k + 1:
                # What is farther than the last one that stays, ties of nine decimals aside, needs no order.
                last = np.partition(far, k, axis=1)[:, k : k + 1]
                i, j = np.divmod(np.flatnonzero(~(far > (last + 2e-9 if unit else (np.sqrt(last) + 2e-9) ** 2 * (1 + 1e-12)))), far.shape[1])
            score = -far[i, j] if unit else np.sqrt(far[i, j])
            best = np.lexsort((ids[j], np.round(-score if unit else score, 9), i))
            best = best[_nth(i[best]) < k + 1]
            out.append((i[best] + s, j[best], score[best]))
        i, j, score = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"h1": h1[side][i], "h2": h2[side][i], "dst": ids[j], "score": score})

    found = left.union(right).groupBy("cell", "a", "b").applyInArrow(best, "h1 long, h2 long, dst long, score double")
    cost = F.round("score", 9)
    order = [F.desc(cost) if unit else cost, "dst"]
    top = lambda df, by, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
    found = materialise(top(found, ["h1", "h2"], k + 1).drop("rank"), "found")
    back = asking.select(F.col("id").alias("src"), "h1", "h2").join(found, ["h1", "h2"]).where("src <> dst")
    return top(back.select("src", "dst", "score"), ["src"], k)
