"""Batches merged by mutual neighbours: pairs of rows that are each other's neighbours across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.graph import nearest
from heddle.operators.neighbours import nearest_by_index
from heddle.workspace import materialise


def mutual_pairs(rows: DataFrame, k: int = 20) -> DataFrame:
    """src, dst, src_batch, dst_batch: of rows (id, vector, batch), pairs across batches (the lesser batch
    first) of which each is among the other's k nearest in its batch."""
    near = nearest(rows, k, "euclidean", batch="batch", across=True).select("src", "dst", F.col("batch").alias("dst_batch"))
    own = rows.select(F.col("id").cast("long").alias("src"), F.col("batch").cast("string").alias("src_batch"))
    across = materialise(near.join(own, "src"), "across")
    back = across.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return across.where("src_batch < dst_batch").join(back, ["src", "dst"]).select("src", "dst", "src_batch", "dst_batch")


def merge_order(counts: dict[tuple[str, str], int], batches: list[str]) -> list[str]:
    """Batches in the order in which they are merged: the pair that shares most comes first, then always
    the one that shares most with those before it; ties, and batches that share nothing, by name."""
    shared = lambda a, b: counts.get((min(a, b), max(a, b)), 0)
    left = sorted(batches)
    if len(left) < 2:
        return left
    first = min(((a, b) for a in left for b in left if a < b), key=lambda p: (-shared(*p), p))
    order = list(first)
    left = [b for b in left if b not in order]
    while left:
        order.append(min(left, key=lambda b: (-sum(shared(b, o) for o in order), b)))
        left.remove(order[-1])
    return order


def shifts(merged: DataFrame, added: DataFrame, d: int, k: int, anchors: int) -> DataFrame:
    """id, shift of each row of ``added``: the kernel-weighted mean of the shifts of its nearest anchors.

    An anchor is a row of ``added`` with mutual neighbours in ``merged``, its shift the mean way to
    them. The kernel is a normal one, as wide as the row's anchors are far.
    """
    both = merged.select("id", "vector", F.lit("a").alias("batch")).union(added.select("id", "vector", F.lit("b").alias("batch")))
    pairs = mutual_pairs(both, k).select(F.col("src").alias("there"), F.col("dst").alias("here"))
    there = merged.select(F.col("id").alias("there"), F.col("vector").alias("_t"))
    here = added.select(F.col("id").alias("here"), F.col("vector").alias("_h"))
    way = pairs.join(there, "there").join(here, "here")
    mean = [F.avg(F.col("_t")[j] - F.col("_h")[j]).alias(f"m{j}") for j in range(d)]
    anchor = way.groupBy("here").agg(F.first("_h").alias("vector"), *mean)
    # Their own ids, so that a row may be its own anchor.
    anchor = materialise(anchor.select((-F.col("here") - 1).alias("id"), "vector", F.array(*[f"m{j}" for j in range(d)]).alias("way")), "anchors")
    if anchor.isEmpty():
        return added.select("id", F.transform("vector", lambda _: F.lit(0.0)).alias("shift"))
    near = nearest_by_index(anchor.select("id", "vector"), anchors, "euclidean", queries=added.select("id", "vector"))
    near = materialise(near.select("src", "dst", "score"), "near_anchors")
    wide = near.groupBy("src").agg(F.avg(F.col("score") * F.col("score")).alias("wide"))
    weight = F.exp(-F.col("score") * F.col("score") / (2 * F.col("wide") + 1e-12))
    met = near.join(wide, "src").withColumn("w", weight).join(anchor.select(F.col("id").alias("dst"), "way"), "dst")
    sums = met.groupBy("src").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col("way")[j]).alias(f"s{j}") for j in range(d)])
    return sums.select(F.col("src").alias("id"), F.array(*[F.col(f"s{j}") / F.col("w") for j in range(d)]).alias("shift"))


def merge_batches(rows: DataFrame, k: int = 20, anchors: int = 20) -> DataFrame:
    """id, vector, batch: rows (id, vector, batch) with the vectors of all batches but the first in the
    order of merging moved onto those merged before them. Batches are few; each is one step."""
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("batch").cast("string").alias("batch"))
    rows = materialise(rows, "rows")
    head = rows.first()
    if head is None:
        return rows
    # One row a batch, and one a pair of batches.
    counts = {(r["src_batch"], r["dst_batch"]): r["count"] for r in mutual_pairs(rows, k).groupBy("src_batch", "dst_batch").count().collect()}
    order = merge_order(counts, [r["batch"] for r in rows.select("batch").distinct().collect()])
    merged = rows.where(F.col("batch") == order[0])
    for batch in order[1:]:
        added = rows.where(F.col("batch") == batch)
        moved = added.join(shifts(merged, added, len(head["vector"]), k, anchors), "id", "left")
        shifted = F.when(F.col("shift").isNull(), F.col("vector")).otherwise(F.zip_with("vector", "shift", lambda x, s: x + s))
        merged = materialise(merged.union(moved.select("id", shifted.alias("vector"), "batch")), "merged")
    return merged
