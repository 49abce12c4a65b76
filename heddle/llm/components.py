"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.workspace import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link every node's neighbours to the least id around it.

    Large stars move neighbours above the node; small stars move the node and those below.
    Both keep components and end in one star per component. A node's least neighbour is a partial
    aggregate and the links are then joined with it, so no neighbourhood meets in one task.
    """
    both = links.union(links.select("v", "u")) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, u: str, v: str, name: str = "links", most: int = 60) -> DataFrame:
    """(node, root): every linked node with the least id of its component.

    ``links`` are pairs of non-null longs. Each pair of steps is written to the shared folder, so
    lineage stays short and a lost executor costs one step. Steps grow with the logarithm of the
    longest chain. Raises after ``most`` rounds rather than give a result that isn't final.
    """
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    edges = materialise(edges, f"{name}_0")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before = mark(edges)
    for k in range(1, most + 1):
        edges = materialise(_star(_star(edges, large=True), large=False), f"{name}_{k}")
        after = mark(edges)
        if after == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    raise RuntimeError(f"no fixed point after {most} rounds")
