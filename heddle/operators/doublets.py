"""Doublets: cells that lie among simulated sums of two, by a threshold or by enriched communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.special import hypergeometric_tail
from heddle.operators.communities import communities, shared_neighbours
from heddle.operators.graph import nearest
from heddle.operators.matrix import one_row
from heddle.operators.ml import with_sums
from heddle.workspace import materialise


def valley(counts: list[int]) -> int | None:
    """The place of the least count between two humps, after smoothing by threes until there are two
    humps at most; None with one hump or none."""
    c = [float(x) for x in counts]
    for _ in range(len(c)):
        padded = [-1.0, *c, -1.0]
        humps = [i for i in range(len(c)) if padded[i] < c[i] >= padded[i + 2]]
        if len(humps) <= 2:
            break
        c = [sum(c[max(0, i - 1) : i + 2]) / len(c[max(0, i - 1) : i + 2]) for i in range(len(c))]
    if len(humps if c else []) != 2:
        return None
    return min(range(humps[0], humps[1] + 1), key=lambda i: c[i])


def doublet_calls(rows: DataFrame, k: int = 10) -> DataFrame:
    """id, score, doublet of counts (id, vector): the share of sums among the k nearest, above the valley
    of the sums' own scores; above a half where they have no valley."""
    cells, every, n = with_sums(rows)
    near = nearest(every, k, "euclidean")
    scores = materialise(near.groupBy("src").agg(F.sum((F.col("dst") > n).cast("int")).alias("sums"), F.count("*").alias("k")), "scores")
    # At most k + 1 numbers.
    found = {r["sums"]: r["count"] for r in scores.where(F.col("src") > n).groupBy("sums").count().collect()}
    at = valley([found.get(i, 0) for i in range(k + 1)])
    share = F.coalesce(F.col("sums") / F.col("k"), F.lit(0.0))
    placed = cells.join(scores.withColumnRenamed("src", "at"), "at", "left")
    return placed.select("id", share.alias("score"), (share > F.lit(0.5 if at is None else at / k)).alias("doublet"))


def enrichment(rows: DataFrame) -> DataFrame:
    """community, n, hits, p of rows (community, marked): the hypergeometric probability of so many
    marked rows or more in each community."""
    per = rows.groupBy("community").agg(F.count("*").alias("n"), F.sum(F.col("marked").cast("int")).alias("hits"))
    both = one_row(per, per.agg(F.sum("n").alias("_all"), F.sum("hits").alias("_marked")))
    return both.select("community", "n", "hits", hypergeometric_tail(F.col("hits"), F.col("n"), F.col("_marked"), F.col("_all")).alias("p"))


def enriched_doublets(rows: DataFrame, k: int = 10, p: float = 1e-3) -> DataFrame:
    """id, community, p, doublet of counts (id, vector): cells of communities of cells and sums that have
    more sums than chance gives, at ``p``."""
    cells, every, n = with_sums(rows)
    found = materialise(communities(shared_neighbours(nearest(every, k, "euclidean")).where("weight > 0")), "communities")
    tails = enrichment(found.select("community", (F.col("node") > n).alias("marked")))
    placed = cells.join(found.withColumnRenamed("node", "at"), "at", "left").join(tails, "community", "left")
    return placed.select("id", "community", "p", F.coalesce(F.col("p") < p, F.lit(False)).alias("doublet"))
