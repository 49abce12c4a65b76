"""Negative binomial parameters by likelihood, all genes in each step."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.special import real_digamma, real_trigamma
from heddle.workspace import materialise


def likeliest_dispersion(values: DataFrame, stats: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """gene_id, r, p of the likeliest negative binomial of each gene; null without overdispersion.

    ``values``: gene_id, value of the entries above 0. ``stats``: gene_id, n (entries with zeros), mean,
    var_pop. At a given r the likeliest p is r / (r + mean), which leaves one equation in ln r. Newton
    steps from the moments solve it for all genes at once; each is a pass over a table of (gene, value,
    number), which has a row for each different value of a gene. Zeros add nothing to the sums.
    """
    table = materialise(values.groupBy("gene_id", "value").agg(F.count("*").alias("times")), "times")
    start = stats.where((F.col("var_pop") > F.col("mean")) & (F.col("mean") > 0))
    state = materialise(start.select("gene_id", "n", "mean", (F.col("mean") * F.col("mean") / (F.col("var_pop") - F.col("mean"))).alias("r"), F.lit(1.0).alias("step")), "start")
    for k in itertools.count():
        left = state.where(F.abs("step") >= tolerance)
        met = table.join(left.select("gene_id", "r"), "gene_id")
        one = F.col("times") * (real_digamma(F.col("value") + F.col("r")) - real_digamma(F.col("r")))
        two = F.col("times") * (real_trigamma(F.col("value") + F.col("r")) - real_trigamma(F.col("r")))
        sums = met.groupBy("gene_id").agg(F.sum(one).alias("one"), F.sum(two).alias("two"))
        r, n, mean = F.col("r"), F.col("n"), F.col("mean")
        slope = F.col("one") + n * F.log(r / (r + mean))
        bend = F.col("two") + n * mean / (r * (r + mean))
        up, down = r * slope, r * slope + r * r * bend
        # Where the likelihood isn't concave in ln r, a step of one towards more of it.
        newton = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.when(down < 0, -up / down).otherwise(F.signum(up))))
        moved = state.join(sums, "gene_id", "left").withColumn("step", F.coalesce(newton, F.lit(0.0)))
        state = materialise(moved.select("gene_id", "n", "mean", (r * F.exp("step")).alias("r"), "step"), f"step_{k}")
        if state.where(F.abs("step") >= tolerance).isEmpty():
            break
    return stats.select("gene_id").join(state, "gene_id", "left").select("gene_id", "r", (F.col("r") / (F.col("r") + F.col("mean"))).alias("p"))
