"""Mutual information of real features and classes by nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.special import digamma
from heddle.operators.matrix import one_row
from heddle.operators.order import running_sum, with_position
from heddle.workspace import materialise


def neighbour_information(rows: DataFrame, k: int = 3) -> DataFrame:
    """feature, mi of rows (id, feature, class, value): digamma of all rows plus its mean over
    neighbours asked, less its means over the sizes of classes and over rows within reach; 0 at least.

    A row's reach is the distance to its k-th nearest row of its class in its feature (of small
    classes the last); classes of one row take no part. Rows within reach are nearer than it, or
    equal where it is 0. Values are taken in single precision, so that distances are exact. All features share each step: rows are ordered by (feature, class, value)
    and meet the k places to either side; reaches are counted from running sums over one order of
    values and ends. Orders go by ranges, so a feature is never one task's work.
    """
    sized = rows.groupBy("feature", "class").agg(F.count("*").alias("size")).where("size > 1")
    kept = rows.join(sized, ["feature", "class"]).select("id", "feature", "class", F.col("value").cast("float").cast("double").alias("value"), "size")
    placed = materialise(with_position(kept.withColumn("_key", F.struct("feature", "class", "value", "id")), "_key", "pos").drop("_key"), "placed")
    near = placed.select("feature", "class", F.col("value").alias("other"), F.explode(F.array(*[F.col("pos") + o for o in range(-k, k + 1) if o])).alias("pos"))
    met = placed.join(near.withColumnsRenamed({"feature": "_f", "class": "_c"}), "pos").where("feature = _f AND class = _c")
    asked = F.least(F.lit(k), F.col("size") - 1).cast("int")
    far = met.groupBy("id", "feature", "class", "size", "value").agg(F.array_sort(F.collect_list(F.abs(F.col("value") - F.col("other")))).alias("far"))
    reach = materialise(far.select("id", "feature", "value", "size", asked.alias("k"), F.element_at("far", asked).alias("reach")), "reach")

    # In one order of values: ends that count lesser values, the values, ends that count equal ones too.
    before, after = F.lit(0), F.lit(2)
    some = F.col("reach") > 0
    high = F.struct(F.when(some, F.col("value") + F.col("reach")).otherwise(F.col("value")).alias("at"), F.when(some, before).otherwise(after).alias("side"), F.lit(0).alias("one"), F.lit(1).alias("sign"))
    low = F.struct(F.when(some, F.col("value") - F.col("reach")).otherwise(F.col("value")).alias("at"), F.when(some, after).otherwise(before).alias("side"), F.lit(0).alias("one"), F.lit(-1).alias("sign"))
    point = F.struct(F.col("value").alias("at"), F.lit(1).alias("side"), F.lit(1).alias("one"), F.lit(0).alias("sign"))
    events = reach.select("id", "feature", F.inline(F.array(high, low, point)))
    counted = running_sum(events.withColumn("_key", F.struct("feature", "at", "side", "id", "sign")), "_key", "one", "c")
    within = counted.where("sign <> 0").groupBy("id", "feature").agg(F.sum(F.col("c") * F.col("sign")).alias("m"))
    both = reach.join(within, ["id", "feature"])
    means = both.groupBy("feature").agg(F.count("*").alias("n"), F.avg(digamma(F.col("k"))).alias("a"), F.avg(digamma(F.col("size"))).alias("b"), F.avg(digamma(F.col("m"))).alias("c"))
    found = means.select("feature", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("a") - F.col("b") - F.col("c")).alias("mi"))
    # Features without classes of two rows tell nothing.
    return rows.select("feature").distinct().join(found, "feature", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi"))


def most_informative(scores: DataFrame, share: float = 0.2) -> DataFrame:
    """``scores`` (feature, mi) with ``selected``: the best share of features. One row a feature."""
    from pyspark.sql import Window

    ranked = scores.withColumn("_r", F.row_number().over(Window.orderBy(F.round("mi", 8).desc(), "feature")))
    return one_row(ranked, scores.agg(F.count("*").alias("_p"))).select("feature", "mi", (F.col("_r") <= F.round(share * F.col("_p"))).alias("selected"))
