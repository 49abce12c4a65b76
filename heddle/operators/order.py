"""Global positions and running sums without putting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.workspace import materialise


def _parts(df: DataFrame, key: str) -> DataFrame:
    """Rows range-partitioned by ``key``, with the number of their part; parts are in order."""
    return materialise(df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "parts")


def running_sum(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``key`` (unique). One row per part is ordered
    in one task, never the rows."""
    rows = _parts(df, key)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(offsets, "_part").withColumn(name, F.col("_inner") + F.col("_offset")).drop("_part", "_inner", "_offset")


def with_position(df: DataFrame, key: str, name: str) -> DataFrame:
    """1-based position of each row by ``key`` (unique)."""
    made = running_sum(df.withColumn("_one", F.lit(1)), key, "_one", name)
    return made.withColumn(name, F.col(name) + 1).drop("_one")
