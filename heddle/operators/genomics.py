"""Intervals, windows and token positions on sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1_000


def overlap_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, bin_size: int = BIN) -> DataFrame:
    """Left outer join of half-open intervals that overlap on one chromosome.

    Both sides are cut into bins; pairs meet in each bin they share and count in the first only, so
    the join is an equi-join and gives each pair once. An interval takes as many rows as bins.
    """
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / bin_size)))
    left = a.select(a_id, "chrom", F.col("start").alias("a_start"), F.col("end").alias("a_end"), bins().alias("bin"))
    right = b.select(b_id, F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), bins().alias("b_bin"))
    same = (F.col("chrom") == F.col("b_chrom")) & (F.col("bin") == F.col("b_bin"))
    hits = left.join(right, same).where("a_start < b_end AND b_start < a_end").where(F.col("bin") == F.floor(F.greatest("a_start", "b_start") / bin_size))
    return a.join(hits.select(a_id, b_id, "b_start", "b_end"), a_id, "left")


def covering_token(tokens: DataFrame, positions: DataFrame, bin_size: int = BIN) -> DataFrame:
    """doc, position, token_index: the token that covers each base position.

    ``tokens``: doc, index, start, length. The range join is made an equi-join by bins.
    """
    t = tokens.select("doc", F.col("index").alias("token_index"), "start", (F.col("start") + F.col("length")).alias("end"))
    t = t.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    p = positions.withColumn("bin", F.floor(F.col("position") / bin_size))
    return p.join(t, ["doc", "bin"]).where("position >= start AND position < end").select("doc", "position", "token_index")


def pair_marks(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """doc, index of each non-overlapping occurrence of the neighbours (a, b), left to right.

    Matches that follow one another form a run; the odd ones of a run are taken.
    """
    w = Window.partitionBy("doc").orderBy("index")
    hit = (F.col("token") == a) & (F.lead("token").over(w) == b)
    marked = tokens.withColumn("hit", F.coalesce(hit, F.lit(False))).where("hit")
    island = F.col("index") - F.row_number().over(w)
    runs = marked.withColumn("island", island)
    odd = F.row_number().over(Window.partitionBy("doc", "island").orderBy("index")) % 2 == 1
    return runs.withColumn("odd", odd).where("odd").select("doc", "index")


def gaps_between(marks: DataFrame) -> DataFrame:
    """doc, start, end of what lies between runs of marked positions; nothing before the first run
    or after the last."""
    w = Window.partitionBy("doc").orderBy("position")
    nxt = F.lead("position").over(w)
    return marks.withColumn("nxt", nxt).where("nxt > position + 1").select("doc", (F.col("position") + 1).alias("start"), F.col("nxt").alias("end"))


def extend_by_strand(start: Column, end: Column, strand: Column, upstream: int = 249, downstream: int = 50) -> tuple[Column, Column]:
    plus = strand == "+"
    return F.when(plus, start - upstream).otherwise(start - downstream), F.when(plus, end + downstream).otherwise(end + upstream)


def chromosome_code(c: Column) -> Column:
    bare = F.regexp_replace(c, "^chr", "")
    return F.when(bare == "X", "23").when(bare == "Y", "24").otherwise(bare)
