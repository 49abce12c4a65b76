"""Canonical frames from the star-schema tables, as DataFrames and as the same in SQL.

``counts``: an order is a cell, a bucket of parts a gene, a quantity a count. ``expr`` is the same
by customer, which is denser. Zero entries are absent from both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.workspace import table

GENES = 200


def counts(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    """With ``parts``, dealt to so many tasks by cell before anything is summed."""
    gene = (F.col("l_partkey") % GENES).alias("gene_id")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return (lines if parts is None else lines.repartition(parts, "l_orderkey")).groupBy(F.col("l_orderkey").alias("cell_id"), gene).agg(F.sum("l_quantity").alias("value"))


def expr(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    gene = (F.col("l_partkey") % GENES).alias("gene_id")
    return joined.groupBy(F.col("o_custkey").alias("sample_id"), gene).agg(F.sum("l_quantity").alias("value"))


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """cell_id, y, batch."""
    y = (F.col("o_orderstatus") == "F").cast("int").alias("y")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), y, F.col("o_orderpriority").alias("batch"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """sample_id, y of the samples of ``expr``: customers, cases by market segment."""
    y = F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("y")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), y)


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, y, score, yhat: labels with a made-up score."""
    score = (F.col("doc_id") * 37 % 101) / 100.0
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"), score.alias("score"), (score >= 0.5).cast("int").alias("yhat"))


def multi(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, y, yhat in five classes: the segments of customers, and a guess from the nation."""
    classes = F.array(*map(F.lit, SEGMENTS))
    guess = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(classes[(F.col("c_nationkey") % 5).cast("int")])
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("y"), guess.alias("yhat"))


def intervals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Motifs (from parts) and peaks (from suppliers): chrom, start, end, name."""
    a = table(spark, sf, "part").select(
        F.concat(F.lit("chr"), (F.col("p_partkey") % 24 + 1).cast("string")).alias("chrom"),
        (F.col("p_partkey") * 97 % 100000).alias("start"), (F.col("p_partkey") * 97 % 100000 + F.col("p_size")).alias("end"), F.col("p_partkey").alias("motif_id"),
        F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"),
    )
    b = table(spark, sf, "supplier").select(
        F.concat(F.lit("chr"), (F.col("s_suppkey") % 24 + 1).cast("string")).alias("chrom"),
        (F.col("s_suppkey") * 997 % 100000).alias("start"), (F.col("s_suppkey") * 997 % 100000 + 500).alias("end"), F.col("s_suppkey").alias("peak_id"),
    )
    return a, b


def asr(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn, intent, asr."""
    suffix = F.element_at(F.array(*map(F.lit, ("yes", "no", "open", "fallback"))), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.lit(" - "), suffix).alias("intent"), F.col("text").alias("asr"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

CTE = {
    "counts": f"counts AS (SELECT l_orderkey AS cell_id, l_partkey % {GENES} AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)",
    "expr": f"""expr AS (SELECT o_custkey AS sample_id, l_partkey % {GENES} AS gene_id, sum(l_quantity) AS value
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
    "obs": "obs AS (SELECT o_orderkey AS cell_id, (o_orderstatus = 'F')::INT AS y, o_orderpriority AS batch FROM orders)",
    "samples": "samples AS (SELECT c_custkey AS sample_id, (c_mktsegment IN ('BUILDING', 'MACHINERY'))::INT AS y FROM customer)",
    "preds": "preds AS (SELECT doc_id, quality AS y, (doc_id * 37 % 101) / 100.0::DOUBLE AS score, ((doc_id * 37 % 101) / 100.0::DOUBLE >= 0.5)::INT AS yhat FROM labels)",
    "multi": f"""multi AS (SELECT c_custkey AS row_id, c_mktsegment AS y,
      CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE {list(SEGMENTS)!r}[c_nationkey % 5 + 1] END AS yhat FROM customer)""",
    "motifs": """motifs AS (SELECT 'chr' || (p_partkey % 24 + 1) AS chrom, p_partkey * 97 % 100000 AS start, p_partkey * 97 % 100000 + p_size AS "end",
      p_partkey AS motif_id, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)""",
    "peaks": """peaks AS (SELECT 'chr' || (s_suppkey % 24 + 1) AS chrom, s_suppkey * 997 % 100000 AS start, s_suppkey * 997 % 100000 + 500 AS "end",
      s_suppkey AS peak_id FROM supplier)""",
    "asr": "asr AS (SELECT conv_id, turn, role || ' - ' || ['yes', 'no', 'open', 'fallback'][turn % 4 + 1] AS intent, text AS asr FROM conversations)",
}


def sql(body: str, *names: str) -> str:
    """``body`` after WITH and the named frames; a body that begins with WITH goes on from them."""
    body = body.strip()
    head = "WITH " + ", ".join(CTE[n] for n in names)
    if not names:
        return body
    return f"{head}, {body[5:]}" if body.upper().startswith("WITH ") else f"{head} {body}"
