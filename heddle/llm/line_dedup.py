"""Line dedup: drop lines that several documents share, but for one holder.

Method: explode normalised lines, hash them, count distinct documents per hash, drop the
lines over the threshold, and reassemble each document by line position.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; it is
carried as two independent 64-bit hashes. Lines whose key has fewer than ``min_chars`` code
points take no part. A key found in ``min_docs`` documents or more stays only in the rows of
the largest ``doc_id`` that holds it.

Defined cases. A null or empty text is one empty line and stays empty. A null ``doc_id`` counts
as one document that is smaller than all others. Rows that repeat a ``doc_id`` are one document
when documents are counted; each row is rewritten for itself, by its own text. An empty table
gives an empty table. Columns other than ``doc_id`` and ``text`` are carried through; result
columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.workspace import materialise

BLANKS = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Ends stripped, A-Z lower-cased and nothing else.

    ``lower`` folds ASCII texts by bytes; other texts need a fold that leaves É alone.
    """
    stripped = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line long enough to count: doc_id, row hashes, position, key hashes."""
    exploded = docs.select("doc_id", "_r1", "_r2", F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    keyed = exploded.where(F.char_length("_line") >= min_chars).withColumn("_key", line_key(F.col("_line")))
    return keyed.where(F.char_length("_key") >= min_chars).select(
        "doc_id", "_r1", "_r2", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")
    )


def _without(lines: Column, dropped: Column) -> Column:
    """The lines whose 0-based positions aren't in ``dropped`` (ascending), joined by newlines.

    Runs between dropped positions are sliced out, so the cost is lines plus drops.
    """
    ends = F.concat(dropped, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.array_join(F.flatten(runs), "\n")


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` rewritten, plus ``n_lines`` (before) and ``n_dropped``, both long."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    base = docs.select(
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("_"), *others).alias("_rest"),
    ).withColumns({"_r1": F.xxhash64("text"), "_r2": F.xxhash64(F.lit(1), "text")})

    shared = (
        _lines(base, min_chars)
        .groupBy("_h1", "_h2")
        .agg(
            (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("_docs"),
            F.max("doc_id").alias("_keeper"),
        )
        .where(F.col("_docs") >= min_docs)
        .select("_h1", "_h2", "_keeper")
    )
    # A table of its own, so that the join below may split the rows of a line that very many share.
    shared = materialise(shared, "shared_lines")
    drops = (
        _lines(base, min_chars)
        .join(shared, ["_h1", "_h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
        .groupBy("doc_id", "_r1", "_r2")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_dropped"))
        .withColumnsRenamed({"doc_id": "_id", "_r1": "_s1", "_r2": "_s2"})
    )
    # The hashes of the text, not doc_id alone, say which row a position belongs to.
    same = (F.col("_r1") == F.col("_s1")) & (F.col("_r2") == F.col("_s2")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    joined = base.join(drops, same, "left").withColumn("_lines", F.split("text", "\n"))
    kept = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(_without(F.col("_lines"), F.col("_dropped")))
    done = joined.select(
        "doc_id",
        kept.alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        "_rest",
    )
    carried = [F.col("_rest")[c].alias(c) for c in others if c not in ("n_lines", "n_dropped")]
    return done.select("doc_id", "text", *carried, "n_lines", "n_dropped")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\f\r'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS l FROM documents))),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.keeper AS dropped
  FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
