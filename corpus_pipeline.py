"""The corpus pipeline: five stages, each one operator applied to what the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame with the columns of ``documents``, the
last one token ids and what decoding them gives back. ``run`` writes each stage's result to the
shared folder and reads it back.

Defined cases, by stage. Null and empty texts, and those of fewer than 20 words, fail the quality
rules, so later stages have texts with words. A null ``doc_id`` is a document that is smaller than
all others: it loses shared lines and never names a class unless the class has no other. Rows that
repeat an id and a text are one class, of which near dedup keeps one row. A null lang or source is a
group and a source of its own. Very long texts stay whole up to the mix, which may take part of
them. An empty table gives an empty table at each stage. Columns beyond those of ``documents`` are
left out, so their names can't clash. The mix may take a document up to three times, a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import line_dedup, mixing, near_dedup, quality, sentencepiece_codec
from heddle.workspace import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that others hold; ``n_chars`` follows the text."""
    cut = line_dedup.line_dedup(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.near_dedup(docs.select(*COLUMNS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents, or parts of them, as often as their source's target takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, same_text, tokens of each row of the mix: its ids,
    and whether they decode to its text."""
    import public_tokenizers

    return sentencepiece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_tokens=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("sentencepiece", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Shingle signatures and token ids are beyond SQL; a test holds ``run`` against brute force.
ORACLE_SQL = None
