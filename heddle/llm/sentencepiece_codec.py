"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed and rebuilt (``piece_model``): normaliser, marker for spaces, scores as
merges or unigram scores, byte fallback. Texts are encoded in multithreaded batches. Parity with
the sentencepiece library is verified on every chunk a worker meets for the first time, and on one
in a hundred whole texts; for models whose chunks can't be compared, on all whole texts.

The supplied model is of the BPE kind, so its scores order merges; models of the unigram kind
are rebuilt with their scores as they are.

Defined cases. Null and empty texts have no ids and decode to the empty text. Null ids and
repeated rows pass through, row by row; an empty table gives an empty table. A very long text is
encoded alone, whole, even if it has no space at all. Models with pieces defined by the user, and of
types other than BPE and unigram, raise. Columns other than ``doc_id`` and ``text`` aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.chunk_ids import groups, id_bytes, list_array, text_list
from heddle.llm.piece_model import Codec
from heddle.workspace import ship_package

_CODECS: dict[tuple[str, bool], Codec] = {}


def codec(path: str, verify: bool) -> Codec:
    if (path, verify) not in _CODECS:
        _CODECS[path, verify] = Codec(path, verify)
    return _CODECS[path, verify]


def encode(docs: DataFrame, model: str, verify: bool = True) -> DataFrame:
    """doc_id, n_tokens long, tokens array<int>."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, verify)
        for batch in batches:
            at = 0
            for run in groups(text_list(batch.column("text"))):
                rows = own.encode(run)
                sizes = pa.array([len(r) // 4 for r in rows], "int64")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(run)), sizes, list_array(rows)], names=["doc_id", "n_tokens", "tokens"]
                )
                at += len(run)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, n_tokens long, tokens array<int>")


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, tokens."""
    ship_package(tokens.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, False)
        for batch in batches:
            ids = [np.frombuffer(b, "<u4").tolist() for b in id_bytes(batch.column("tokens"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.decode(ids), "string")], names=["doc_id", "text"])

    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"))
    return rows.mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, verify: bool = True, keep_tokens: bool = False) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_crc32, decoded_sha256, same_text, and
    with ``keep_tokens`` tokens array<int>.

    ``same_text`` compares the decoded text with the normalised one.
    """
    ship_package(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, same_text boolean" + (", tokens array<int>" if keep_tokens else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, verify)
        for batch in batches:
            at = 0
            for run in groups(text_list(batch.column("text"))):
                normal = [own.normalise(t) for t in run]
                rows = own.encode(run, normal)
                back = own.decode([np.frombuffer(r, "<u4").tolist() for r in rows])
                columns = [
                    batch.column("doc_id").slice(at, len(run)),
                    pa.array([len(r) // 4 for r in rows], "int64"),
                    pa.array([zlib.crc32(r) for r in rows], "int64"),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], "string"),
                    pa.array([n == b for n, b in zip(normal, back, strict=True)], "bool"),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([list_array(rows)] if keep_tokens else []), names=names)
                at += len(run)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
