"""Token-ID output: documents as lists of ids in Parquet, in global order, read back selectively.

File format: one row per document in ascending ``doc_id`` order (files by name, rows within);
``tokens`` is a list<int32> column in dictionary encoding (a vocabulary of 49k ids takes 16 bits
an id), ``doc_id``, ``n_tokens`` and ``part_start`` are delta-encoded, row groups and pages are of
controlled size, and page indexes let readers skip pages by ``doc_id``. Counts and offsets can be
read without touching ids. ``part_start`` counts ids from the start of the file; the offset of a
file is the sum over the files before it, a table with one row per file.

The encoder works on chunks between spaces or newlines. That is exact where the tokenizer drops
white space before merging, which is checked when it is loaded; other tokenizers get whole texts.

Rows are dealt by ranges of (doc_id, hash of the text), so that many texts of one ``doc_id``, or
without any, go to several tasks.

Defined cases. A null or empty text has the end id alone. A null ``doc_id`` comes first. Repeated
ids are ordered by the hash of their text, then by text; wholly equal rows have equal ids whichever
comes first. A very long text is encoded alone, whole, even if it has no space at all; one of 2^31
tokens raises. An empty table gives an empty table. Columns other than ``doc_id`` and ``text``
aren't written, so their names can't clash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.chunk_ids import IdTable, byte_level, chunk_ids, id_bytes, runs
from heddle.workspace import scratch_path, ship_package

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
#: A letter of the blocks Latin to Latin Extended-B but U+0130, and a punctuation mark of ASCII.
LETTER_MARK = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([!-/:-@\[-`{-~])"
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Texts -> ids, each chunk encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunked = drops_space(spec) and all(a["content"].startswith("<|") for a in spec.get("added_tokens", []))
        self.table = IdTable(self._chunk_ids)

    def _ids(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Ids of texts end to end, and how many each has, by the whole tokenizer."""
        ids, sizes = [], []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids += e.ids
            sizes.append(len(e.ids))
        return ids, sizes

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Most chunks are letters. Such a chunk is one pre-token, and below U+0250, in composed form,
        it normalises to its lower case, letters too but for U+0130; so the model alone is asked.
        Others go through all steps."""
        own = np.array([c.isalpha() and "\u0130" not in c and (c.isascii() or (max(c) < "\u0250" and is_normalized("NFC", c))) for c in chunks], bool)
        words, odd = [c for c, o in zip(chunks, own, strict=True) if o], [c for c, o in zip(chunks, own, strict=True) if not o]
        merge, ids, lengths = self.tokenizer.model.tokenize, [], []
        for w in words:
            pieces = merge(byte_level(w.lower()))
            ids += [t.id for t in pieces]
            lengths.append(len(pieces))
        other_ids, other_lengths = self._ids(odd)
        sizes = np.zeros(len(chunks), "int64")
        sizes[own], sizes[~own] = lengths, other_lengths
        out, mine = np.empty(int(sizes.sum()), "<i4"), np.repeat(own, sizes)
        out[mine], out[~mine] = ids, other_ids
        return out, sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts."""
        if self.chunked:
            return chunk_ids(pc.split_pattern(pc.replace_substring(self._eased(texts), "\n", " "), " "), self.table)
        ids, sizes = self._ids(texts.to_pylist())
        return np.array(ids, "<i4"), np.concatenate([[0], np.cumsum(sizes)]).astype("int64")

    @staticmethod
    def _eased(texts: pa.Array) -> pa.Array:
        """Texts of the same ids with fewer different chunks: A-Z lower-cased, and a space between a
        Latin letter and punctuation of ASCII, which never share a pre-token. Letters are those that
        normalise to letters. Texts that may hold special strings stay as they are."""
        special = pc.match_substring(texts, "<|")
        return pc.if_else(special, texts, pc.replace_substring_regex(pc.ascii_lower(texts), LETTER_MARK, r"\1 \2"))


def drops_space(spec: dict) -> bool:
    """Whether no token and no normalisation step can reach across a space or newline."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    splits = [p for p in parts if p["type"] == "Split"]
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    harmless = all(
        s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        for s in steps
    )
    # A split that removes all but its matches, none of which may hold white space.
    kept = splits and splits[0].get("invert") and splits[0]["behavior"] == "Removed"
    pattern = splits[0]["pattern"].get("Regex", "") if splits else ""
    plain = pattern == "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    added = all(
        not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) and not set(" \n") & set(a["content"])
        for a in spec.get("added_tokens", [])
    )
    return bool(harmless and kept and plain and added)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs`` and write the files under ``path``."""
    ship_package(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, encode_texts = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            at = 0
            for run in runs(batch.column("text")):
                ids, offsets = encode_texts(run)
                # An end id goes behind the ids of each text.
                offsets = offsets + np.arange(len(offsets))
                if offsets[-1] >= 2**31:
                    raise ValueError("a text may have 2^31 - 2 tokens at most")
                closed = np.full(offsets[-1], end_id, "<i4")
                inner = np.ones(offsets[-1], bool)
                inner[offsets[1:] - 1] = False
                closed[inner] = ids
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(run)),
                        pa.array(np.full(len(run), part, "int32")),
                        pa.array(start + offsets[:-1]),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(closed)),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "tokens"],
                )
                start += int(offsets[-1])
                at += len(run)

    # Bounds of ranges are sampled to the driver: ids and hashes are, texts aren't.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_hash"), "text")
    ordered = keyed.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.options(**FILE_OPTIONS).parquet(path)


def with_start(rows: DataFrame, path: str) -> DataFrame:
    """``part`` and ``part_start`` replaced by ``start``, the ids in all documents before."""
    files = rows.sparkSession.read.schema(SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # One row per file, so a single task may order them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    others = [c for c in rows.columns if c not in ("doc_id", "part", "part_start")]
    # One row per file: rows meet their offset where they are, whatever else they carry.
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("part_start") + F.col("_offset")).alias("start"), *others)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, tokens."""
    return with_start(spark.read.schema(SCHEMA).parquet(path), path)


def with_crc32(tokens: DataFrame, column: str = "ids_crc32") -> DataFrame:
    """``tokens`` with the ids replaced by the unsigned crc32 of their bytes."""
    ship_package(tokens.sparkSession)
    kept = [c for c in tokens.columns if c != "tokens"]
    schema = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in kept) + f", `{column}` long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(b) for b in id_bytes(batch.column("tokens"))], "int64")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], crc], names=[*kept, column])

    return tokens.mapInArrow(digest, schema)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return with_start(with_crc32(spark.read.schema(SCHEMA).parquet(path)), path)
