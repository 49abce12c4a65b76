"""Token counts by the whole-token shortcut.

Offline, on the driver, every string of the vocabulary that is one pre-token and that the library
encodes alone as one token is listed. In texts, pre-tokens on that list count 1 without merging;
the rest are merged by the library, once each per worker and memo.

A pre-token's merges don't depend on what stands around it, so counts add up. Special strings
inside a text are cut out first and count 1 each, as the library does by default.

Defined cases. Null and empty texts have 0 tokens and 0 bytes. Null ids and repeated rows pass
through; an empty table gives an empty table. Columns other than ``doc_id`` and ``text`` are
ignored, so their names can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.chunk_ids import Memo, byte_alphabet, byte_level, groups, text_list
from heddle.workspace import ship_package

#: The published pattern of byte-level pre-tokens (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_COUNTERS: dict[str, Counter] = {}


def load(path: str):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("the shortcut is proved for byte-level pre-tokens without a normaliser only")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [a["content"] for a in spec.get("added_tokens", [])]


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token, in order."""
    import regex

    tokenizer, special = load(path)
    table, split = byte_alphabet(), regex.compile(PATTERN)
    found = []
    for piece in tokenizer.get_vocab():
        if piece in special or not all(c in table for c in piece):
            continue
        try:
            text = bytes(table[c] for c in piece).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if split.findall(text) == [text]:
            found.append(text)
    encoded = tokenizer.encode_batch(found, add_special_tokens=False)
    return sorted(t for t, e in zip(found, encoded, strict=True) if len(e.ids) == 1)


class Counter:
    """Texts -> numbers of tokens."""

    def __init__(self, path: str, whole: list[str]):
        import regex

        self.tokenizer, special = load(path)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo = Memo(self._merge, dict.fromkeys(whole, 1))

    def _merge(self, chunks: list[str]) -> list[int]:
        """Pre-tokens go to the model as they are."""
        merge = self.tokenizer.model.tokenize
        return [len(merge(byte_level(c))) for c in chunks]

    def __call__(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for run in groups(texts):
            cut = [self.special.split(t) if self.special else [t] for t in run]
            split = [self.split(c[0]) if len(c) == 1 else [w for t in c for w in self.split(t)] for c in cut]
            self.memo.learn(split)
            get = self.memo.__getitem__
            out += [len(c) - 1 + sum(map(get, s)) for c, s in zip(cut, split, strict=True)]
        return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    ship_package(spark)
    whole = spark.sparkContext.broadcast(whole_tokens(tokenizer))  # at most the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = Counter(tokenizer, whole.value)
        counter = _COUNTERS[tokenizer]
        for batch in batches:
            n = counter(text_list(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, "int64")], names=["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
