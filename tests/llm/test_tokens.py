"""Encoders and counters against the libraries."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heddle.llm import chunk_ids, piece_model, sentencepiece_codec, token_counts, token_files
from heddle.workspace import scratch_path

WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "a  b\n\n c", "İΣΣ É é", "x\u0085y\x1cz ", "<|endoftext|>a<|startoftext|>", "don't I'LL", "你好 12 😀😀", "a\tb\r\nc\x0b", "<s> </s> <0x0A>", "trail  ", "  lead", "a.b,%% c's d'tx e'", "x.'s y-'ll", "e\u0301. E\u0301! İ.", "a.<|endoftext|>.b", "A<|B", "İ", "aİ.", "\u0958.", "×. ÷.", "ß.ǅ,ə."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


@pytest.fixture(scope="module")
def own():
    return {"encoder": token_files.Encoder(WORD), "counter": token_counts.Counter(BYTE, token_counts.whole_tokens(BYTE)), "codec": piece_model.Codec(PIECE)}


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def encoded(encoder, texts):
    """Ids of each text, by way of the runs that a task takes together."""
    out = []
    for run in chunk_ids.runs(pa.array(texts, "string")):
        ids, offsets = encoder(run)
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def check(texts, own, library, sp):
    ids = lambda rows: [np.frombuffer(r, "<u4").tolist() for r in rows]
    assert encoded(own["encoder"], texts) == [e.ids for e in library[WORD].encode_batch(texts, add_special_tokens=False)]
    assert own["counter"](texts) == [len(e.ids) for e in library[BYTE].encode_batch(texts, add_special_tokens=False)]
    got = ids(own["codec"].encode(texts))
    assert got == sp.encode(texts)
    assert own["codec"].decode(got) == [t.replace(piece_model.MARK, " ") for t in texts] == sp.decode(got)


def test_chunks_are_exact_on_odd_texts(own, library, sp):
    assert own["encoder"].chunked and own["codec"].cut
    check(ODD, own, library, sp)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40), min_size=1, max_size=4))
def test_chunks_are_exact_on_any_text(own, library, sp, texts):
    check(texts, own, library, sp)


def test_chunks_are_exact_on_documents(docs, own, library, sp):
    check([r.text for r in docs.select("text").collect()], own, library, sp)


def test_memo_starts_anew(own, monkeypatch):
    monkeypatch.setattr(chunk_ids, "MEMO_ENTRIES", 50)
    words = [" ".join(random.Random(i).choices("abcdefgh", k=30)) + str(i) for i in range(40)]
    small = token_files.Encoder(WORD)
    assert [ids for w in words for ids in encoded(small, [w])] == encoded(own["encoder"], words)


def test_memo_lets_long_chunks_go(library):
    small = token_files.Encoder(WORD)
    long = "ab" * 3_000_000
    assert encoded(small, [long, "a b"]) == [e.ids for e in library[WORD].encode_batch([long, "a b"], add_special_tokens=False)]
    assert max(map(len, small.table.at)) <= chunk_ids.MEMO_CHARS


def test_runs_cover_all_texts(monkeypatch):
    monkeypatch.setattr(chunk_ids, "GROUP_CHARS", 10)
    texts = ["abc", None, "x" * 30, "", "abcdefgh", "ijk", None]
    got = [r.to_pylist() for r in chunk_ids.runs(pa.array(texts, "string"))]
    assert sum(got, []) == [t or "" for t in texts] and all(len(r) == 1 or sum(map(len, r)) <= 10 for r in got)
    assert list(chunk_ids.runs(pa.array([], "string"))) == []


def test_token_files(spark, awkward, clashing, empty, library):
    for frame in (awkward, clashing, empty):
        path = scratch_path(spark, "tokens")
        token_files.write_token_files(frame, path, WORD, 1)
        rows = token_files.with_crc32(token_files.read_token_files(spark, path)).collect()
        hashed = frame.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
        raw = sorted(((r.doc_id, r.text or "", r.h) for r in hashed), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
        want, start = [], 0
        for d, t, _ in raw:
            ids = [*library[WORD].encode(t, add_special_tokens=False).ids, 1]
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(rows, key=lambda r: r.start) == want


def test_one_id_goes_to_several_files(spark):
    """Many texts of one id, and of none, are dealt by their hashes."""
    rows = [(None if i % 2 else 7, f"text {i} of many") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = scratch_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(frame, path, WORD, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert len(got) == 400 and [r.doc_id for r in got] == [None] * 200 + [7] * 200
    parts = spark.read.parquet(path).groupBy("doc_id").agg(F.count_distinct("part").alias("n")).collect()
    assert all(r.n > 1 for r in parts)


def test_token_file_format(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "tokens")
    token_files.write_token_files(docs, path, WORD, 1)
    files = sorted(glob.glob(path.removeprefix("file://") + "/*.parquet"))
    last = -1
    for f in files:
        meta = pq.ParquetFile(f)
        if meta.metadata.num_rows == 0:
            continue
        columns = {meta.metadata.row_group(0).column(i).path_in_schema: meta.metadata.row_group(0).column(i) for i in range(meta.metadata.num_columns)}
        assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_offset_index
        ids = meta.read(columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]


def test_token_counts_awkward(awkward, clashing, empty, library):
    for frame in (awkward, clashing):
        want = Counter()
        for r in frame.collect():
            n = len(library[BYTE].encode(r.text or "", add_special_tokens=False).ids)
            want[r.doc_id, len((r.text or "").encode()), n, n > 512] += 1
        assert Counter(map(tuple, token_counts.token_counts(frame, BYTE).collect())) == want
    assert token_counts.token_counts(empty, BYTE).count() == 0


def test_sentencepiece_awkward(awkward, clashing, empty, sp):
    for frame in (awkward, clashing):
        rows = sentencepiece_codec.round_trip(frame, PIECE).collect()
        want = Counter()
        for r in frame.collect():
            ids = sp.encode(r.text or "")
            want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
        assert all(r.same_text for r in rows)
        back = sentencepiece_codec.decode(sentencepiece_codec.encode(frame, PIECE), PIECE)
        assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in frame.collect())
    assert sentencepiece_codec.round_trip(empty, PIECE).count() == 0


@pytest.mark.parametrize("odd", [piece_model.BREAK, "\ue000", "\ue001", "\ue000|", "\ue000|\ue001|", "|\ue000", "|\ue001|\ue000", "▁▁x ▁", "▁"])
def test_separators_in_texts(sp, odd):
    """Parts of the separator, and markers, at every place of a text and of its chunks."""
    codec = piece_model.Codec(PIECE, whole=1.0)
    texts = [odd, f"x\n{odd}\ny", f"{odd} x", f"x {odd}", f"x{odd}y", f"{odd}\n", f"\n{odd}", f"{odd}{odd}", f"a {odd}b\n{odd} c", "plain"]
    assert [np.frombuffer(r, "<u4").tolist() for r in codec.encode(texts)] == sp.encode(texts)


def test_parity_is_verified_on_every_kind_of_chunk():
    for text in ("one two", "one\ntwo", "\n", "  \n", "one\n two"):
        codec = piece_model.Codec(PIECE, whole=0.0)
        codec.encode([text])
        chunks = list(codec.memo)
        for chunk in chunks:
            with pytest.raises(ValueError, match="no parity"):
                codec._compare([chunk], [codec.memo[chunk] + b"\1\0\0\0"])
        with pytest.raises(ValueError, match="no parity"):
            codec.whole = 1.0
            codec._compare_whole([text], [b""])


def test_unigram_models_are_rebuilt():
    """A small unigram model, written by hand in the wire format."""
    import struct

    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    pieces = [("<unk>", 0, 2), ("▁", -3, 1), ("▁ab", -1, 1), ("a", -2, 1), ("b", -2, 1), ("c", -2.5, 1)]
    data = b"".join(piece(*p) for p in pieces) + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 1, 5 << 3, 1]))
    model = piece_model.PieceModel.parse(data)
    assert model.model_type == piece_model.UNIGRAM and model.squeeze and not model.byte_fallback
    assert model.backend().encode("▁abc").ids == [2, 5]
