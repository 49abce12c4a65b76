"""A SentencePiece model file rebuilt as a tokenizer of the tokenizers library.

The model is a protocol buffer; the few fields needed are read straight from its wire format:
the pieces with scores and types, the model type, the byte fallback, and the normaliser.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from heddle.llm.chunk_ids import Memo, groups, packed

MARK = "▁"
#: Stands between chunks that are encoded as one text; private-use characters. Chunks that hold one of
#: them go alone, so that no chunk can make up a part of it.
BREAK, RUN = "\ue000|\ue001|\ue000", 4096
#: Piece types and model types of the format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a message; lengths give bytes, the rest numbers."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError(f"wire type {kind} isn't in use")
        yield number, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        m = cls()
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in fields(value):
                    if k == 1:
                        piece = v.decode("utf-8")
                    elif k == 2:
                        score = v
                    elif k == 3:
                        kind = v
                m.pieces.append((piece, score, kind))
            elif number == 2:
                for k, v in fields(value):
                    if k == 3:
                        m.model_type = v
                    elif k == 35:
                        m.byte_fallback = bool(v)
                    elif k == 40:
                        m.unk_id = v
            elif number == 3:
                for k, v in fields(value):
                    if k == 2:
                        m.charsmap = v
                    elif k == 3:
                        m.dummy_prefix = bool(v)
                    elif k == 4:
                        m.squeeze = bool(v)
                    elif k == 5:
                        m.escape = bool(v)
        return m

    def merges(self) -> list[tuple[str, str]]:
        """All pairs that join into a piece, best score first; of one piece, by their ids."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                for k in range(1, len(piece)):
                    left, right = ids.get(piece[:k]), ids.get(piece[k:])
                    if left is not None and right is not None:
                        found.append((-score, left, right))
        return [(self.pieces[a][0], self.pieces[b][0]) for _, a, b in sorted(found)]

    def backend(self):
        """The tokenizer for normalised text, without normaliser, and with the decoder."""
        from tokenizers import Tokenizer, decoders, models

        if self.model_type == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            unk = self.pieces[self.unk_id][0]
            model = models.BPE(vocab=vocab, merges=self.merges(), unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.model_type == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.model_type} isn't supported")
        tokenizer = Tokenizer(model)
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        tokenizer.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if self.dummy_prefix else steps)
        return tokenizer

    def normaliser(self):
        from tokenizers import normalizers

        return normalizers.Precompiled(self.charsmap) if self.charsmap else None


#: A single space stays as it is, so it needn't be met.
SPACES = re.compile(" {2,}")


class Codec:
    """Encodes and decodes texts with the rebuilt model.

    Normalised text is cut before each run of markers and around newlines. No token crosses such a
    cut unless some piece does, which is looked up once; then whole texts are encoded.

    With ``verify`` each chunk not met before is also encoded by the sentencepiece library, behind a
    marker or a newline as it stood, and so is a share of ``whole`` of all texts, chosen by their
    checksum, to prove the cuts. Where chunks can't be given to the library (a model with a character
    map, or without the marker in front) all texts are compared whole. A difference raises.

    Models with pieces defined by the user, and of types other than BPE and unigram, raise.
    """

    def __init__(self, path: str, verify: bool = True, whole: float = 0.01):
        from tokenizers import AddedToken

        self.model = PieceModel.load(path)
        self.tokenizer = self.model.backend()
        self.normalise_chars = self.model.normaliser()
        normal = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED)]
        atoms = [p for p, _, kind in self.model.pieces if kind == USER_DEFINED]
        crosses = any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in normal)
        self.cut = None if crosses or atoms else re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+").findall
        self.atoms = atoms
        if atoms:
            raise ValueError("user-defined pieces aren't supported")
        self.memo = Memo(self._ids)
        self.tokenizer.add_special_tokens([AddedToken(BREAK, special=True, normalized=False)])
        self.break_id = self.tokenizer.token_to_id(BREAK)
        self.reference, self.whole = None, whole
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_chunk = self.cut is not None and not self.normalise_chars and self.model.dummy_prefix
            self.before = self.reference.encode("a\n")
            self.newline = self.before[len(self.reference.encode("a")) :]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Many chunks go as one text, a special token between them: the library
        cuts there before all else, and an object per chunk is spared."""
        plain = [i for i, c in enumerate(chunks) if "\ue000" not in c and "\ue001" not in c]
        runs = [plain[a : a + RUN] for a in range(0, len(plain), RUN)]
        encoded = self.tokenizer.encode_batch_fast([BREAK.join([chunks[i] for i in run]) for run in runs], add_special_tokens=False)
        out: list[bytes] = [b""] * len(chunks)
        for run, e in zip(runs, encoded, strict=True):
            ids = np.array(e.ids, "<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.break_id)).tolist()
            for i, a, b in zip(run, [-4, *cuts], [*cuts, len(raw)], strict=True):
                out[i] = raw[a + 4 : b]
        for i in set(range(len(chunks))) - set(plain):
            out[i] = packed([t.id for t in self.tokenizer.model.tokenize(chunks[i])])
        if self.reference is not None and self.by_chunk:
            self._compare(chunks, out)
        return out

    def _compare(self, chunks: list[str], own: list[bytes]) -> None:
        """Raise where the library has other ids. It puts a marker in front of what it is given, so a
        chunk that begins with one goes without; markers alone stand before a newline, and other
        chunks behind one."""
        asked = [c[1:] + ("" if c.strip(MARK) else "\n") if c.startswith(MARK) else "a\n" + c for c in chunks]
        for c, ids, theirs in zip(chunks, own, self.reference.encode(asked, num_threads=1), strict=True):
            if not c.startswith(MARK):
                theirs = theirs[len(self.before) :]
            elif not c.strip(MARK):
                theirs = theirs[: len(theirs) - len(self.newline)]
            if ids != array("I", theirs).tobytes():
                raise ValueError(f"no parity on {c!r}: {np.frombuffer(ids, '<u4').tolist()} and {theirs}")

    def _compare_whole(self, texts: list[str], own: list[bytes]) -> None:
        share = self.whole if self.by_chunk else 1.0
        picked = [i for i, t in enumerate(texts) if zlib.crc32(t.encode("utf-8", "surrogatepass")) < share * 2**32]
        for i, theirs in zip(picked, self.reference.encode([texts[i] for i in picked], num_threads=1), strict=True):
            if own[i] != array("I", theirs).tobytes():
                raise ValueError(f"no parity on the text {texts[i][:200]!r}")

    def normalise(self, text: str) -> str:
        """The text that decoding gives back, before markers are put in."""
        if self.normalise_chars:
            text = self.normalise_chars.normalize_str(text)
        if self.model.squeeze:
            text = SPACES.sub(" ", text).strip(" ")
        return text.replace(MARK, " ") if self.model.escape else text

    def _marked(self, text: str) -> str:
        if not text:
            return ""
        text = (" " if self.model.dummy_prefix else "") + text
        return text.replace(" ", MARK) if self.model.escape else text

    def encode(self, texts: list[str], normal: list[str] | None = None) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; ``normal``: the texts, normalised,
        where the caller has them."""
        out: list[bytes] = []
        for run in groups(texts):
            plain = map(self.normalise, run) if normal is None else normal[len(out) : len(out) + len(run)]
            marked = [self._marked(t) for t in plain]
            if self.cut is None:
                rows = self._ids(marked)
            else:
                split = [self.cut(t) for t in marked]
                self.memo.learn(split)
                get = self.memo.__getitem__
                rows = [b"".join(map(get, s)) for s in split]
            if self.reference is not None:
                self._compare_whole(run, rows)
            out += rows
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)
