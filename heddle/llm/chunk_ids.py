"""Token ids by memo: a text is split where no token can cross, and each chunk is encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries a memo may hold before it starts anew, and the longest chunk it keeps, in characters:
#: together they bound a worker's memory whatever the input.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 128
#: Characters of text taken together when chunks not met before are encoded as one batch.
GROUP_CHARS = 2_000_000


class Memo(dict):
    """chunk -> value; ``learn`` computes the values of chunks not met before, as one batch.

    Chunks of more than MEMO_CHARS characters stay until the next batch is learned, no longer.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], fixed: dict | None = None):
        super().__init__(fixed or {})
        self.compute, self.fixed, self.passing = compute, fixed or {}, []

    def learn(self, lists: Iterable[Iterable[str]]) -> None:
        lists = list(lists)
        for c in self.passing:
            self.pop(c, None)
        new = set().union(*lists).difference(self)
        if len(self) + len(new) > MEMO_ENTRIES and len(self) > len(self.fixed):
            self.clear()
            self.update(self.fixed)
            new = set().union(*lists).difference(self)
        self.passing = [c for c in new if len(c) > MEMO_CHARS]
        if new:
            chunks = list(new)
            self.update(zip(chunks, self.compute(chunks), strict=True))


def runs(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts, nulls as empty ones, in slices of about GROUP_CHARS bytes."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("int64"))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + GROUP_CHARS, side="right")))
        yield texts.slice(at, to - at)
        at = to


class IdTable:
    """The ids of chunks, end to end in one array, with a dict from chunk to place.

    ``compute`` takes chunks not met before and gives their (ids, sizes). Bounds are those of Memo.
    """

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.compute = compute
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, "<i4"), np.zeros(0, "int64")

    def look(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of distinct chunks; a chunk's ids are ids[start : start + size]."""
        new = [c for c in chunks if c not in self.at]
        if len(self.at) + len(new) > MEMO_ENTRIES and self.at:
            self.clear()
            new = chunks
        short, long = [c for c in new if len(c) <= MEMO_CHARS], [c for c in new if len(c) > MEMO_CHARS]
        if short:
            self.at.update(zip(short, range(len(self.at), len(self.at) + len(short)), strict=True))
            ids, sizes = self.compute(short)
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        at, ids, sizes = self.at, self.ids, self.sizes
        if long:
            at = at | dict(zip(long, range(len(at), len(at) + len(long)), strict=True))
            more = self.compute(long)
            ids, sizes = np.concatenate([ids, more[0]]), np.concatenate([sizes, more[1]])
        place = np.fromiter(map(at.__getitem__, chunks), "int64", len(chunks))
        return ids, (np.cumsum(sizes) - sizes)[place], sizes[place]


def chunk_ids(chunks: pa.ListArray, table: IdTable) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of texts that are split into chunks: the chunks' ids end to end.

    Chunks are made distinct first, so Python sees each of them once a batch; ids are then gathered
    by index.
    """
    flat = chunks.flatten().dictionary_encode()
    ids, starts, sizes = table.look(flat.dictionary.to_pylist())
    index = flat.indices.to_numpy(zero_copy_only=False)
    n = sizes[index]
    ends = np.concatenate([[0], np.cumsum(n)])
    taken = ids[np.repeat(starts[index] - ends[:-1], n) + np.arange(ends[-1])] if len(n) else np.zeros(0, "<i4")
    bounds = np.asarray(chunks.offsets)
    return taken, ends[bounds - bounds[0]]


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of about GROUP_CHARS characters; a longer text is a run of its own."""
    run: list[str] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= GROUP_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, "<u4").tobytes()


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for themselves, the
    others get the code points from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


_CHARACTER = [c for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]


def byte_level(text: str) -> str:
    """A text in the byte-level alphabet."""
    if text.isascii() and text.isprintable():
        return text.replace(" ", _CHARACTER[32])
    return "".join([_CHARACTER[b] for b in text.encode("utf-8")])


def list_array(parts: list[bytes]) -> pa.Array:
    """A list<int32> array from one bytes object of little-endian ids per row."""
    sizes = np.fromiter((len(p) // 4 for p in parts), "int64", len(parts))
    offsets = np.zeros(len(parts) + 1, "int64")
    np.cumsum(sizes, out=offsets[1:])
    if offsets[-1] >= 2**31:
        raise ValueError("a batch may hold 2^31 - 1 tokens at most")
    values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), values)


def id_bytes(tokens: pa.Array) -> Iterator[bytes]:
    """Of each row of a list<int> array, the ids as little-endian unsigned 32-bit integers."""
    offsets = np.asarray(tokens.offsets)
    raw = np.asarray(tokens.values).astype("<u4", copy=False)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield raw[a:b].tobytes()


def text_list(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]
