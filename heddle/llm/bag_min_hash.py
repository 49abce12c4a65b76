"""BagMinHash signatures of multisets of word shingles, for whole batches of texts at once.

A multiset is taken as weights, one per distinct shingle. Weights are discretised to whole
numbers; a weight w stands for the unit intervals [0,1), [1,2), ... up to w. On each interval runs a
Poisson process in time whose points each fall on one of the signature's registers; a register
keeps the earliest point that falls on it. Two multisets share the processes of the weight they
have in common, so a register agrees with the probability min/max summed over all shingles: the
weighted (multiset) Jaccard similarity.

Intervals are nested to make this fast: [0,1), [1,2), [2,4), [4,8), ... are the top level; each has
one process of a rate equal to its length, whose points fall on a unit interval inside it at
random; points beyond the weight are passed over. So the work for a weight grows with its
logarithm, and a process stops as soon as its next point is later than the latest register.
All processes of a batch advance together, a point each in a step, until none can change anything.
"""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: An odd base of the polynomial by which bytes of a word are hashed, and its inverse mod 2^64.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, kept for the largest n so far."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, "uint64")
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _POWERS[base] = have
    return have[:n]


def shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): of each text the hashes of its runs of k words, in order.

    A text with fewer words, but some, has the run of all its words. All words of the batch are
    hashed from one array of bytes: a prefix polynomial gives each word's by a difference.
    """
    data = np.frombuffer(b" ".join(t.encode("utf-8") for t in texts) + b" ", "uint8")
    lengths = np.fromiter((len(t.encode("utf-8")) if not t.isascii() else len(t) for t in texts), "int64", len(texts))
    ends = np.cumsum(lengths + 1)
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype("int8")))
    first, last = edge[0::2], edge[1::2]  # a word is data[first:last]
    prefix = np.zeros(len(data) + 1, "uint64")
    np.cumsum((data.astype("uint64") + np.uint64(1)) * powers(BASE, len(data)), out=prefix[1:])
    words = mixed((prefix[last] - prefix[first]) * powers(INVERSE, len(data))[first] + (last - first).astype("uint64"))
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])  # words of text i
    counts = np.diff(bounds)
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype("int64"))
    offsets = np.concatenate([[0], np.cumsum(runs)])
    starts = np.repeat(bounds[:-1] - offsets[:-1], runs) + np.arange(offsets[-1])
    padded = np.concatenate([words, np.zeros(k, "uint64")])
    out = np.full(len(starts), np.uint64(k), "uint64")
    for j in range(k):
        out = mixed(out * GOLDEN + padded[starts + j])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h = np.full(1, counts[i], "uint64")
        for w in words[bounds[i] : bounds[i + 1]]:
            h = mixed(h * GOLDEN + w)
        out[offsets[i]] = h[0]
    return out, offsets


def occurrences(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, weight) of the distinct shingles of each text."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers; a text without shingles has infinities. A register's value is a time, whose
    bits name the point: equal values mean the same point of the same process."""
    registers = np.full(n * m, np.inf)
    latest = np.full(n, np.inf)
    # Level 0 is [0,1), level j is [2^(j-1), 2^j). A weight w reaches into 1 + ceil(log2(w)) levels,
    # as many as w - 1 has bits and one; the last is partly filled unless w is a power of two.
    levels = np.frexp(weight - 1.0)[1].astype("int64") + 1
    who = np.repeat(np.arange(len(owner)), levels)
    level = np.arange(len(who)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype("int64")
    length = np.where(level == 0, 1, low)
    state = mixed(shingle[who] ^ mixed(level.astype("uint64") * GOLDEN + np.uint64(1)))
    doc, reach = owner[who], weight[who] - low
    time = np.zeros(len(who))
    while len(doc):
        state = mixed(state + GOLDEN)
        u = ((state >> np.uint64(11)).astype("float64") + 0.5) * 2.0**-53
        time = time - np.log(u) / length
        early = time < latest[doc]
        if not early.all():
            state, time, doc, reach, length = state[early], time[early], doc[early], reach[early], length[early]
        where = mixed(state ^ GOLDEN)
        hit = (where >> np.uint64(32)).astype("int64") % length < reach
        slot = doc * m + ((where & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype("int64")
        if not hit.all():
            np.minimum.at(registers, slot[hit], time[hit])
        else:
            np.minimum.at(registers, slot, time)
        touched = np.unique(doc)
        latest[touched] = registers.reshape(n, m)[touched].max(axis=1)
    return registers.reshape(n, m)


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """n x (m / rows) keys; band b's key is a hash of its registers and of b."""
    n, m = registers.shape
    bits = np.ascontiguousarray(registers).view("uint64").reshape(n, m // rows, rows)
    keys = np.broadcast_to(np.arange(m // rows, dtype="uint64"), (n, m // rows)).copy()
    for r in range(rows):
        keys = mixed(keys * GOLDEN + bits[:, :, r])
    return keys.view("int64")
