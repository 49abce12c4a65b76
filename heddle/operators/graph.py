"""Graphs of genes and rows: correlation edges, neighbours, components, modularity, mechanisms."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.matrix import one_row
from heddle.workspace import materialise, ship_package

#: Rows of a block of kernels; of a block of pairs at most, and of one that only keeps the nearest; of the tiles that
#: a task takes a pair of blocks in; the rows that tell how near the rest may be.
ROWS_PER_BLOCK, MOST_PER_BLOCK, WIDEST_BLOCK, TILE, WIDE, FIRST = 2048, 16_384, 65_536, 256, 1024, 8192


def _blocks(rows: DataFrame, size: int | None = None, most: int = MOST_PER_BLOCK) -> DataFrame:
    """Rows dealt to pairs of blocks: each row meets every block of the other side once. Without ``size``
    eight blocks, or blocks of ``most`` rows: copies are few, and a task takes a pair by tiles."""
    many = rows.count()
    n = max(1, -(-many // (size or min(most, max(ROWS_PER_BLOCK, -(-many // 8))))))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A row for each vector."""
    if column.null_count or not len(column):
        return np.array(column.to_pylist(), dtype="float64")
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype("float64").reshape(len(column), -1)


def sides(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose products of rows are the squared distances of ``x`` and ``y``, but for rounding."""
    one = lambda z: np.ones((len(z), 1))
    square = lambda z: (z**2).sum(1, keepdims=True)
    return np.hstack([x, square(x), one(x)]), np.hstack([-2 * y, one(y), square(y)])


def apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the rows ``i`` of ``x`` from the rows ``j`` of ``y``, from their differences."""
    out = np.empty(len(i))
    for s in range(0, len(i), 2048):
        z = x[i[s : s + 2048]] - y[j[s : s + 2048]]
        np.einsum("ij,ij->i", z, z, out=out[s : s + 2048])
    return np.sqrt(out)


def _nth(groups: np.ndarray) -> np.ndarray:
    """Of sorted groups: each entry's place in its group, from 0."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, int)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _hits(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true, which is little: eight are looked at at once."""
    many, flat = hit.shape[1], hit.ravel()
    if flat.size % 8:
        return np.divmod(np.flatnonzero(flat), many)
    eights = np.flatnonzero(flat.view("u8"))
    word, bit = np.nonzero(flat.reshape(-1, 8)[eights])
    return np.divmod(eights[word] * 8 + bit, many)


class _Distinct:
    """The different vectors of rows, in drawn order, and the rows of each by id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, asked: np.ndarray):
        _, group = np.unique(np.ascontiguousarray(x).view(f"V{x.dtype.itemsize * x.shape[1]}").ravel() if x.size else np.zeros(len(x)), return_inverse=True)
        many = int(group.max(initial=-1)) + 1
        wanted = np.bincount(group, asked, many) > 0
        drawn = np.random.default_rng(0).permutation(many)
        place = np.empty(many, int)
        # Those asked for first, so that tiles without any can be passed over.
        place[drawn[np.argsort(~wanted[drawn], kind="stable")]] = np.arange(many)
        group = place[group.ravel()]
        order = np.lexsort((ids, group))
        self.rows, self.ids, self.asked = order, ids[order], asked[order]
        self.many = np.bincount(group, minlength=many)
        self.starts = np.cumsum(self.many) - self.many
        self.x, self.least = x[order[self.starts]], self.ids[self.starts]
        self.wanted = np.bincount(group, asked, many) > 0

    def members(self, group: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(entry, place among the sorted rows) of the rows of each entry's vector, of the ``most`` least ids."""
        many = self.many[group] if most is None else np.minimum(self.many[group], most)
        entry = np.repeat(np.arange(len(group)), many)
        return entry, self.starts[group][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)


class _Kept:
    """Of each row what may be among its ``most`` nearest so far, and the cost that the rest must not pass."""

    def __init__(self, bound: np.ndarray, ties: np.ndarray, most: int):
        self.bound, self.ties, self.most, self.found = bound, ties, most, []

    def add(self, row: np.ndarray, other: np.ndarray, cost: np.ndarray) -> None:
        near = cost <= self.bound[row]
        self.found.append((row[near], other[near], cost[near]))

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, other, cost = (np.concatenate(v) for v in zip(*self.found, strict=True)) if self.found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        if len(row) > 4 * self.most:
            # Most are farther than the last that stays: only the rest is put in order.
            order = np.argsort(row, kind="stable")
            row, other, cost = row[order], other[order], cost[order]
            nth, place = _nth(row), np.cumsum(np.r_[False, row[1:] != row[:-1]])
            if (place[-1] + 1) * (nth.max() + 1) <= 8 * len(row) and nth.max() >= self.most:
                costs = np.full((place[-1] + 1, nth.max() + 1), np.inf)
                costs[place, nth] = cost
                near = cost <= np.partition(costs, self.most - 1, axis=1)[place, self.most - 1]
                row, other, cost = row[near], other[near], cost[near]
        best = np.lexsort((self.ties[other], cost, row))
        nth = _nth(row[best])
        best, nth = best[nth < self.most], nth[nth < self.most]
        row, other, cost = row[best], other[best], cost[best]
        full = nth == self.most - 1
        self.bound[row[full]] = np.minimum(self.bound[row[full]], cost[full])
        self.found = [(row, other, cost)]
        return row, other, cost


def _each_other(a: _Distinct, b: _Distinct, most: int, unit: bool) -> tuple[tuple, tuple]:
    """(vector of ``a``, vector of ``b``, cost) of the ``most`` nearest of ``b`` of each asked one of ``a``, and the same of ``b``.

    Single-precision tiles serve both sides. They give costs less what rounding may add to them, so they only
    pass over what is farther than the best so far; what may be nearer is measured by itself in double precision.
    The first rows of the other side tell how near the rest may be, and bounds are drawn closer as more is seen.
    """
    x, y, d = a.x, b.x, a.x.shape[1] if len(a.x) else 0
    if unit:
        x, y = _unit(x), _unit(y)
        left, right, slack = x, -y, (d + 8) * 2.0**-22
        limit = lambda bound: bound + 4e-9 + slack
    else:
        both = np.concatenate([x[:4096], y[:4096]])
        middle = both[np.isfinite(both).all(1)].mean(0) if np.isfinite(both).all(1).any() else 0.0
        far = max((np.abs(z - middle).max(initial=0, where=np.isfinite(z)) for z in (x, y)), default=0.0)
        scale = 2.0 ** -np.ceil(np.log2(far)) if 0 < far < 1e300 else 1.0
        one, square = (lambda z: np.ones((len(z), 1))), (lambda z: (z**2).sum(1, keepdims=True) * (1 - (d + 10) * 2.0**-22))
        xs, ys = (x - middle) * scale, (y - middle) * scale
        left, right = np.hstack([xs, square(xs), one(xs)]), np.hstack([-2 * ys, one(ys), square(ys)])
        limit = lambda bound: ((bound + 4e-9) * scale) ** 2 * (1 + 1e-6) + 1e-30
    left, right = left.astype("float32"), np.ascontiguousarray(right.astype("float32").T)

    def costs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not unit:
            return np.round(apart(x, y, i, j), 9)
        parts = [(x[i[s : s + 65_536]] * y[j[s : s + 65_536]]).sum(1) for s in range(0, len(i), 65_536)]
        return np.round(-np.concatenate(parts), 9) if parts else np.zeros(0)

    def bounds(far: np.ndarray, s: int, wanted: np.ndarray, measure) -> np.ndarray:
        """Costs that the ``most`` nearest of these of the other side don't pass: of the least ones of groups of 64."""
        many, width = far.shape
        bound = np.full(many, np.inf)
        if width > most:
            groups = width // 64
            if groups > 2 * most:
                parts = far[:, : groups * 64].reshape(many, groups, 64)
                near = np.argpartition(parts.min(2), most - 1, axis=1)[:, :most]
                near = near * 64 + parts[np.arange(many)[:, None], near].argmin(2)
            else:
                near = np.argpartition(far, most - 1, axis=1)[:, :most]
            found = measure(np.repeat(np.arange(s, s + many), most), near.ravel()).reshape(many, most).max(1)
            bound = np.where(np.isnan(found), np.inf, found)
        return np.where(wanted, bound, -np.inf)

    def limits(bound: np.ndarray) -> np.ndarray:
        none = np.isneginf(bound)
        return np.where(none, -np.inf, np.nextafter(limit(np.where(none, 0, bound)).astype("float32"), np.float32(np.inf))).astype("float32")

    with np.errstate(invalid="ignore", over="ignore"):
        mine, yours, done = _Kept(np.full(len(x), -np.inf), b.least, most), _Kept(np.full(len(y), -np.inf), a.least, most), []
        for t in range(0, int(b.wanted.sum()), TILE):
            found = bounds(np.ascontiguousarray((left[: FIRST // 2] @ right[:, t : t + TILE]).T), t, b.wanted[t : t + TILE], lambda j, i: costs(i, j))
            yours.bound[t : t + TILE] = found
        columns, back, seen = limits(yours.bound), b.wanted.any(), 0
        tiles = [(0, FIRST), *((t, t + WIDE) for t in range(FIRST, len(y), WIDE))] if len(y) else []
        for s in range(0, len(x), TILE):
            for low, high in tiles:
                if not a.wanted[s] and not b.wanted[low]:
                    break
                far = left[s : s + TILE] @ right[:, low:high]
                if not low:
                    mine.bound[s : s + TILE] = bounds(far, s, a.wanted[s : s + TILE], costs)
                    rows = limits(mine.bound[s : s + TILE])[:, None]
                hit = far <= rows
                if back:
                    hit |= far <= columns[low:high]
                i, j = _hits(hit)
                if len(i):
                    i, j = i + s, j + low
                    cost = costs(i, j)
                    mine.add(i, j, cost)
                    if back:
                        yours.add(j, i, cost)
                if low < 3 * FIRST <= high:
                    mine.cut()
                    rows = limits(mine.bound[s : s + TILE])[:, None]
            done.append(mine.cut())
            mine.found = []
            if back and s + TILE >= max(FIRST, 3 * seen):
                yours.cut()
                columns, seen = limits(yours.bound), s + TILE
    empty = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return tuple(np.concatenate(v) for v in zip(*(done or [empty]), strict=True)), yours.cut()


def _expanded(found: tuple, a: _Distinct, b: _Distinct, k: int, unit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, id, score) of the k nearest rows with another id, from the nearest different vectors."""
    group, other, cost = found
    # Costs are rounded, scores are not.
    score = np.empty(len(group))
    for s in range(0, len(group), 65_536):
        i, j = group[s : s + 65_536], other[s : s + 65_536]
        score[s : s + 65_536] = (_unit(a.x[i]) * _unit(b.x[j])).sum(1) if unit else apart(a.x, b.x, i, j)
    entry, at = b.members(other, k + 1)
    group, ids, cost, score = group[entry], b.ids[at], cost[entry], score[entry]
    best = np.lexsort((ids, cost, group))
    best = best[_nth(group[best]) < k + 1]
    group, ids, score = group[best], ids[best], score[best]
    entry, at = a.members(group)
    asked = a.asked[at]
    entry, at = entry[asked], at[asked]
    order = np.argsort(at, kind="stable")
    entry, at = entry[order], at[order]
    real = ids[entry] != a.ids[at]
    entry, at = entry[real], at[real]
    keep = _nth(at) < k
    entry, at = entry[keep], at[keep]
    return a.rows[at], ids[entry], score[entry]


def _closest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int, unit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``x``, id, score) of the k nearest rows of ``y`` with another id; ties of nine decimals by id."""
    a, b = _Distinct(x, ids, np.ones(len(x), bool)), _Distinct(y, others, np.zeros(len(y), bool))
    row, dst, score = _expanded(_each_other(a, b, k + 1, unit)[0], a, b, k, unit)
    order = np.argsort(row, kind="stable")
    return row[order], dst[order], score[order]


def nearest(rows: DataFrame, k: int, metric: str = "cosine", batch: str | None = None, size: int | None = None, asking: Column | None = None, across: bool = False) -> DataFrame:
    """src, dst, score of each row's k nearest other rows, exactly; ties by dst.

    ``rows``: id, vector array<float or double>, and a batch column if the k nearest are wanted of
    each batch, or with ``across`` of each other batch (few batches); ``asking``: a condition on id and batch of the rows that
    they are wanted for, by default all. Score is the cosine, or the Euclidean distance. Every pair of blocks
    is taken once, for both its sides, by tiles of a matrix product; only k candidates of each row and block go on to the
    last ranking.
    """
    ship_package(rows.sparkSession)
    kept = rows.select(F.col("id").cast("long").alias("id"), "vector", (F.col(batch) if batch else F.lit(0)).cast("string").alias("batch"))
    kept = kept.withColumn("asked", F.lit(True) if asking is None else F.coalesce(asking, F.lit(False)))
    dealt = _blocks(kept, size, WIDEST_BLOCK)
    pairs = dealt.select("id", "vector", "batch", "asked", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"))
    unit = metric == "cosine"

    def best(table: pa.Table) -> pa.Table:
        ids, second, asked = (table.column(c).to_numpy() for c in ("id", "second", "asked"))
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        groups = np.array(table.column("batch").to_pylist(), dtype=object)
        x = matrix(table.column("vector"))
        out = []

        def note(found: tuple, a: _Distinct, b: _Distinct, at: np.ndarray, g: str) -> None:
            row, dst, score = _expanded(found, a, b, k, unit)
            out.append((ids[at][row], dst, score, np.full(len(row), g, dtype=object)))

        one, two = np.flatnonzero(~second), np.flatnonzero(~second if same else second)
        names = sorted(set(groups), key=lambda g: (g is None, g))
        part = lambda at, asked: _Distinct(x[at], ids[at], asked)
        if across or len(names) < 2:
            for p, g in enumerate(names):
                for q, h in enumerate(names):
                    if (across and p == q) or (same and p > q):
                        continue
                    i, j = one[groups[one] == g], two[groups[two] == h]
                    if len(i) and len(j) and (asked[i].any() or asked[j].any()):
                        a, b = part(i, asked[i]), part(j, asked[j] & (not same or p != q))
                        there, back = _each_other(a, b, k + 1, unit)
                        note(there, a, b, i, h)
                        note(back, b, a, j, g)
        else:
            # Of many batches each is met by all rows at once.
            for i, j in [(one, two)] if same else [(one, two), (two, one)]:
                i = i[asked[i]]
                a = part(i, asked[i])
                for h in names if len(i) else []:
                    at = j[groups[j] == h]
                    if len(at):
                        b = part(at, np.zeros(len(at), bool))
                        note(_each_other(a, b, k + 1, unit)[0], a, b, i, h)
        join = lambda at, t: pa.array(np.concatenate([o[at] for o in out]) if out else [], t)
        return pa.table({"src": join(0, "int64"), "dst": join(1, "int64"), "score": join(2, "float64"), "batch": join(3, "string")})

    found = pairs.groupBy("a", "b").applyInArrow(best, "src long, dst long, score double, batch string")
    cost = F.round("score", 9)
    order = F.desc(cost) if unit else cost
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("src", "batch").orderBy(order, "dst"))).where(F.col("rank") <= k)
    return ranked if batch else ranked.drop("batch")


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each linked pair, whichever side named it."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "score").groupBy("src", "dst").agg(F.max("score").alias("score"))


def label_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node), by label spreading with pointer jumping, until nothing changes."""
    both = materialise(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "edges")
    labels = materialise(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    for k in itertools.count():
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("src"), "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("before"))
        hop = step.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        step = step.join(hop, F.col("component") == F.col("_n")).select("node", F.least("component", "_c").alias("component"), "before")
        step = materialise(step, f"labels_{k}")
        if step.where("component <> before").isEmpty():
            return step.select("node", "component")
        labels = step.select("node", "component")


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row, ``modularity`` of weighted undirected edges (src, dst, weight) under members (node, community)."""
    m = members.select(F.col("node").alias("_n"), "community")
    a = edges.join(m, F.col("src") == F.col("_n")).drop("_n").withColumnRenamed("community", "ca")
    b = a.join(m, F.col("dst") == F.col("_n")).drop("_n").withColumnRenamed("community", "cb")
    total = edges.agg(F.sum("weight").alias("m"))
    inside = b.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("inside"))
    ends = b.select(F.col("ca").alias("c"), "weight").union(b.select("cb", "weight")).groupBy("c").agg(F.sum("weight").alias("degree"))
    per = one_row(ends.join(inside, "c", "left"), total)
    q = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2))
    return per.agg(F.sum(q).alias("modularity"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, centrality = degree / (nodes - 1)."""
    d = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    return one_row(d, d.agg(F.count("*").alias("_n"))).select("node", "degree", F.coalesce(F.try_divide(F.col("degree"), F.col("_n") - 1), F.lit(0.0)).alias("centrality"))


def causal_edges(correlations: DataFrame, variances: DataFrame, n: int) -> DataFrame:
    """The n pairs of largest |corr|, directed from the larger variance to the smaller (g1 on ties)."""
    top = correlations.orderBy(F.round(F.abs("corr"), 9).desc(), "g1", "g2").limit(n)
    v1, v2 = variances.select(F.col("gene_id").alias("g1"), F.col("var_samp").alias("v1")), variances.select(F.col("gene_id").alias("g2"), F.col("var_samp").alias("v2"))
    forward = F.round("v1", 9) >= F.round("v2", 9)
    return top.join(v1, "g1").join(v2, "g2").select(F.when(forward, F.col("g1")).otherwise(F.col("g2")).alias("src"), F.when(forward, F.col("g2")).otherwise(F.col("g1")).alias("dst"), F.abs("corr").alias("weight"))


def merge_edges(sources: list[DataFrame]) -> DataFrame:
    """Edges (src, dst, weight, type) of several kinds; of a pair in either direction the weights add
    up, the kinds are listed, and the direction is that of the first kind that has it."""
    numbered = [s.withColumn("_k", F.lit(i)) for i, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, numbered)
    pair = {"_a": F.least("src", "dst"), "_b": F.greatest("src", "dst")}
    merged = every.withColumns(pair).groupBy("_a", "_b").agg(
        F.min(F.struct("_k", "src", "dst")).alias("first"), F.sum("weight").alias("weight"), F.array_sort(F.collect_set("type")).alias("types")
    )
    return merged.select("first.src", "first.dst", "weight", "types")
