"""Communities of a weighted graph in levels: local moves, refinement, contraction, and again.

The gain is modularity's at resolution 1. At each level nodes first move between communities; each
community is then taken apart into parts that its own links hold together; the parts become the nodes
of the next, smaller graph, which starts from the communities found. Levels end when moves bring no
more modularity or nothing can be put together.

A level's graph is two tables, written to the shared folder: nodes with their degree and the
weight inside them, and links in both directions. All steps are joins and sums over links; a node of
very many links is summed up in the tasks of its links.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.graph import label_components
from heddle.workspace import materialise, ship_package

#: Rounds in a row that bring less than the least gain before moves end; most nodes have had their turn
#: in them, and the next level goes on.
PATIENCE, LEAST_GAIN = 2, 1e-5
#: Nodes of a part of a round, and links for each of them, on the average: a part's links are some 100 MB.
PART, LINKS = 65_536, 16


def shared_neighbours(neighbours: DataFrame) -> DataFrame:
    """src < dst, shared, weight of every linked pair of a neighbour graph (src, dst).

    A row's neighbourhood is its neighbours and itself; weight is the share of common ones among
    all of both. Each link meets the two bounded lists of its ends, not all pairs around a hub.
    """
    around = neighbours.groupBy("src").agg(F.collect_set("dst").alias("found"))
    pairs = neighbours.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    own = lambda name: around.select(F.col("src").alias(name), F.array_union("found", F.array("src")).alias(f"_{name}"))
    both = pairs.join(own("src"), "src", "left").join(own("dst"), "dst", "left")
    # A row that is named by others and names none has itself alone.
    a, b = F.coalesce("_src", F.array("src")), F.coalesce("_dst", F.array("dst"))
    shared = F.size(F.array_intersect(a, b))
    return both.select("src", "dst", shared.alias("shared"), (shared / (F.size(a) + F.size(b) - shared)).alias("weight"))


def _graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, k, inner; links: src, dst, weight both ways) of undirected edges src, dst, weight."""
    every = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    links = every.union(every.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    links = materialise(links.withColumn("weight", F.col("weight")), "links")
    inner = F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0))
    nodes = materialise(links.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"), inner.alias("inner")), "nodes")
    return nodes, links.where("src <> dst")


def _moved(table: pa.Table) -> pa.Table:
    """One part's turn: its nodes, one after another, go to the community of the largest gain.

    Rows of kind 0 are its nodes, those of kind 1 links between them; what its nodes have outside comes summed
    up, of kind 2 into their own community, of kind 3 into the best other one, whose total stays as it was. A node
    looks again when a neighbour has moved, and all look again until that brings less than the least gain, by the
    part's share of the weight.
    """
    kind = table.column("kind").to_numpy()
    rows = lambda k, *names: [table.column(n).filter(pa.array(kind == k)).to_numpy() for n in names]
    ids, home, k, inner, total, may, twice = rows(0, "src", "community", "k", "inner", "total", "may", "twice")
    order = np.argsort(ids, kind="stable")
    ids, home, k, inner, total, may, twice = (v[order] for v in (ids, home, k, inner, total, may, twice))
    n = len(ids)
    src, dst, weight = rows(1, "src", "dst", "weight")
    src, dst = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    order = np.lexsort((dst, src))
    src, dst, weight = src[order], dst[order], weight[order]
    ends = np.cumsum(np.bincount(src, minlength=n)).tolist()
    ends, near, heavy = [0, *ends], dst.tolist(), weight.tolist()
    first, own, totals, out, others = home.tolist(), home.tolist(), dict(zip(home.tolist(), total.tolist(), strict=True)), {}, set()
    for v, w in zip(*(c.tolist() for c in rows(2, "src", "weight")), strict=True):
        i = int(np.searchsorted(ids, v))
        out.setdefault(i, {})[first[i]] = w
    for v, c, t, w in zip(*(c.tolist() for c in rows(3, "src", "community", "total", "weight")), strict=True):
        out.setdefault(int(np.searchsorted(ids, v)), {})[c] = w
        if c not in totals:
            others.add(c)
            totals[c] = t
    wide, share, free = k.tolist(), (k / twice).tolist(), may.tolist()
    waiting, queued, brought, least = deque(range(n)), [True] * n, 0.0, LEAST_GAIN * k.sum() / 2
    while waiting:
        i = waiting.popleft()
        queued[i] = False
        mine, links = own[i], dict(out.get(i, ()))
        for e in range(ends[i], ends[i + 1]):
            c = own[near[e]]
            links[c] = links.get(c, 0.0) + heavy[e]
        totals[mine] -= wide[i]
        stay = gain = links.get(mine, 0.0) - share[i] * totals[mine]
        best, top = mine, round(stay, 9)
        for c, w in links.items():
            # A half of the nodes leave the part in a round, so that neighbours in two parts seldom swap.
            if c != mine and (free[i] or c not in others):
                g = w - share[i] * totals[c]
                r = round(g, 9)
                if r > top or (r == top and best != mine and c < best):
                    best, top, gain = c, r, g
        # Less than rounding is no gain: moves of none could go round for ever.
        if best != mine and gain > stay + 1e-9:
            own[i] = best
            brought += gain - stay
            for e in range(ends[i], ends[i + 1]):
                j = near[e]
                if not queued[j] and own[j] != best:
                    queued[j] = True
                    waiting.append(j)
        totals[own[i]] += wide[i]
        if not waiting and brought > least:
            waiting, queued, brought = deque(range(n)), [True] * n, 0.0

    def into(own: np.ndarray) -> np.ndarray:
        same = own[src] == own[dst]
        found = np.bincount(src[same], weight[same], n) + inner
        for i, links in out.items():
            found[i] += links.get(int(own[i]), 0.0)
        return found

    left = np.zeros(n, "int64")
    for i, links in out.items():
        left[i] = len(links)
    own = np.array(own, "int64")
    return pa.table({"node": ids, "community": own, "home": home, "held": into(home), "after": into(own), "k": k, "inner": inner, "outside": left}, MOVED)


MOVED = pa.schema([("node", "int64"), ("community", "int64"), ("home", "int64"), ("held", "float64"), ("after", "float64"), ("k", "float64"), ("inner", "float64"), ("outside", "int64")])


def local_moves(nodes: DataFrame, links: DataFrame, start: DataFrame, within: DataFrame | None = None) -> tuple[DataFrame, float]:
    """(node, community) after moves from ``start``, and its modularity.

    In a round nodes are dealt to parts of bounded size, whole communities (or, where ``within`` is given,
    whole groups of it) together where they fit. A part's nodes move one after another until none gains, by
    their links and by what is summed up of those outside. Rounds go on while they bring modularity; where
    no part has links outside, one is enough. Of all rounds the labels of most modularity stay.
    """
    ship_package(nodes.sparkSession)
    sizes = nodes.agg(F.sum("k").alias("m"), F.count("*").alias("n")).first()
    twice = sizes["m"] or 0.0
    best, top, idle, r = start.select("node", "community"), float("-inf"), 0, 0
    if not twice:
        return best, 0.0
    parts = max(1, -(-sizes["n"] // PART), -(-links.count() // (LINKS * PART)))
    keep = ["node", "community", "k", "inner", *(["group"] if within is not None else [])]
    state = start.select("node", "community").join(nodes, "node")
    state = state if within is None else state.join(within.select("node", F.col("community").alias("group")), "node")
    state = materialise(state.select(*keep), "state")
    while True:
        totals = state.groupBy("community").agg(F.sum("k").alias("total"))
        placed = state.join(totals, "community").withColumn("part", F.lit(0).cast("long"))
        if parts > 1:
            near = keep[-1] if within is not None else "community"
            blocks = state.groupBy(near).agg(F.ceil(F.count("*") / PART).alias("blocks"))
            block = F.pmod(F.xxhash64("node"), F.col("blocks"))
            placed = placed.join(blocks, near).withColumn("part", F.pmod(F.xxhash64(near, block, F.lit(r)), F.lit(parts)))
        may = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        own = placed.select("part", F.lit(0).alias("kind"), F.col("node").alias("src"), "community", "k", "inner", "total", may.alias("may"), F.lit(float(twice)).alias("twice"))
        if parts == 1:
            met = links.select(F.lit(0).cast("long").alias("part"), F.lit(1).alias("kind"), "src", "dst", "weight")
        else:
            a = placed.select(F.col("node").alias("src"), "part", F.col("community").alias("_home"), "k")
            b = placed.select(F.col("node").alias("dst"), F.col("part").alias("_part"), "community", "total")
            there = links.join(b, "dst").join(a, "src")
            outside = there.where("part <> _part").groupBy("src", "part", "community").agg(F.sum("weight").alias("weight"), F.max("total").alias("total"), F.max("k").alias("k"), F.max("_home").alias("_home"))
            gain = F.round(F.col("weight") - F.col("k") * F.col("total") / F.lit(twice), 9)
            other = F.max(F.when(F.col("community") != F.col("_home"), F.struct(gain.alias("gain"), (-F.col("community")).alias("c"), "weight", "total")))
            one = outside.groupBy("src", "part").agg(F.sum(F.when(F.col("community") == F.col("_home"), F.col("weight"))).alias("w"), other.alias("o"))
            none = F.lit(None).cast("double")
            kinds = F.array(F.struct(F.lit(2).alias("kind"), F.lit(None).cast("long").alias("community"), F.col("w").alias("weight"), none.alias("total")), F.struct(F.lit(3).alias("kind"), (-F.col("o.c")).alias("community"), F.col("o.weight").alias("weight"), F.col("o.total").alias("total")))
            summed = one.select("src", "part", F.inline(kinds)).where("weight IS NOT NULL")
            met = there.where("part = _part").select("part", F.lit(1).alias("kind"), "src", "dst", "weight").unionByName(summed, allowMissingColumns=True)
        step = own.unionByName(met, allowMissingColumns=True).groupBy("part").applyInArrow(_moved, "node long, community long, home long, held double, after double, k double, inner double, outside long")
        step = materialise(step, f"moves_{r}")
        q = F.sum(F.col("held") / twice - F.pow(F.col("k") / twice, F.lit(2)))
        quality = lambda by, held, step=step, q=q: step.groupBy(by).agg(F.sum(held).alias("held"), F.sum("k").alias("k")).agg(q.alias("q")).first()["q"]
        if not step.agg(F.sum("outside").alias("outside")).first()["outside"]:
            return step.select("node", "community"), quality("community", "after")
        before = quality("home", "held")
        if before > top + LEAST_GAIN:
            best, top, idle = step.select("node", F.col("home").alias("community")), before, 0
        else:
            idle += 1
        if idle == PATIENCE:
            return best, top
        step = step if within is None else step.join(state.select("node", "group"), "node")
        state, r = step.select(*keep), r + 1


def _connected(table: pa.Table) -> pa.Table:
    """node, component of the nodes of a part's links: each goes to the least node that it reaches."""
    ids, ends = np.unique(np.concatenate([table.column(n).to_numpy() for n in ("src", "dst")]), return_inverse=True)
    src, dst = ends[: len(table)], ends[len(table) :]
    least = np.arange(len(ids))
    while (np.minimum(least[src], least[dst]) < np.maximum(least[src], least[dst])).any():
        low, high = np.minimum(least[src], least[dst]), np.maximum(least[src], least[dst])
        np.minimum.at(least, high, low)
        while (least[least] < least).any():
            least = least[least]
    return pa.table({"node": pa.array(ids, "int64"), "component": pa.array(ids[least], "int64")})


def connected_parts(links: DataFrame, labels: DataFrame) -> DataFrame:
    """node, community: communities taken apart where links inside them don't connect them. Those of ``PART``
    nodes at most are looked at whole, many a task; larger ones by rounds over their links."""
    ship_package(links.sparkSession)
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("_a"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("_b"))
    sizes = labels.groupBy(F.col("community").alias("_a")).agg(F.count("*").alias("_n"))
    inside = materialise(links.join(a, "src").join(b, "dst").where("_a = _b").join(sizes, "_a").select("src", "dst", "_a", "_n"), "within")
    small, large = inside.where(F.col("_n") <= PART), inside.where(F.col("_n") > PART)
    tasks = max(1, -(-labels.count() // PART))
    by = F.pmod(F.xxhash64("_a"), F.lit(tasks)).alias("part")
    parts = small.select("src", "dst", by).groupBy("part").applyInArrow(_connected, "node long, component long")
    if not large.isEmpty():
        parts = parts.unionByName(label_components(large.select("src", "dst")).select("node", "component"))
    return labels.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def _contracted(nodes: DataFrame, links: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = parts.select(F.col("node").alias("src"), F.col("community").alias("_a"))
    b = parts.select(F.col("node").alias("dst"), F.col("community").alias("_b"))
    sums = links.join(a, "src").join(b, "dst").groupBy("_a", "_b").agg(F.sum("weight").alias("weight"))
    sums = materialise(sums.select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "weight"), "contracted")
    own = sums.where("src = dst").select(F.col("src").alias("node"), "weight")
    made = nodes.join(parts, "node").groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k"), F.sum("inner").alias("inner")).join(own, "node", "left")
    made = made.select("node", "k", (F.col("inner") + F.coalesce("weight", F.lit(0.0))).alias("inner"))
    return materialise(made, "level"), sums.where("src <> dst")


def communities(edges: DataFrame) -> DataFrame:
    """node, community (the least node of it) of undirected edges src, dst, weight > 0. Every community
    is connected."""
    nodes, links = base_nodes, base_links = _graph(edges)
    members = base_nodes.select("node", F.col("node").alias("part"))
    start, best, top = nodes.select("node", F.col("node").alias("community")), None, float("-inf")
    while True:
        labels, q = local_moves(nodes, links, start)
        if best is not None and q <= top + LEAST_GAIN:
            break
        placed = members.join(labels.withColumnRenamed("node", "part"), "part").select("node", "part", "community")
        best, top = materialise(placed, "placed"), q
        a = labels.select(F.col("node").alias("src"), F.col("community").alias("_a"))
        b = labels.select(F.col("node").alias("dst"), F.col("community").alias("_b"))
        inside = materialise(links.join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst", "weight"), "inside")
        parts, _ = local_moves(nodes, inside, nodes.select("node", F.col("node").alias("community")), labels)
        parts = materialise(parts, "parts")
        if parts.where("node <> community").isEmpty():
            break
        start = labels.join(parts.withColumnRenamed("community", "part"), "node").groupBy(F.col("part").alias("node")).agg(F.min("community").alias("community"))
        start = materialise(start, "start")
        nodes, links = _contracted(nodes, links, parts)
        members = best.join(parts.select(F.col("node").alias("part"), F.col("community").alias("_next")), "part").select("node", F.col("_next").alias("part"))
    return connected_parts(base_links, best.select("node", "community"))
