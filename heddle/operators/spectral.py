"""Spectral clustering: a block eigensolver whose products with the sparse graph are Spark sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.graph import label_components, matrix
from heddle.operators.ml import eigengap, summed
from heddle.workspace import materialise, ship_package

#: Groups of the coarsest graph at most: the driver solves the square of them. What keeps a correction bounded.
COARSE, SHIFT = 4_096, 0.02


def normalised_links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links src, dst, weight both ways, of D^-1/2 W D^-1/2; nodes id, degree)."""
    every = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    both = every.union(every.select("dst", "src", "weight").where("src <> dst")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    both = materialise(both, "both")
    nodes = materialise(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")), "degrees")
    a = nodes.select(F.col("id").alias("src"), F.col("degree").alias("_a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("degree").alias("_b"))
    links = both.join(a, "src").join(b, "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("_a") * F.col("_b"))).alias("weight"))
    return materialise(links, "normalised"), nodes


def _product(links: DataFrame, block: DataFrame, width: int) -> DataFrame:
    """id, product: the graph times a block of columns (id, vector)."""
    met = links.join(block.select(F.col("id").alias("dst"), "vector"), "dst")
    sums = met.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("weight") * F.col("vector")[j]).alias(f"p{j}") for j in range(width)])
    return sums.select("id", F.array(*[f"p{j}" for j in range(width)]).alias("product"))


def _aggregates(links: DataFrame, nodes: DataFrame, most: int, seed: int) -> tuple[DataFrame, DataFrame, list[str], DataFrame]:
    """Nested groups of strongly linked nodes, ``most`` at the coarsest level.

    (nodes id, root, a1; a row for each finest group with its group and scale at every level, a1, s1,
    a2, ...; the names of its levels; links src, dst, weight of the coarsest groups.) Every node takes
    its strongest neighbour, what so hangs together is a group, and groups are the next level's nodes.
    Groups without links to others are put together by hash in the end.
    """
    a = nodes.select(F.col("id").alias("src"), F.col("degree").alias("_a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("degree").alias("_b"))
    graph = links.join(a, "src").join(b, "dst").select("src", "dst", (F.col("weight") * F.sqrt(F.col("_a") * F.col("_b"))).alias("weight"))
    chain, names, many = None, [], nodes.count()
    while True:
        inside = F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0))
        points = materialise(graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"), inside.alias("inside")), "points")
        if names:
            # One over what leads out of a group, and a little: what a step of Jacobi divides by.
            scale = 1 / (F.col("degree") - F.col("inside") + SHIFT * F.col("degree"))
            scales = points.select(F.col("node").alias(names[-1]), scale.alias(f"s{len(names)}"))
            upper = scales if len(names) == 1 else upper.join(scales, names[-1])
            left = points.count()
            if left <= most:
                break
            stuck, many = left > 0.9 * many, left
        else:
            stuck = False
        if stuck:
            step = points.select("node", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(most)).alias("to"))
        else:
            other = points.select(F.col("node").alias("dst"), F.col("degree").alias("_d"))
            best = F.max(F.struct((F.col("weight") / F.sqrt("_d")).alias("w"), (-F.col("dst")).alias("d")))
            near = graph.where("src <> dst").join(other, "dst").groupBy(F.col("src").alias("node")).agg((-best["d"]).alias("to"))
            step = materialise(points.select("node").join(near, "node", "left").select("node", F.coalesce("to", "node").alias("to")), "strongest")
            hop = lambda t: t.select(F.col("node").alias("to"), F.col("to").alias("far"))
            step = step.join(hop(step), "to").select("node", F.when(F.col("far") == F.col("node"), F.least("node", "to")).otherwise(F.col("to")).alias("to"))
            moved = True
            while moved:
                step = materialise(step, "pointers")
                jumped = step.join(hop(step), "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved"))
                jumped = materialise(jumped, "jumped")
                moved = not jumped.where("moved").isEmpty()
                step = jumped.select("node", "to")
        step = materialise(step, "groups")
        name = f"a{len(names) + 1}"
        if not names:
            chain = step.select(F.col("node").alias("id"), F.col("to").alias(name))
        else:
            upper = upper.join(step.select(F.col("node").alias(names[-1]), F.col("to").alias(name)), names[-1])
        names.append(name)
        x, y = step.select(F.col("node").alias("src"), F.col("to").alias("_x")), step.select(F.col("node").alias("dst"), F.col("to").alias("_y"))
        graph = graph.join(x, "src").join(y, "dst").groupBy(F.col("_x").alias("src"), F.col("_y").alias("dst")).agg(F.sum("weight").alias("weight"))
        graph = materialise(graph, "contracted")
    return nodes.join(chain, "id").select("id", F.sqrt("degree").alias("root"), "a1"), materialise(upper, "levels"), names, graph


def _each(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """id, root, a1, vector: ``f`` of the vectors of a batch, as a matrix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(f(matrix(pa.chunked_array([batch.column("vector")]))))
                ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                keep = [batch.column(c) for c in ("id", "root", "a1")]
                yield pa.RecordBatch.from_arrays([*keep, pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "root", "a1", "vector"])

    ship_package(rows.sparkSession)
    return rows.select("id", "root", "a1", "vector").mapInArrow(work, "id long, root double, a1 long, vector array<double>")


def _ritz(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, descending; coefficients of their vectors; norms of their residuals) of a space, from
    the products of its columns and of the columns the graph makes of them."""
    t = len(gram) // 2
    s, g = gram[:t, :t], gram[t:, t:]
    m = (gram[:t, t:] + gram[t:, :t]) / 2
    length = np.sqrt(np.diag(s))
    scale = np.divide(1, length, out=np.zeros(t), where=length > 0)
    power, turn = np.linalg.eigh(s * np.outer(scale, scale))
    use = power > 1e-10 * power.max()
    white = scale[:, None] * turn[:, use] / np.sqrt(power[use])
    values, axes = np.linalg.eigh(white.T @ m @ white)
    values, c = values[::-1], white @ axes[:, ::-1]
    square = ((g @ c) * c).sum(0) - 2 * values * ((m @ c) * c).sum(0) + values**2 * ((s @ c) * c).sum(0)
    return values, c, np.sqrt(np.maximum(square, 0))


def top_eigen(links: DataFrame, nodes: DataFrame, k: int, tolerance: float = 1e-6, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """(the k largest eigenvalues, descending; id, vector: their eigenvectors) of a symmetric graph.

    Locally optimal block conjugate gradients: a round multiplies one new block by the graph, and
    keeps the best vectors of a space of three blocks, the vectors, their last move and the new block,
    so what a round reads and writes is bounded. The new block is the residuals of what has not
    converged, corrected on nested groups of strongly linked nodes: on the finer levels each group by
    itself, on the coarsest, of ``COARSE`` groups at most, by its dense spectrum, whose leading vectors
    are also the start. Only products of columns and sums of the coarsest groups come to the driver.
    It ends when the residuals of all k are below ``tolerance``, so eigenvalues are right to about its square.
    """
    n = nodes.count()
    k = min(k, n)
    if not k:
        return np.zeros(0), nodes.select("id", F.array().cast("array<double>").alias("vector"))
    width = min(n, k + 2)
    placed, levels, names, coarse = _aggregates(links, nodes, min(COARSE, max(1, n // 4)), seed)
    last = names[-1]
    found = coarse.toArrow()
    ids, at = np.unique(found["src"].to_numpy(), return_inverse=True)
    dense = np.zeros((len(ids), len(ids)))
    dense[at, np.searchsorted(ids, found["dst"].to_numpy())] = found["weight"].to_numpy()
    root = np.sqrt(dense.sum(1))
    power, axes = np.linalg.eigh((dense + dense.T) / 2 / np.outer(root, root))
    spark = nodes.sparkSession

    def spread(z: np.ndarray) -> DataFrame:
        """A row for each of the coarsest groups."""
        return F.broadcast(spark.createDataFrame(pa.table({last: ids, "z": pa.array(z.tolist(), pa.list_(pa.float64()))})))

    lead = axes[:, ::-1][:, :width] / root[:, None]
    start = placed.join(levels.join(spread(lead), last).select("a1", "z"), "a1")
    noise = [F.xxhash64("id", F.lit(seed), F.lit(j)) / float(2**63) for j in range(width - lead.shape[1])]
    own = F.transform("z", lambda z: z * F.col("root"))
    block = materialise(start.select("id", "root", "a1", F.concat(own, F.array(*noise).cast("array<double>")).alias("vector")), "start")
    state, many = None, width
    turn, t, held = np.zeros((0, 0)), 0, width
    while True:
        product = _product(links, block, many).select("id", "product")
        made = block.join(product, "id")
        if state is None:
            made = made.select("id", "root", "a1", F.concat("vector", "product").alias("vector"))
        else:
            kept = _each(state, lambda x, t=t, turn=turn: np.hstack([x[:, :t] @ turn, x[:, t:] @ turn])).select("id", F.col("vector").alias("_v"))
            m = turn.shape[1]
            both = F.concat(F.slice("_v", 1, m), "vector", F.slice("_v", m + 1, m), "product")
            made = made.join(kept, "id").select("id", "root", "a1", both.alias("vector"))
        state = materialise(made, "state")
        t = turn.shape[1] + many
        values, c, residual = _ritz(summed(state, lambda x, _: x.T @ x).reshape(2 * t, 2 * t))
        if len(values) >= k and residual[:k].max() < tolerance:
            best = _each(state, lambda x, t=t, c=c: x[:, :t] @ c[:, :k]).select("id", "vector")
            return values[:k], materialise(best, "eigenvectors")
        c, values, residual = c[:, :width], values[:width], residual[:width]
        open_ = np.flatnonzero((residual >= tolerance) | (np.arange(len(values)) >= k))
        many = len(open_)
        # The last move: the vectors without what they were made of.
        move = c[:, open_].copy()
        move[:held] = 0
        turn, held = np.hstack([c, move]) if t > held else c, c.shape[1]
        rest = lambda x, t=t, c=c[:, open_], v=values[open_]: x[:, t:] @ c - x[:, :t] @ c * v
        rest = _each(state, rest)
        sums = rest.groupBy("a1").agg(*[F.sum(F.col("root") * F.col("vector")[j]).alias(f"p{j}") for j in range(many)])
        sums = materialise(sums.join(levels, "a1"), "sums")
        top = sums.groupBy(last).agg(*[F.sum(f"p{j}").alias(f"p{j}") for j in range(many)]).toPandas().set_index(last).loc[ids].to_numpy()
        solved = axes @ ((axes.T @ (top / root[:, None])) / (1 - power + SHIFT)[:, None]) / root[:, None]

        def corrected(j: int):
            finer = [F.col(f"s{i + 1}") * F.sum(f"p{j}").over(Window.partitionBy(a)) for i, a in enumerate(names[:-1])]
            return sum(finer, F.col("z")[j])

        fixes = sums.join(spread(solved), last).select("a1", F.array(*[corrected(j) for j in range(many)]).alias("fix"))
        together = F.zip_with("vector", "fix", lambda r, z: r + F.col("root") * z)
        block = materialise(rest.join(fixes, "a1").select("id", "root", "a1", together.alias("vector")), "block")


def module_count(descending: np.ndarray, n: int) -> int:
    """The number of modules by the rule that takes the largest difference of descending values, which
    is the smallest drop: two more than its place, but a tenth of the nodes, or three, at most."""
    return int(min(np.argmax(np.diff(descending)) + 2, max(3, n // 10))) if len(descending) > 1 else 1


def spectral_modules(edges: DataFrame, k: int | None = None, most: int = 8, tolerance: float = 1e-4) -> DataFrame:
    """node, module of undirected edges (src, dst, weight > 0), by the leading eigenvectors.

    Without ``k`` it is the number of Laplacian eigenvalues before the largest gap among the first
    tenth of the nodes, and ``most`` at most. Rows of the eigenvectors, scaled to length 1, are
    clustered by k-means. Graphs of no more nodes than modules fall back to connected components.
    """
    links, nodes = normalised_links(edges)
    n = nodes.count()
    if n <= (k or 2):
        return label_components(edges).select("node", F.col("component").alias("module"))
    values, vectors = top_eigen(links, nodes, k or min(most + 1, max(3, n // 10) + 1, n), tolerance)
    k = k or max(2, min(most, eigengap(1 - values, n)))
    lead = F.slice("vector", 1, k)
    length = F.sqrt(F.aggregate(lead, F.lit(0.0), lambda a, x: a + x * x))
    scaled = vectors.select("id", F.transform(lead, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0))).alias("u"))
    rows = materialise(scaled, "spectral").withColumn("features", array_to_vector("u"))
    found = KMeans(k=k, seed=42, maxIter=50, initSteps=5).fit(rows).transform(rows)
    return found.select(F.col("id").alias("node"), F.col("prediction").alias("module"))
