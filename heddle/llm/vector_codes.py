"""Vector code compression: four bytes a vector, by codebooks of parts and exact pruned search.

Method. Components x become floor(1024 x). A vector is cut into ``parts`` equal parts; each part
position has a codebook of ``entries``, which starts as that part of the ``entries`` smallest ids.
Each round assigns every part to its nearest entry and replaces entries by the floored means of
their parts; a last assignment gives codes and errors.

Nearest entries are found by annular norm pruning. Entries are sorted by norm. A part's norm r is
looked up among them by binary search, and the entries beside that place give a first best distance
d. An entry nearer than d has a norm within [r - d, r + d], ends included, so a binary search for
both ends gives the annulus, and only entries in it are evaluated. Parts are taken in order of their
norms, some hundred at a time, so that their annuli nearly coincide and are evaluated together.
All distances are whole numbers and exact: in doubles where they stay below 2^53, else in 64-bit
integers. Ties go to the lower index.

The vectors are written once as whole numbers; each round is a pass over that table, in which a task
gives one row an entry it used. Only codebooks, ``parts`` x ``entries`` rows, come to the driver.

Defined cases. Rows whose vector is null, or holds null, NaN or infinite components, are dropped.
Equal ids are ordered by their vectors, a null id comes after all others. Fewer rows than ``entries``
give so many entries. Rows that can't be coded stay, with null code and error, and take no part in
codebooks: vectors whose length isn't a positive multiple of ``parts``, or isn't that of the first
row that has such a length; and vectors with a component beyond what sums of squares in 64 bits hold
(131,072 at 64 components). Repeated rows count each. Sums of errors leave null errors out; a label
without any has a null sum. An empty table gives an empty table. Columns beyond id, vector and label
are carried; results replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.workspace import materialise, ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts evaluated together, and entries beside a part's norm that give its first best distance.
TOGETHER, BESIDE = 512, 2


class Codebook:
    """Entries of one part position, sorted by norm for the search."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, "int64")
        squares = (self.entries**2).sum(1)
        self.order = np.lexsort((np.arange(len(squares)), squares))
        self.squares = squares
        self.norms = np.sqrt(squares[self.order].astype("float64"))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each part."""
        squares = (parts**2).sum(1)
        most = max(int(squares.max(initial=0)), int(self.squares.max(initial=0)))
        kind = "float64" if 4 * most < 2**53 else "int64"
        entries, sizes, exact = self.entries.astype(kind), self.squares.astype(kind), parts.astype(kind)
        index, error = np.zeros(len(parts), "int64"), np.zeros(len(parts), "int64")
        by_norm = np.argsort(squares, kind="stable")
        for at in range(0, len(parts), TOGETHER):
            rows = by_norm[at : at + TOGETHER]
            x, xx = exact[rows], squares[rows].astype(kind)
            norm = np.sqrt(squares[rows].astype("float64"))
            place = np.searchsorted(self.norms, norm)
            best = np.full(len(rows), np.inf)
            for step in range(-BESIDE, BESIDE):
                seed = self.order[np.clip(place + step, 0, len(self.order) - 1)]
                best = np.minimum(best, xx - 2 * (x * entries[seed]).sum(1) + sizes[seed])
            # A little wider than the best distance, for the rounding of the roots.
            reach = np.sqrt(best) * (1 + 1e-9) + 1e-9 * (norm + 1)
            low = np.searchsorted(self.norms, (norm - reach).min(), "left")
            high = np.searchsorted(self.norms, (norm + reach).max(), "right")
            ring = np.sort(self.order[low:high])
            distance = xx[:, None] - 2 * (x @ entries[ring].T) + sizes[ring][None, :]
            first = distance.argmin(1)
            index[rows] = ring[first]
            error[rows] = distance[np.arange(len(rows)), first].astype("int64")
        return index, error


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype("int64")


def whole_vectors(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """``vectors`` (id, vector, ...) without unusable rows and with ``v``, the whole numbers, or null
    where a row can't be coded; and the number of components."""
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.col("vector").isNotNull()).where(good)
    sized = kept.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "vector")
    first = sized.agg(F.min(F.struct(place.alias("place"), F.size("vector").alias("n")))["n"].alias("n")).first()["n"] or 0
    most = math.isqrt(2**62 // max(first, 1)) // 2
    scaled = F.transform("vector", lambda x: x.cast("double") * SCALE)
    fits = (F.size("vector") == first) & F.lit(first > 0) & F.forall(scaled, lambda x: F.abs(x) <= most)
    return kept.withColumn("v", F.when(fits, F.transform(scaled, lambda x: F.floor(x).cast("int")))), first


def codebooks(whole: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The final entries of each part position, from ``id`` and ``v`` of all rows."""
    rows = whole.where("v IS NOT NULL").select("id", "v")
    # The entries that codebooks start from: as many rows as a codebook has.
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not seeds:
        return []
    width = length // parts
    start = np.array([r["v"] for r in seeds], "int64")
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]

    def sums(current: list[np.ndarray]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = [Codebook(b) for b in current]
            total, count = np.zeros((parts, len(start), width), "int64"), np.zeros((parts, len(start)), "int64")
            for batch in batches:
                x = _matrix(batch, length)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    index, _ = search[p].nearest(own)
                    order = np.argsort(index, kind="stable")
                    used, at = np.unique(index[order], return_index=True)
                    total[p, used] += np.add.reduceat(own[order], at, axis=0) if len(used) else 0
                    count[p] += np.bincount(index, minlength=len(start))
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, "int32"), pa.array(e, "int32"), pa.array(count[p, e], "int64"), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"]
            )

        return work

    for _ in range(rounds):
        used = rows.select("v").mapInArrow(sums(books), "part int, entry int, n long, s array<long>")
        wide = [F.sum(F.col("s")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
        means = used.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect()
        books = [b.copy() for b in books]
        for r in means:
            books[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    """sha256 of all components, by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(whole: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """``whole`` without ``v``, with ``code`` and ``error``."""
    others = [c for c in whole.columns if c not in ("v", "code", "error")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, width = [Codebook(b) for b in books], length // max(len(books), 1)
        for batch in batches:
            there = np.flatnonzero(batch.column("v").is_valid().to_numpy(zero_copy_only=False))
            code, error = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, "int64")
            if len(there) and search:
                x = batch.column("v").take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype("int64")
                found = [s.nearest(x[:, p * width : (p + 1) * width]) for p, s in enumerate(search)]
                index = np.stack([f[0] for f in found], 1).astype("uint8")
                code[there] = [i.tobytes().hex() for i in index]
                error[there] = sum(f[1] for f in found)
            missing = np.array([c is None for c in code], bool)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array(code, "string"), pa.array(error, "int64", mask=missing)], names=[*others, "code", "error"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*others).schema)
    return whole.select(*others, "v").mapInArrow(work, f"{schema}, code string, error long")


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vectors`` with code, error, label_error and codebooks_sha256. At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has a byte a part: 1 to 256 entries")
    ship_package(vectors.sparkSession)
    results = ("code", "error", "label_error", "codebooks_sha256")
    others = [c for c in vectors.columns if c not in (id, vector, label, *results)]
    named = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"), F.struct(F.lit(0).alias("_"), *others).alias("rest"))
    whole, length = whole_vectors(named, parts)
    whole = materialise(whole.drop("vector"), "whole")
    books = codebooks(whole, length, parts, entries, rounds)
    coded = materialise(encoded(whole, books, length), "codes")
    # A table of its own, so that the join may split a label that very many rows have.
    sums = materialise(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    carried = [F.col("rest")[c].alias(c) for c in others]
    return joined.select(F.col("id").alias(id), F.col("label").alias(label), *carried, "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return compress(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The rounds, unrolled, for vectors of 64 components that are all coded."""
    width = 64 // PARTS
    nearest = lambda book: (
        f"SELECT x.row, x.p, any_value(x.v) AS v, min((list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.c) + list_inner_product(b.c, b.c))::BIGINT * {ENTRIES} + b.e) AS m "
        f"FROM x JOIN {book} b ON b.p = x.p GROUP BY x.row, x.p"
    )
    steps = []
    for k in range(ROUNDS):
        steps.append(f"a{k} AS ({nearest(f'b{k}')})")
        steps.append(
            f"m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::DOUBLE[] AS c FROM (SELECT p, m % {ENTRIES} AS e, i, sum(v[i]::BIGINT)::BIGINT AS s, count(*) AS n "
            f"FROM a{k}, (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY p, e, i) GROUP BY p, e)"
        )
        steps.append(f"b{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, list_transform(embedding, lambda z: floor(z::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS (SELECT row, p, v[p * {width} + 1:p * {width} + {width}]::DOUBLE[] AS v FROM kept, (SELECT unnest(range(0, {PARTS})) AS p)),
b0 AS (SELECT p, row AS e, v AS c FROM x WHERE row < {ENTRIES}),
{", ".join(steps)},
last AS ({nearest(f"b{ROUNDS}")}),
coded AS (SELECT row, string_agg(format('{{:02x}}', m % {ENTRIES}), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM last GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), digest
"""


OP12_SQL = _sql()
