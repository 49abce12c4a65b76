"""MinHash near-dedup with BagMinHash: classes of documents alike in their multisets of shingles.

Two texts are linked if the multiset Jaccard similarity of their runs of five words is 0.8 or
more; classes are the connected components of links. Steps:

1. Equal texts become one node (two 64-bit hashes of the text).
2. Each node gets a BagMinHash signature of 160 registers, 32 bands of 5. Nodes that agree in a
   band share a bucket. A pair at 0.8 shares no bucket with a probability of 3 in a million.
3. In each bucket the node with the most company over all its buckets leads, and every other
   member is verified against the leader by true multiset overlap. Pairs are one per member, and
   the same pair from several bands is verified once.
4. Links give components. Buckets that still hold several components are searched through: their
   members are dealt into blocks of bounded rows and shingles, and each pair of blocks is a task
   record in which all pairs of different components are verified by a product of occurrence
   matrices; only links come out. So no link between members of a bucket is lost, however large the
   bucket.
5. Components again, over all links.

``near_links`` gives the verified links themselves, between the different texts of a class, with their
similarities; ``classes`` gives membership and counts texts and verified links.

Texts move only for nodes that have company in a bucket. A leader of many pairs has its text copied,
once for every PAIRS of them, so that a group of a third of all rows is verified by many tasks.

Defined cases. Null and empty texts, and those of white space alone, are copies of one another. A
text of one to four words has one shingle, all of them. A very long text is signed alone, whole. A null ``doc_id`` never names a class
unless a class has no other; repeated rows are copies; rows of one ``doc_id`` with unlike texts are
of different classes, each of which ``near_dedup`` keeps a row of. An empty table gives an empty table.
Columns other than ``doc_id`` and ``text`` aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.bag_min_hash import bands, occurrences, shingles, signatures
from heddle.llm.chunk_ids import groups, text_list
from heddle.llm.components import components
from heddle.workspace import materialise, ship_package

WORDS, SIMILARITY, REGISTERS, ROWS = 5, 0.8, 160, 5
#: A block's rows and shingles; pairs that one copy of a leader's text serves.
BLOCK, BLOCK_SHINGLES, PAIRS = 256, 400_000, 512


def _content(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text; all texts without a word have the same."""
    worded = F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise("")
    worded = F.coalesce(worded, F.lit(""))
    return F.xxhash64(worded), F.xxhash64(F.lit(1), worded)


def _hashed(docs: DataFrame) -> DataFrame:
    h1, h2 = _content(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), "text")


def _signed(docs: DataFrame, words: int, registers: int, rows: int) -> DataFrame:
    """doc_id, h1, h2, size (shingles), keys: the bucket of each band; no keys without a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for run in groups(text_list(batch.column("text"))):
                hashes, offsets = shingles(run, words)
                keys = bands(signatures(*occurrences(hashes, offsets), len(run), registers), rows)
                some = np.diff(offsets) > 0
                ends = np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype("int32")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))
                part = batch.slice(at, len(run))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "h1", "h2")], pa.array(np.diff(offsets), "int64"), lists], names=["doc_id", "h1", "h2", "size", "keys"])
                at += len(run)

    return docs.mapInArrow(sign, "doc_id long, h1 long, h2 long, size long, keys array<long>")


def overlaps(a: list[str], b: list[str], words: int) -> np.ndarray:
    """Multiset Jaccard similarity of a[i] and b[i]."""
    hashes, offsets = shingles([*a, *b], words)
    owner, shingle, weight = occurrences(hashes, offsets)
    n = len(a)
    order = np.lexsort((shingle, owner % n))
    pair, shingle, weight = (owner % n)[order], shingle[order], weight[order]
    same = (pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1])
    common = np.bincount(pair[1:][same], np.minimum(weight[1:], weight[:-1])[same], n)
    total = np.diff(offsets)
    union = total[:n] + total[n:] - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) that are links, and their similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = text_list(batch.column("a")), text_list(batch.column("b"))
            alike, at = [np.zeros(0)], 0
            for run in groups([x + y for x, y in zip(a, b, strict=True)]):
                alike.append(overlaps(a[at : at + len(run)], b[at : at + len(run)], words))
                at += len(run)
            alike = np.concatenate(alike)
            pairs = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(alike, "float64")], names=["u", "v", "similarity"])
            yield pairs.filter(pa.array(alike >= similarity))

    copies = pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("copies"))
    copies = materialise(copies, "copies")
    left = texts.withColumnsRenamed({"node": "u", "text": "a"}).join(copies, "u")
    left = left.select("u", "a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    right = texts.withColumnsRenamed({"node": "v", "text": "b"})
    dealt = pairs.join(copies, "u").withColumn("copy", F.pmod(F.xxhash64("v"), F.col("copies")).cast("int"))
    return dealt.join(left, ["u", "copy"]).join(right, "v").select("u", "v", "a", "b").mapInArrow(verify, "u long, v long, similarity double")


def linked_in_block(nodes: np.ndarray, roots: np.ndarray, side: np.ndarray, texts: list[str], words: int, similarity: float):
    """Links between nodes of different roots; with two sides, between the sides only.

    Occurrences of shingles that several texts have are the columns of a 0/1 matrix, some thousand
    at a time; products of it count common occurrences.
    """
    hashes, offsets = shingles(texts, words)
    owner, shingle, weight = occurrences(hashes, offsets)
    rank = np.repeat(np.arange(len(weight)), weight)
    nth = np.arange(len(rank)) - np.repeat(np.cumsum(weight) - weight, weight)
    owner, shingle = owner[rank], shingle[rank]
    order = np.lexsort((nth, shingle))
    owner, shingle, nth = owner[order], shingle[order], nth[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (nth[1:] != nth[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0) if len(column) else column
    n, common, width = len(texts), np.zeros((len(texts), len(texts)), "float32"), 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        m = np.zeros((n, width), "float32")
        m[owner[a:b], column[a:b] - k * width] = 1
        common += m @ m.T
    total = np.diff(offsets).astype("float64")
    union = total[:, None] + total[None, :] - common
    alike = common >= similarity * union - 1e-9
    alike &= np.triu(roots[:, None] != roots[None, :], 1)
    if side.any():
        alike &= side[:, None] != side[None, :]
    i, j = np.nonzero(alike)
    return nodes[i], nodes[j], common[i, j] / np.maximum(union[i, j], 1)


def _searched(members: DataFrame, texts: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """Links between members (key, node, root, n, mass) of a bucket that have different roots; mass is
    the number of shingles in the bucket."""

    def search(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
        roots, side = table.column("root").to_numpy()[at], table.column("side").to_numpy()[at]
        text = table.column("text").take(pa.array(at))
        u, v, alike = linked_in_block(nodes, roots, side, text_list(text), words, similarity)
        return pa.table({"u": pa.array(u, "int64"), "v": pa.array(v, "int64"), "similarity": pa.array(alike, "float64")})

    count = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("mass") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", count).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns(
        {"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}
    )
    return dealt.join(texts, "node").groupBy("key", "low", "high").applyInArrow(search, "u long, v long, similarity double")


def _classed(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, registers: int = REGISTERS, rows: int = ROWS, block: int = BLOCK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows; of each different text: node, h1, h2, doc_id (its least), root (its class); and
    the verified links u, v, similarity between nodes."""
    ship_package(docs.sparkSession)
    hashed = _hashed(docs)
    signed = materialise(_signed(hashed, words, registers, rows), "signed")
    nodes = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    spread = nodes.select("node", "size", F.explode("keys").alias("key"))
    crowded = materialise(spread.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("mass")).where("n > 1"), "crowded")
    members = materialise(spread.drop("size").join(crowded, "key"), "members")
    company = members.groupBy("node").agg(F.sum("n").alias("score"))
    leaders = members.join(company, "node").groupBy("key").agg((-F.max(F.struct("score", -F.col("node")))["col2"]).alias("u"))
    leaders = materialise(leaders, "leaders")
    pairs = members.join(leaders, "key").where("u <> node").select("u", F.col("node").alias("v")).distinct()
    pairs = materialise(pairs, "pairs")

    # Of several rows with the node's text only those with the node's own doc_id bring it along, and
    # of rows that repeat both, or have no doc_id, one a task goes into the shuffle.
    own = F.coalesce("doc_id", F.lit(-(2**63))).alias("_id")
    wanted = members.select("node").distinct().join(nodes.select("node", "h1", "h2", own), "node")
    wanted = materialise(wanted, "wanted")
    once = hashed.groupBy("h1", "h2", own).agg(F.first("text").alias("text"))
    # Shuffled at every size: the wanted grow with the input.
    texts = materialise(once.join(wanted.hint("merge"), ["h1", "h2", "_id"]).select("node", "text"), "texts")

    links = materialise(_verified(pairs, texts, words, similarity), "links")
    found = components(links, "u", "v", "found")
    rooted = members.where("n > 2").join(found, "node", "left").select("key", "node", "n", "mass", F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "rooted")
    mingled = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    mingled = materialise(mingled, "mingled")
    more = materialise(_searched(rooted.join(mingled, "key"), texts, words, similarity, block), "more")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more.select("u", "v")), "u", "v", "all")

    named = nodes.select("node", "h1", "h2", "doc_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A pair may share several searched buckets.
    every = links.union(more).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("similarity").alias("similarity"))
    return signed, materialise(named.select("node", "h1", "h2", "doc_id", "root"), "named"), every


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), class_id (the least doc_id of the row's class), n_texts and
    n_links (the class's different texts, and the verified links between them). ``options`` are those
    of ``_classed``."""
    signed, named, links = _classed(docs, **options)
    counted = links.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_links"))
    per_text = named.join(counted, "node", "left").groupBy("root")
    least = per_text.agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_texts"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"))
    least = materialise(least, "least")
    named = materialise(named.join(least, "root").select("h1", "h2", "class_id", "n_texts", "n_links"), "classes")
    return signed.select("doc_id", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "h1", "h2", "class_id", "n_texts", "n_links")


def near_links(docs: DataFrame, **options) -> DataFrame:
    """doc_id, other_id, similarity of each verified link, ids being the least of their texts."""
    _, named, links = _classed(docs, **options)
    ids = named.select("node", "doc_id")
    one = links.join(ids.withColumnsRenamed({"node": "u", "doc_id": "a"}), "u").join(ids.withColumnsRenamed({"node": "v", "doc_id": "b"}), "v")
    return one.select(F.least("a", "b").alias("doc_id"), F.greatest("a", "b").alias("other_id"), "similarity")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of each class: of the least doc_id, and of that the least text hash.

    Classes go by their texts' links, not by class_id, which classes without ids, or of rows that
    share an id, may have in common."""
    named = _classed(docs, **options)[1]
    stays = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")).alias("s"))
    stays = materialise(stays.select(F.col("s.doc_id").alias("_id"), F.col("s.h1").alias("_1"), F.col("s.h2").alias("_2")), "stays")
    h1, h2 = _content(F.col("text"))
    hashed = docs.withColumns({"_h1": h1, "_h2": h2})
    same = (F.col("_h1") == F.col("_1")) & (F.col("_h2") == F.col("_2")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    mine = hashed.join(stays, same)
    # Rows that repeat an id and a text are combined in their tasks before they meet.
    rest = F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    once = mine.groupBy("_h1", "_h2", "doc_id").agg(F.first("text").alias("text"), F.first(rest).alias("_rest"))
    return once.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", "n_texts", "n_links")
