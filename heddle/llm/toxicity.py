"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features (``toxic_features``): densities of a lexicon's words, nearness to second-person words,
capitals, punctuation and obfuscation rates. The lexicon is a fixed list of insults and the terms
(words and prefixes) that labelled training rows show to mark toxic texts.

Learning uses a bounded sample, ``train_rows`` labelled rows with the least hashes of doc_id and text
(of rows that repeat both one is taken, so no id can fill more than the sample), and none of the rows
held out (crc32 of doc_id as text, mod 3, is 1). It is cross-fitted in three
folds: a row's features come from a lexicon, and its calibration score from trees, that haven't
seen its label. Scoring covers all documents. doc_id, lang, source and labels aren't features.

The lexicon has all terms that pass the test of evidence; the bounded sample bounds it.

Defined cases. Null and empty texts are scored like any text without words. A null ``doc_id`` isn't
held out and is never learned from. Several labels of a document count as toxic if any is. Null
labels are ignored. Repeated rows of a document are learned from once, and each scored. Training
rows of one label only, or none, have nothing to tell labels apart by: all documents score the share
of toxic ones, (toxic + 1) / (rows + 2). A very long text is measured alone, whole. An empty table
gives an empty table. Columns beyond those named aren't read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.boosting import Boosted, Isotonic
from heddle.llm.chunk_ids import groups, text_list
from heddle.llm.toxic_features import NAMES, Features, document_terms
from heddle.workspace import materialise, ship_package

TRAIN_ROWS, FOLDS, THRESHOLD = 20_000, 3, 0.7


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic, fold of the sampled labelled rows."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    fold = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(FOLDS)).cast("int")
    picked = materialise(picked.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), fold.alias("fold")), "picked")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "text", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    keys = ["doc_id", "h1", "h2"]
    # Any of the ids may have any number of rows: they are told apart, and limited, by their hashes.
    chosen = rows.select(*keys).join(F.broadcast(picked), "doc_id").distinct().orderBy(F.xxhash64(*keys), *keys).limit(most)
    chosen = materialise(chosen, "chosen")
    # At most ``most`` rows of numbers are broadcast, and as many rows stay.
    found = rows.join(F.broadcast(chosen), keys).groupBy(*keys).agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"), F.first("fold").alias("fold"))
    return materialise(found.select("text", "toxic", "fold"), "training")


def lexicons(rows: DataFrame, least_evidence: float = 4.0) -> list[frozenset[str]]:
    """FOLDS lexicons, each without one fold, and one of all rows.

    Evidence of a term: the log-likelihood ratio of the share of toxic documents among its own
    against that of all, less the log of the number of terms tried.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic, fold = text_list(batch.column("text")), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist()
            at = 0
            for run in groups(texts):
                seen: Counter = Counter()
                for t, y, f in zip(run, toxic[at:], fold[at:], strict=False):
                    seen.update([(w, 2 * f + y) for w in document_terms(t)])
                at += len(run)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in seen], "string"), pa.array([k[1] for k in seen], "int32"), pa.array(list(seen.values()), "int64")],
                    names=["term", "cell", "n"],
                )

    cells = rows.groupBy().pivot("fold", list(range(FOLDS))).agg(F.sum(1 - F.col("toxic")).alias("0"), F.sum("toxic").alias("1")).first()
    totals = np.array([[cells[f"{f}_0"] or 0, cells[f"{f}_1"] or 0] for f in range(FOLDS)], float)
    one = lambda c: F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}")
    counted = rows.mapInArrow(count, "term string, cell int, n long").groupBy("term").agg(*map(one, range(2 * FOLDS)))
    counted = materialise(counted, "terms")
    tried = max(1, counted.count())
    found = []
    for left_out in [*range(FOLDS), None]:
        use = [f for f in range(FOLDS) if f != left_out]
        neg_all, pos_all = totals[use].sum(0)
        share = min(max(pos_all / max(1.0, neg_all + pos_all), 1e-3), 0.5)
        pos, neg = (sum(F.col(f"c{2 * f + y}") for f in use).cast("double") for y in (1, 0))
        both = pos + neg
        # Of two kinds of documents as common as each other, so that the shares compare.
        ratio = pos * F.log(pos / both / share) + F.when(neg > 0, neg * F.log(neg / both / (1 - share))).otherwise(0.0)
        kept = counted.where((pos >= 3) & (pos / both >= 0.6)).select("term", (ratio - math.log(tried)).alias("evidence"))
        # Terms of at most ``train_rows`` documents, each in three or more of them.
        found.append(frozenset(r["term"] for r in kept.where(F.col("evidence") >= least_evidence).collect()))
    return found


class Scorer:
    """Trees, calibration and lexicon; texts -> scores. Without trees every text scores ``share``."""

    def __init__(self, lexicon: frozenset[str], trees: Boosted | None, steps: Isotonic | None, share: float = 0.0):
        self.lexicon, self.trees, self.steps, self.share, self.features = lexicon, trees, steps, share, None

    def __getstate__(self):
        return self.__dict__ | {"features": None}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        if self.features is None:
            self.features = Features(self.lexicon)
        raw = self.trees.raw(self.features(texts))
        # The raw score keeps order within a step of the calibration.
        return np.clip(0.999 * self.steps(raw) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    ship_package(docs.sparkSession)
    rows = training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), train_rows)
    counts = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    toxic = counts["pos"] or 0
    if not 0 < toxic < counts["n"]:
        return Scorer(frozenset(), None, None, (toxic + 1) / (counts["n"] + 2))
    words = lexicons(rows)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [Features(w) for w in words[:FOLDS]]
        for batch in batches:
            fold, texts = batch.column("fold").to_numpy(), text_list(batch.column("text"))
            x = np.zeros((len(texts), len(NAMES)))
            for f in range(FOLDS):
                at = np.flatnonzero(fold == f)
                x[at] = makers[f]([texts[i] for i in at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("fold"), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "fold", "x"]
            )

    # At most ``train_rows`` rows of as many numbers as there are features.
    table = rows.mapInArrow(featurise, "toxic int, fold int, x array<double>").toPandas()
    x, y, fold = np.stack(table["x"]), table["toxic"].to_numpy(float), table["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    raw = np.zeros(len(y))
    for f in range(FOLDS):
        out = fold == f
        if out.any() and 0 < y[~out].sum() < (~out).sum():
            raw[out] = Boosted().fit(x[~out], y[~out]).raw(x[out])
    return Scorer(words[-1], Boosted().fit(x, y), Isotonic.fit(raw, y))


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # the terms and the trees

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = own(text_list(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, "float64")], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(work, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
