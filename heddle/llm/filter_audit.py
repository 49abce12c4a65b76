"""Filter interaction audit: what each of five filters removes, in every order they can be applied.

Method. Documents get a failure flag a filter. Per part (language) the joint-failure counts J(S) of
all 32 sets S of filters are sums of products of flags: one pass, map-side combined, with the
documents labelled good and toxic counted beside all. All else is inversion of those 32 numbers:

- survivors of a set P of filters: the sum of (-1)^|T| J(T) over T inside P;
- documents that fail exactly S: the sum of (-1)^|T - S| J(T) over T around S (Moebius), which for
  one filter are its unique failures;
- a step removes the survivors before it less those after it, and is redundant for the rest of J;
- Shapley values: the game is "documents removed by a set", whose Harsanyi dividends are
  (-1)^(|T| + 1) J(T); a filter's value is the sum of its sets' dividends, each shared out equally.
  Times 120, so that it is the sum over all orders and a whole number.

Filters (words are maximal ``[^\\x20\\x09-\\x0D]+``): A fewer than 100 words; B distinct words below
80 % of words; C capitals ``[A-Z]`` above 10 % of code points; D any of ``[#$%&*|]``; E the text of a
smaller ``doc_id`` again. Rows are first counted by (text, doc_id, part), so a text or an id that
holds a third of all rows is combined before it is shuffled; whether a smaller id has the text is
a join on text and id, which meets the first holders only.

Defined cases. A null or empty text is an empty text: it fails A, passes B, C and D. A null ``doc_id``
is smaller than all others, is no copy of another null one, and has no labels. Rows that repeat an
id and a text aren't copies of one another; each is counted. Several labels of a document count
if any is 1. A null lang is the part "", as is an empty one. A very long text is measured alone,
whole. An empty table gives an empty table. Columns beyond those named aren't read, so their names
can't clash.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.words import words
from heddle.workspace import bind, materialise

FILTERS = "ABCDE"
SETS = range(2 ** len(FILTERS))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10


def _flags(text: Column) -> Column:
    """Struct of the failures that a text shows by itself."""
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    measured = bind(words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    return bind(
        measured,
        lambda m: F.struct(
            (m["n"] < MIN_WORDS).alias("A"),
            (100 * m["d"] < MIN_DISTINCT * m["n"]).alias("B"),
            (100 * capitals.cast("long") > MAX_CAPITALS * F.char_length(text)).alias("C"),
            text.rlike("[#$%&*|]").alias("D"),
        ),
    )


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A, B, C, D, E (0 or 1), n (rows), good, toxic (0 or 1)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        _flags(text).alias("f"),
    )
    own = [F.col(f"f.{k}").cast("int").alias(k) for k in "ABCD"]
    counted = rows.select("doc_id", "part", "h1", "h2", *own).groupBy("doc_id", "part", "h1", "h2", *"ABCD").agg(F.count("*").alias("n"))
    counted = materialise(counted, "counted")

    # Nulls come first: no id is below the least long.
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    first = counted.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.lit(0).alias("again"))
    marked = counted.withColumn("place", place).join(first, ["h1", "h2", "place"], "left").withColumn("E", F.coalesce("again", F.lit(1)))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = known.agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    labelled = marked.select("doc_id", "part", *FILTERS, "n").join(known, "doc_id", "left")
    return labelled.select("part", *FILTERS, "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _inside(mask: int) -> list[str]:
    return [k for i, k in enumerate(FILTERS) if mask >> i & 1]


def joint_failures(rows: DataFrame) -> DataFrame:
    """part, and arrays ``n``, ``good``, ``toxic`` whose element S is J(S), bit i of S being filter i."""
    weigh = {"n": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    product = lambda mask, w: reduce(lambda a, k: a * F.col(k), _inside(mask), w)
    sums = [F.sum(product(s, w)).alias(f"{name}_{s}") for name, w in weigh.items() for s in SETS]
    return rows.groupBy("part").agg(*sums).select("part", *[F.array(*[F.col(f"{name}_{s}") for s in SETS]).alias(name) for name in weigh])


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0).cast("long"))


def _sign(size: int) -> int:
    return -1 if size % 2 else 1


def _survivors(joint: str) -> Column:
    """Element P: what passes all filters of P."""
    subsets = lambda p: [t for t in SETS if t & p == t]
    return F.array(*[_total([_sign(t.bit_count()) * F.col(joint)[t] for t in subsets(p)]) for p in SETS])


def _unique(joint: str) -> Column:
    """Element i: what fails filter i and no other."""
    around = lambda s: [t for t in SETS if t & s == s]
    return F.array(*[_total([_sign((t & ~s).bit_count()) * F.col(joint)[t] for t in around(s)]) for s in (1 << i for i in range(len(FILTERS)))])


def _shapley(joint: str) -> Column:
    """Element i: 120 times the Shapley value of filter i, from the dividends of its sets."""
    dividend = lambda t: _sign(t.bit_count() + 1) * F.col(joint)[t]
    held = lambda i: [t for t in SETS if t >> i & 1]
    return F.array(*[_total([len(ORDERS) // t.bit_count() * dividend(t) for t in held(i)]) for i in range(len(FILTERS))])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step: see the module. Counts are long."""
    joint = materialise(joint_failures(flagged(docs, labels)), "joint")
    steps = []
    for order in ORDERS:
        before = 0
        for k, name in enumerate(order):
            i = FILTERS.index(name)
            steps.append({"filter_order": order, "step": k + 1, "i": i, "own": 1 << i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    # 600 steps a part, whatever the input.
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, i int, own int, before int, after int>>")
    inverted = joint.select(
        "part",
        F.col("n").alias("failing"),
        _survivors("n").alias("kept_by"),
        _unique("n").alias("unique"),
        _shapley("n").alias("value"),
        _survivors("good").alias("good_by"),
        _survivors("toxic").alias("toxic_by"),
    )
    rows = inverted.select("*", F.inline(plan))
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return rows.select(
        "part", "filter_order", "step", F.get("kept_by", F.col("after")).alias("kept"), lost("kept_by").alias("removed"),
        (F.get("failing", F.col("own")) - lost("kept_by")).alias("redundant"),
        F.get("unique", F.col("i")).alias("unique_fails"), lost("good_by").alias("good_lost"), lost("toxic_by").alias("toxic_lost"),
        F.get("value", F.col("i")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


OP11_SQL = r"""
WITH d0 AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
d1 AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    (SELECT min(doc_id) FROM d0 e WHERE e.text = d0.text) AS first_id FROM d0),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d1.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (d1.doc_id > first_id)::INT AS mask
  FROM d1 LEFT JOIN l ON l.doc_id = d1.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
k AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT list_reduce(list_transform(p, lambda x: substr('ABCDE', x + 1, 1)), lambda a, b: a || b) AS filter_order, step, p[step] AS i,
    list_sum(list_transform(p[1:step - 1], lambda x: (1 << x)::BIGINT))::BIGINT AS earlier FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
t AS (SELECT filter_order, step, i, coalesce(earlier, 0)::BIGINT AS earlier, (1 << i)::BIGINT AS own FROM s),
r AS (SELECT part, filter_order, step, i,
    coalesce(sum(n) FILTER (WHERE mask & (earlier | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & earlier <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
  FROM c, t GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM r
"""
