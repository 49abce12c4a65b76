"""Document fingerprints: a homomorphic multiset hash of paragraphs, with lanes for likeness.

A paragraph (a line between newlines) is hashed into a wide vector. Its first eight lanes are
the eight 32-bit words of its SHA-256; they make the fingerprint an identity. The other lanes
are made for likeness. A paragraph is cut behind every word whose last code point and length add up
to a multiple of eight, some eight words apart; so cuts follow the words, not their places, and fall
in step again behind words put in or taken out. Each run between cuts, together with the run before
it, gives a 124-bit digest; 124 lanes, one per bit, count the set bits, and a last lane counts the
runs. A document's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo 2^32. So
the order of paragraphs doesn't matter, equal multisets of paragraphs have equal fingerprints, and
paragraphs are put in or taken out by adding or subtracting vectors (``combine``).

Likeness of two fingerprints: the cosine of their bit lanes, each as twice its count minus the
number of runs (digest bits are fair coins, so unrelated runs cancel out), not below 0; equal
fingerprints have 1. Strangers come out near 0, give or take the 0.09 of 124 coins.

All of it is made of built-in functions; nothing is sent to Python.

Defined cases. A null text is the empty text, one empty paragraph without runs. In the edited
text, the next document is the one with the next smaller ``doc_id``, after the smallest the one
with the largest; a null ``doc_id`` is the smallest. Rows that repeat a ``doc_id`` have the same
next document, and stand for it by their largest text. A lone document is its own next one.
Very long texts are hashed whole, in one row. Empty tables give empty tables. Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.workspace import bind, materialise

#: Identity lanes; bits of a group of a digest, and groups; code points of a cut are multiples of CUT.
IDENTITY, BITS, GROUPS, CUT = 8, 31, 4, 8
LANES = BITS * GROUPS
MODULUS = 1 << 32
#: Bits k and k + 31 of a digest, as the low and high counters of one long.
PAIR = (1 << 31) | 1
BLANK = r"[\x20\x09\x0B-\x0D]+"


def _number(hexadecimal: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(hexadecimal, at, digits), 16, 10).cast("long")


def vector(text: Column) -> Column:
    """The fingerprint of a text as array<bigint>: 8 identity lanes, 124 bit lanes, the run count."""
    text = F.coalesce(text, F.lit(""))
    digests = F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256))
    numbers = F.transform(digests, lambda d: F.array(*[_number(d, 8 * k + 1, 8) for k in range(IDENTITY)]))
    identity = F.aggregate(
        numbers, F.array(*[F.lit(0).cast("long")] * IDENTITY), lambda a, n: F.zip_with(a, n, lambda x, y: x + y)
    )
    digests = F.transform(F.flatten(F.transform(F.split(text, "\n"), _runs)), F.md5)

    def coded(at: int):
        """Two groups of 31 bits in a long: one of the 8 digits from ``at`` on, one of the 8 behind."""
        bits = lambda d, k: _number(d, k, 8).bitwiseAND(F.lit(2**BITS - 1))
        return lambda d: bits(d, at) + F.shiftleft(bits(d, at + 8), BITS)

    def counted(codes: Column) -> Column:
        counters = F.transform(
            F.sequence(F.lit(0), F.lit(BITS - 1)),
            lambda k: F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a + F.call_function("shiftrightunsigned", c, k).bitwiseAND(F.lit(PAIR))),
        )
        low = lambda c: F.transform(c, lambda x: x.bitwiseAND(F.lit(2**BITS - 1)))
        high = lambda c: F.transform(c, lambda x: F.shiftright(x, BITS))
        return bind(counters, lambda c: F.concat(low(c), high(c)))

    def lanes(d: Column) -> Column:
        return F.concat(*[bind(F.transform(d, coded(at)), counted) for at in (1, 17)], F.array(F.size(d).cast("long")))

    return F.transform(F.concat(identity, bind(digests, lanes)), lambda x: x % F.lit(MODULUS))


def _runs(paragraph: Column) -> Column:
    """Runs of words between cuts, each with the run before it, as texts."""
    ends = lambda w: (F.ascii(F.right(w, F.lit(1))) + F.char_length(w)) % CUT == 0
    words = F.array_remove(F.split(paragraph, BLANK), "")
    marked = F.array_join(F.transform(words, lambda w: F.when(ends(w), F.concat(w, F.lit("\n"))).otherwise(w)), " ")
    cut = F.array_remove(F.split(marked, "\n ?"), "")
    return bind(cut, lambda c: F.transform(c, lambda r, i: F.concat(F.coalesce(F.get(c, i - 1), F.lit("")), F.lit(" "), r)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of both multisets together, or with sign -1 of a without b."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS)))


def render(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        n, m = x[IDENTITY + LANES], y[IDENTITY + LANES]
        terms = F.zip_with(F.slice(x, IDENTITY + 1, LANES), F.slice(y, IDENTITY + 1, LANES), lambda p, q: (2 * p - n).cast("double") * (2 * q - m))
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cosine = F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def next_ids(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id -> next_id in descending order, cyclic, for distinct ids.

    Ids alone are range-partitioned; each part finds its own successors, and the last of a part
    is followed by the first of the next. Parts, not rows, are ordered in one task.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").desc_nulls_last()
    ids = docs.select("doc_id").distinct().repartitionByRange(parts, order)
    ids = materialise(ids.withColumn("part", F.spark_partition_id()), "ids")
    within = Window.partitionBy("part").orderBy(order)
    placed = ids.withColumns({"next_id": F.lead("doc_id").over(within), "last": F.row_number().over(within) == F.count("*").over(Window.partitionBy("part"))})
    firsts = ids.groupBy("part").agg(F.max("doc_id").alias("first"))
    ordered = Window.orderBy("part")
    cyclic = firsts.select(
        F.col("part").alias("_part"),
        F.when(F.row_number().over(ordered) == F.count("*").over(Window.partitionBy()), F.first("first").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .otherwise(F.lead("first").over(ordered))
        .alias("_after"),
    )
    joined = placed.join(cyclic, F.col("part") == F.col("_part"))
    return joined.select("doc_id", F.when(F.col("last"), F.col("_after")).otherwise(F.col("next_id")).alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.floor(F.char_length("text") / 2).cast("int")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    halves = base.select("doc_id", half.alias("half")).groupBy("doc_id").agg(F.max("half").alias("half"))
    pairs = next_ids(base)
    pairs = pairs.join(halves.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    wanted = pairs.select(key("doc_id").alias("of"), key("next_id").alias("key"), "half")

    keyed = base.withColumn("key", key("doc_id")).withColumn("vec", vector(F.col("text"))).repartition("key")
    # Both branches ask the same columns of ``keyed``, so its one exchange serves both.
    leading = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("text").desc(), "doc_id"))).where("_n = 1")
    heads = wanted.join(leading, "key").select(F.col("of").alias("key"), F.expr("substring(text, 1, half)").alias("head"), F.col("vec").alias("next_vec"))

    edited = keyed.join(heads, "key").withColumn("half", half)
    edited = edited.withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - half)"), F.expr("substring(head, 1, half)")))
    edited = edited.select("doc_id", "vec", "next_vec", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), vector(F.col("edited")).alias("edited_vec"))
    return edited.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        render(F.col("vec")).alias("fingerprint"),
        render(F.col("edited_vec")).alias("edited_fingerprint"),
        F.round(likeness(F.col("vec"), F.col("edited_vec")), 6).alias("near_edited"),
        F.round(likeness(F.col("vec"), F.col("next_vec")), 6).alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    number = lambda h, at, n: f"('0x' || substr({h}, {at}, {n}))::BIGINT"
    lanes = ", ".join(f"list_sum(list_transform(d, lambda x: {number('x', 8 * k + 1, 8)}))::BIGINT % {MODULUS}" for k in range(IDENTITY))
    bits = lambda c: ", ".join(f"list_sum(list_transform({c}, lambda x: (x >> {k}) & 1))::BIGINT" for k in range(2 * BITS))
    code = lambda at: f"list_transform(h, lambda h: ({number('h', at, 8)} & {2**BITS - 1}) + (({number('h', at + 8, 8)} & {2**BITS - 1}) << {BITS}))"
    runs = f"""list_transform(string_split({{t}}, E'\\n'), lambda p: list_filter(regexp_split_to_array(array_to_string(list_transform(
          list_filter(regexp_split_to_array(p, '{BLANK}'), lambda w: w <> ''),
          lambda w: CASE WHEN (unicode(right(w, 1)) + length(w)) % {CUT} = 0 THEN w || E'\\n' ELSE w END), ' '), '\\n ?'), lambda r: r <> ''))"""
    paired = "flatten(list_transform(r, lambda c: list_transform(c, lambda x, i: md5(concat(coalesce(c[i - 1], ''), ' ', x)))))"
    vec = lambda t: f"""(SELECT list_concat([{lanes}], list_transform(list_concat([{bits("a")}], [{bits("b")}], [len(h)]), lambda x: coalesce(x, 0))) FROM (
        SELECT d, h, {code(1)} AS a, {code(17)} AS b FROM (SELECT d, {paired} AS h FROM (
          SELECT list_transform(string_split({t}, E'\\n'), lambda p: sha256(p)) AS d, {runs.format(t=t)} AS r))))"""  # noqa: E731
    text = lambda v: f"array_to_string(list_transform({v}, lambda x: lpad(lower(to_hex(x)), 8, '0')), '')"
    centred = lambda v: f"list_transform({v}[{IDENTITY + 1}:{IDENTITY + LANES}], lambda x: (2 * x - {v}[{IDENTITY + LANES + 1}])::DOUBLE)"
    dot = lambda a, b: f"list_inner_product({a}, {b})"
    near = lambda v, w: f"CASE WHEN {v} = {w} THEN 1.0 WHEN len({v}) = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, CASE WHEN sqrt({dot('c' + v, 'c' + v)}) * sqrt({dot('c' + w, 'c' + w)}) > 0 THEN {dot('c' + v, 'c' + w)} / (sqrt({dot('c' + v, 'c' + v)}) * sqrt({dot('c' + w, 'c' + w)})) ELSE 0.0 END)), 6) END::DOUBLE"
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
linked AS (SELECT doc_id, text, coalesce(lead(text) OVER o, first(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nxt
  FROM base WINDOW o AS (ORDER BY doc_id DESC)),
edit AS (SELECT doc_id, text, nxt, substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2) AS edited FROM linked),
vecs AS (SELECT doc_id, text, edited, {vec("text")} AS v, {vec("edited")} AS e, {vec("nxt")} AS n FROM edit),
wide AS (SELECT *, {centred("v")} AS cv, {centred("e")} AS ce, {centred("n")} AS cn FROM vecs)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {text("v")} AS fingerprint, {text("e")} AS edited_fingerprint,
  {near("v", "e")} AS near_edited, {near("v", "n")} AS near_next FROM wide
"""


OP3_SQL = _sql()
