"""Quality rules: fixed base rules, then thresholds that adapt to language and source.

Method: every document's rates go into mergeable quantile sketches per (lang, source). The
sketch is a log-bucket histogram: values are counted in buckets whose bounds grow by the factor
``(1 + accuracy) / (1 - accuracy)``, so any quantile is off by ``accuracy`` of its value at most,
two sketches merge by adding counts, and the result doesn't depend on the order of merging. The
sketch of a language is the merge of its sources' sketches, that of the corpus the merge of all.

Quartiles of a small group are uncertain, so they are drawn towards its parent's: of n documents'
own quartile and the parent's, the mean with the weights n and ``prior``; a language's parent is the
corpus. That changes smoothly with n, there is no size at which another rule sets in. Fences come
from the quartiles, ``q75 + reach * spread`` above and ``q25 - reach * spread`` below (word length
only), where ``spread`` is the interquartile range, at least ``min_spread``, so that a source in
which nearly all rates are 0 doesn't lose its first document of another rate. Least spreads are such
that every fence can fall among documents that the base rules pass. Documents are then joined with
their fences and filtered.

Only documents that pass the base rules enter the sketches.

Defined cases. A null text has no words and fails the base rules. Null languages and sources are
groups of their own. Very long texts are measured whole, in one row. Repeated rows are judged row by
row. Empty tables give empty tables. Result columns replace input columns of the same name; other
columns are carried through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.words import words
from heddle.workspace import bind, materialise

MIN_WORDS, REPEAT_SHARE, WINDOW = 20, 30, 8
#: metric -> (numerator, denominator, least spread, fenced below too)
METRICS = {
    "symbol_rate": ("n_symbols", "word_chars", 0.01, False),
    "dup_line_rate": ("n_dup_lines", "n_text_lines", 0.1, False),
    "repeat_rate": ("n_repeat_words", "n_words", 0.05, False),
    "echo_rate": ("n_echoes", "n_words", 0.02, False),
    "word_length": ("word_chars", "n_words", 0.75, True),
}
ACCURACY, REACH, PRIOR = 0.01, 3.0, 200
ZERO = -100_000  # bucket of values too small to count
LEAST = 1e-6


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows in order.

    Equal hashes stand together once sorted; their positions, sorted again, give the union of
    the intervals they cover. Cost: windows x log(windows).
    """

    def from_sorted(s):
        twin = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
            F.get(s, i + 1)["h"] == x["h"], F.lit(False)
        )
        places = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))
        return bind(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - v, F.lit(WINDOW)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    return bind(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), from_sorted)


def _hashes(w: Column) -> Column:
    """From the hashes of all words: those of all windows, and how many words follow their like."""
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: a == b)
    return F.struct(
        F.when(F.size(w) >= WINDOW, windows).alias("windows"),
        F.size(F.filter(pairs, lambda same: same)).cast("long").alias("echoes"),
    )


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` plus the base columns of the rules, all long, and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines", "n_repeat_words", "n_echoes", "base_failed"]
    kept = [c for c in docs.columns if c not in made]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = docs.select(*kept, words(F.col("text")).alias("_words"), lines.alias("_lines"))
    hashed = F.transform("_words", lambda w: F.xxhash64(w))
    staged = staged.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_text_lines"),
        bind(hashed, _hashes).alias("_hashes"),
    )
    staged = staged.select("*", F.col("_hashes.windows").alias("_windows"), F.col("_hashes.echoes").alias("n_echoes"))
    staged = staged.drop("_hashes")
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    staged = staged.withColumn(
        "n_repeat_words", F.when(twice, _covered(F.col("_windows"))).otherwise(0).cast("long")
    ).drop("_windows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return staged.withColumn("base_failed", failed)


def _rate(metric: str) -> Column:
    top, bottom, _, _ = METRICS[metric]
    return F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1)).cast("double")


def sketches(measured: DataFrame, accuracy: float = ACCURACY) -> DataFrame:
    """Bucket counts: (lang, source, metric, bucket, n), one sketch per (lang, source, metric)."""
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    rates = F.array(*[F.struct(F.lit(m).alias("metric"), _rate(m).alias("x")) for m in METRICS])
    bucket = F.when(F.col("r.x") < LEAST, F.lit(ZERO)).otherwise(F.ceil(F.log(F.col("r.x")) / gamma).cast("int"))
    return (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(rates).alias("r"))
        .select("lang", "source", F.col("r.metric").alias("metric"), bucket.alias("bucket"))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, accuracy: float = ACCURACY, reach: float = REACH, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source): ``<metric>`` with the fields low and high.

    Rows of a sketch are at most the buckets between the least and the largest rate, a few
    hundred, whatever the number of documents.
    """
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    middle = 2.0 / (math.exp(gamma) + 1)
    value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(F.exp(F.col("bucket") * gamma) * middle)
    spread_of = F.coalesce(*[F.when(F.col("metric") == m, F.lit(METRICS[m][2])) for m in METRICS])

    def quartiles(keys: list[str], mark: str) -> DataFrame:
        """keys, metric, and q1, q3, n with a mark in front."""
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "metric")
        ranked = merged.select(
            *keys,
            "metric",
            value.alias("value"),
            F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
            F.sum("n").over(group).alias("total"),
        )
        at = lambda q: F.min(F.when(F.col("cum") >= q * F.col("total"), F.col("value")))
        return ranked.groupBy(*keys, "metric").agg(at(0.25).alias(f"{mark}q1"), at(0.75).alias(f"{mark}q3"), F.max("total").alias(f"{mark}n"))

    def drawn(q: str) -> Column:
        """The group's quartile drawn towards the language's, which is drawn towards the corpus's."""
        tongue = (F.col("l_n") * F.col(f"l_{q}") + prior * F.col(f"c_{q}")) / (F.col("l_n") + prior)
        return (F.col("n") * F.col(q) + prior * tongue) / (F.col("n") + prior)

    tongue = quartiles(["lang"], "l_").withColumnsRenamed({"lang": "l_lang", "metric": "l_metric"})
    near = F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))
    joined = quartiles(["lang", "source"], "").join(tongue, near).join(quartiles([], "c_"), "metric")
    own = joined.select("lang", "source", "metric", drawn("q1").alias("q1"), drawn("q3").alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), spread_of)
    bounds = F.struct((F.col("q1") - reach * spread).alias("low"), (F.col("q3") + reach * spread).alias("high"))
    return own.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, bounds)).alias(m) for m in METRICS])


def judge(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """``measured`` plus ``kept``."""
    bounds = bounds.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[F.col(m).alias(f"_{m}") for m in METRICS])
    inside = F.lit(True)
    for m, (_, _, _, below) in METRICS.items():
        inside = inside & F.coalesce(_rate(m) <= F.col(f"_{m}.high"), F.lit(True))
        if below:
            inside = inside & F.coalesce(_rate(m) >= F.col(f"_{m}.low"), F.lit(True))
    same = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    joined = measured.join(bounds, same, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("_l", "_s", *[f"_{m}" for m in METRICS])


def quality_rules(
    docs: DataFrame, accuracy: float = ACCURACY, reach: float = REACH, prior: int = PRIOR, keep_text: bool = True
) -> DataFrame:
    """``docs`` plus the measures, ``base_failed`` and ``kept``.

    Rows are measured once and written to the shared folder, without the text unless ``keep_text``.
    The sketches then read the measures' columns alone, and the filter reads what is asked of it.
    """
    measured = measure(docs.select([c for c in docs.columns if c != "kept"]))
    measured = materialise(measured if keep_text else measured.drop("text"), "measures")
    bounds = materialise(fences(sketches(measured, accuracy), accuracy, reach, prior), "fences")
    return judge(measured, bounds)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    judged = quality_rules(docs, keep_text=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _op8_sql() -> str:
    gamma = math.log((1 + ACCURACY) / (1 - ACCURACY))
    middle = 2.0 / (math.exp(gamma) + 1)
    rate = {m: f"{t}::DOUBLE / greatest({b}, 1)::DOUBLE" for m, (t, b, _, _) in METRICS.items()}
    bucket = lambda m: f"CASE WHEN {rate[m]} < {LEAST} THEN {ZERO} ELSE ceil(ln({rate[m]}) / {gamma!r})::INT END"
    points = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {bucket(m)} AS bucket FROM m WHERE NOT base_failed" for m in METRICS)
    spread = "CASE metric " + " ".join(f"WHEN '{m}' THEN {x[2]}" for m, x in METRICS.items()) + " END"
    inside = " AND ".join(
        [f"coalesce({rate[m]} <= {m}.high, true)" for m in METRICS]
        + [f"coalesce({rate[m]} >= {m}.low, true)" for m, x in METRICS.items() if x[3]]
    )
    joins = " ".join(
        f"LEFT JOIN chosen {m} ON {m}.metric = '{m}' AND {m}.lang IS NOT DISTINCT FROM d.lang AND {m}.source IS NOT DISTINCT FROM d.source"
        for m in METRICS
    )

    def quartiles(keys: str) -> str:
        group = f"{keys}, metric" if keys else "metric"
        return f"""SELECT {group}, max(total) AS n, min(value) FILTER (WHERE cum >= 0.25 * total) AS q1,
          min(value) FILTER (WHERE cum >= 0.75 * total) AS q3 FROM (
          SELECT {group}, CASE WHEN bucket = {ZERO} THEN 0.0 ELSE exp(bucket * {gamma!r}) * {middle!r} END AS value,
            sum(n) OVER (PARTITION BY {group} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS cum,
            sum(n) OVER (PARTITION BY {group}) AS total
          FROM (SELECT {group}, bucket, count(*) AS n FROM points GROUP BY {group}, bucket)) GROUP BY {group}"""

    drawn = lambda q: f"(o.n * o.{q} + {PRIOR} * ((t.n * t.{q} + {PRIOR} * c.{q}) / (t.n + {PRIOR})::DOUBLE)) / (o.n + {PRIOR})::DOUBLE"
    return rf"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), E'\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM base WHERE len(words) >= {WINDOW})),
twice AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n >= 2),
repeats AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM twice GROUP BY doc_id),
m0 AS (
  SELECT b.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_text_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_echoes
  FROM base b LEFT JOIN repeats r ON r.doc_id = b.doc_id),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed FROM m0),
points AS ({points}),
own AS ({quartiles("lang, source")}), tongue AS ({quartiles("lang")}), corpus AS ({quartiles("")}),
bounds AS (
  SELECT o.lang, o.source, o.metric, {drawn("q1")} AS q1, {drawn("q3")} AS q3
  FROM own o JOIN tongue t ON t.metric = o.metric AND t.lang IS NOT DISTINCT FROM o.lang JOIN corpus c ON c.metric = o.metric),
chosen AS (
  SELECT lang, source, metric, q1 - {REACH} * greatest(q3 - q1, {spread}) AS low, q3 + {REACH} * greatest(q3 - q1, {spread}) AS high
  FROM bounds)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {inside} AS kept
FROM m d {joins}
"""


OP8_SQL = _op8_sql()
