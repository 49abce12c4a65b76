"""Queries on transcripts, intents, entities, prompts and answers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.plans import adapters as A
from heddle.plans.registry import query
from heddle.workspace import materialise, table

ID = ("conv_id", "turn")
STOP = ["a", "and", "de", "die", "in", "la", "le", "of", "the", "to"]
CRUTCH = ["eh", "is", "that", "um"]
PUNCT = r"[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def conv(spark, sf):
    return A.asr(spark, sf)


def simple(name, spark_expr, sql_expr, *extra):
    """A scalar function over all transcripts."""

    @query(name, A.sql(f"SELECT conv_id, turn, {sql_expr} AS out FROM asr", "asr"))
    def run(spark, sf):
        return conv(spark, sf).select(*ID, spark_expr().alias("out"))

    return run


simple("norm_str", lambda: T.norm_str(F.col("intent")), "lower(trim(intent))")
simple("asr_length", lambda: T.asr_length(F.col("asr")), r"coalesce(len(list_distinct(list_filter(regexp_split_to_array(trim(lower(asr)), '\s+'), lambda t: t <> ''))), 0)::INT")
simple("clean_intent", lambda: T.clean_intent(F.col("intent")), "lower(replace(intent, ' ', ''))")
simple("pad_punctuation", lambda: T.pad_punctuation(F.col("asr")), r"trim(regexp_replace(regexp_replace(asr, '((?:\.{3})|[.,¡!¿?();:])', ' \1 ', 'g'), '\s{2,}', ' ', 'g'))")
simple(
    "unpad_punctuation", lambda: T.unpad_punctuation(T.pad_punctuation(F.col("asr"))),
    r"trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(asr, '((?:\.{3})|[.,¡!¿?();:])', ' \1 ', 'g'), '\s{2,}', ' ', 'g')), ' ((?:\.{3})|[.,!?);:])', '\1 ', 'g'), '([¡¿(]) ', '\1', 'g'), '\s{2,}', ' ', 'g'))",
)
simple(
    "remove_crutch_words", lambda: T.remove_words(F.col("asr"), CRUTCH),
    rf"array_to_string(list_filter(list_filter(regexp_split_to_array(trim(asr), '\s+'), lambda t: t <> ''), lambda t: NOT list_contains({CRUTCH!r}, regexp_replace(lower(t), '{PUNCT}', '', 'g'))), ' ')",
)
simple(
    "remove_stopwords", lambda: T.remove_stopwords(F.lower(F.col("asr")), STOP),
    f"array_to_string(list_filter(string_split(lower(asr), ' '), lambda t: NOT list_contains({STOP!r}, t)), ' ')",
)
_ACCENTS = "".join(chr(c) for c in range(0xC0, 0x180) if {"́", "̈"} & set(unicodedata.normalize("NFKD", chr(c))))
_BARE = "".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", c).replace("́", "").replace("̈", "")) for c in _ACCENTS)
simple("normalise_phrase", lambda: T.normalise_phrase(F.col("asr")), rf"translate(replace(lower(regexp_replace(asr, '{PUNCT}', ' ', 'g')), '  ', ' '), '{_ACCENTS}', '{_BARE}')")
simple(
    "drop_repeated_words", lambda: T.drop_repeated_words(F.regexp_replace(F.col("asr"), r"(\S+)", "$1 $1")),
    r"(SELECT array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: i = 1 OR lower(w[i]) <> lower(w[i - 1])), lambda i: w[i]), ' ') FROM (SELECT list_filter(regexp_split_to_array(trim(regexp_replace(asr, '(\S+)', '\1 \1', 'g')), '\s+'), lambda t: t <> '') AS w))",
)


def _ngrams_sql(x: str, longest: int = 2) -> str:
    """Repeated n-grams dropped from a text, by a fold over lists."""
    words = rf"string_split(trim(regexp_replace(regexp_replace({x}, '((?:\.{{3}})|[.,¡!¿?();:])', ' \1 ', 'g'), '\s{{2,}}', ' ', 'g')), ' ')"
    low = lambda y: f"list_transform({y}, lambda t: lower(t))"
    for n in range(1, longest + 1):
        y = "list_concat(a, x)"
        same = f"{low(f'{y}[len(a) + {2 - n}:]')} = {low(f'{y}[len(a) + {2 - 2 * n}:len(a) + {1 - n}]')}"
        words = f"list_reduce(list_transform({words}, lambda x: [x]), lambda a, x: CASE WHEN len(a) >= {2 * n - 1} AND {same} THEN a[:len(a) + {1 - n}] ELSE {y} END)"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(array_to_string({words}, ' '), ' ((?:\.{{3}})|[.,!?);:])', '\1 ', 'g'), '([¡¿(]) ', '\1', 'g'), '\s{{2,}}', ' ', 'g'))"


#: Repeats put into the transcripts, which hold few: of a word, of a pair, and of a pair inside a pair.
_STUTTER = (r"(\w+) (\w+), (\w+)", "{0}1 {0}2 {0}1 {0}2 {0}2 {0}1 {0}2, {0}3 {0}3")


@query("drop_repeated_ngrams", A.sql(f"SELECT conv_id, turn, {_ngrams_sql(f"regexp_replace(asr, '{_STUTTER[0]}', '{_STUTTER[1].format(chr(92))}', 'g')")} AS out FROM asr", "asr"))
def drop_repeated_ngrams(spark, sf):
    stuttered = F.regexp_replace("asr", _STUTTER[0], _STUTTER[1].format("$"))
    return conv(spark, sf).select(*ID, T.drop_repeated_ngrams(stuttered).alias("out"))


@query("intent_parts", A.sql("SELECT conv_id, turn, lower(trim(split_part(intent, '-', 1))) AS flow, lower(trim(split_part(intent, '-', -1))) AS suffix FROM asr", "asr"))
def intent_parts(spark, sf):
    return conv(spark, sf).select(*ID, T.intent_flow(F.col("intent")).alias("flow"), T.intent_suffix(F.col("intent")).alias("suffix"))


_WITHOUT_CRUTCH = rf"array_to_string(list_filter(list_filter(regexp_split_to_array(trim(asr), '\s+'), lambda t: t <> ''), lambda t: NOT list_contains({CRUTCH!r}, regexp_replace(lower(t), '{PUNCT}', '', 'g'))), ' ')"


@query("clean_transcript", A.sql(rf"""SELECT conv_id, turn, translate(replace(lower(regexp_replace(array_to_string(list_filter(string_split({_ngrams_sql(_WITHOUT_CRUTCH)}, ' '), lambda t: NOT list_contains({STOP!r}, t)), ' '), '{PUNCT}', ' ', 'g')), '  ', ' '), '{_ACCENTS}', '{_BARE}') AS out FROM asr""", "asr"))
def clean_transcript(spark, sf):
    """Crutch words, repeated n-grams, stop words, then the normal form, in this order."""
    out = T.normalise_phrase(T.remove_stopwords(T.drop_repeated_ngrams(T.remove_words(F.col("asr"), CRUTCH)), STOP))
    return conv(spark, sf).select(*ID, out.alias("out"))


@query("reply_classification", A.sql(r"""SELECT conv_id, turn, CASE WHEN substr(CASE conv_id % 3 WHEN 0 THEN 'es-ES' WHEN 1 THEN 'en-US' ELSE 'fr-FR' END, 1, 2) IN ('es', 'en')
  THEN length(asr) % 2 = 1 AND lower(trim(split_part(intent, '-', 1))) <> 'assistant' AND lower(trim(split_part(intent, '-', -1))) NOT IN ('open', 'fallback') ELSE false END AS out FROM asr""", "asr"))  # fmt: skip
def reply_classification(spark, sf):
    """The reply rule behind the language gate; a stand-in prediction from the text's length."""
    lang = F.element_at(F.array(F.lit("es-ES"), F.lit("en-US"), F.lit("fr-FR")), (F.col("conv_id") % 3 + 1).cast("int"))
    known = F.split_part(lang, F.lit("-"), F.lit(1)).isin("es", "en")
    rule = (F.char_length("asr") % 2 == 1) & (T.intent_flow(F.col("intent")) != "assistant") & ~T.intent_suffix(F.col("intent")).isin("open", "fallback")
    return conv(spark, sf).select(*ID, F.when(known, rule).otherwise(False).alias("out"))


@query("clean_entities", """SELECT event_id, upper(event_type[1]) || lower(event_type[2:]) AS topic, ' User' || user_id || ' ' || upper(event_type[1]) || lower(event_type[2:]) AS name, NULL::VARCHAR AS missing FROM events""")
def clean_entities(spark, sf):
    """Nested entities as JSON text, parsed, first values rendered; a missing key gives null."""
    from heddle.schemas import ENTITY

    e = table(spark, sf, "events")
    inner = lambda *f: F.struct(F.array(F.struct(*f)).alias("values"))
    topic = F.struct(inner(F.lit("stringValue").alias("kind"), F.col("event_type").alias("stringValue")).alias("listValue"))
    name = F.struct(inner(F.lit("structValue").alias("kind"), F.create_map(F.lit("last"), "event_type", F.lit("first"), F.concat(F.lit("user"), "user_id")).alias("structValue")).alias("listValue"))
    parsed = e.select("event_id", F.from_json(F.to_json(F.struct(topic.alias("topic"), name.alias("name"))), ENTITY).alias("x"))
    of = lambda k: T.entity_text(F.try_element_at("x", F.lit(k))["listValue"]["values"]).alias(k)
    return parsed.select("event_id", of("topic"), of("name"), of("missing"))


@query("convert_entities", """SELECT event_id, coalesce(try_cast(k AS INT)::VARCHAR, '0') AS as_int, round(try_cast(value::VARCHAR AS DOUBLE), 6) AS as_float, event_type || ', ' || k AS as_string, event_type AS as_compound
  FROM (SELECT *, props->>'k' AS k FROM events)""")  # fmt: skip
def convert_entities(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    two = F.array("event_type", "k")
    return e.select(
        "event_id", T.convert_entity(two, F.lit("int")).alias("as_int"), T.convert_entity(F.array(F.col("value").cast("string")), F.lit("float")).cast("double").alias("as_float"),
        T.convert_entity(two, F.lit("string")).alias("as_string"), T.convert_entity(F.array(F.concat_ws(" ", "event_type", "k")), F.lit("compound")).alias("as_compound"),
    )


@query("age_from_birth_date", """SELECT o_orderkey, (2004 - year(o_orderdate) - (strftime(DATE '2004-06-15', '%m%d') < strftime(o_orderdate, '%m%d'))::INT)::INT AS age FROM orders""")
def age_from_birth_date(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.age_on(F.col("o_orderdate"), F.lit("2004-06-15").cast("date")).alias("age"))


BP = "CASE WHEN c_custkey % 5 = 0 THEN '0' WHEN c_custkey % 5 < 3 THEN '[''' || (60 + c_custkey % 80) || ''']' ELSE '[''' || (60 + c_custkey % 40) || ''',''' || (100 + c_custkey % 60) || ''']' END"
_NLL = lambda p: f"(ln({p[1]}) + (x[1] - {p[0]}) ** 2 / (2 * {p[1]} ** 2))"
READINGS = f"""readings AS (SELECT c_custkey AS patient_id, CASE WHEN len(x) = 2 THEN greatest(x[1], x[2]) WHEN len(x) = 1 AND {_NLL(T.SYSTOLIC)} <= {_NLL(T.DIASTOLIC)} THEN x[1] END AS high,
  CASE WHEN len(x) = 2 THEN least(x[1], x[2]) WHEN len(x) = 1 AND {_NLL(T.SYSTOLIC)} > {_NLL(T.DIASTOLIC)} THEN x[1] END AS low
  FROM (SELECT c_custkey, CASE WHEN bp <> '0' THEN list_transform(string_split(replace(replace(replace(bp, '[', ''), ']', ''), '''', ''), ','), lambda v: v::INT) END AS x FROM (SELECT c_custkey, {BP} AS bp FROM customer)))"""


def readings(spark, sf):
    """patient_id, high, low from readings written as lists in text."""
    k = F.col("c_custkey")
    lone = F.concat(F.lit("['"), (60 + k % 80).cast("string"), F.lit("']"))
    both = F.concat(F.lit("['"), (60 + k % 40).cast("string"), F.lit("','"), (100 + k % 60).cast("string"), F.lit("']"))
    raw = table(spark, sf, "customer").select(k.alias("patient_id"), F.when(k % 5 == 0, "0").when(k % 5 < 3, lone).otherwise(both).alias("bp"))
    x = raw.select("patient_id", T.parse_pressure(F.col("bp")).alias("x"))
    a, b = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    two, one = F.size("x") == 2, F.size("x") == 1
    high = F.when(two, F.greatest(a, b)).when(one & T.is_systolic(a), a)
    low = F.when(two, F.least(a, b)).when(one & ~T.is_systolic(a), a)
    return x.select("patient_id", high.alias("high"), low.alias("low"))


@query("blood_pressure_parse", f"WITH {READINGS} SELECT patient_id, high, low FROM readings")
def blood_pressure_parse(spark, sf):
    return readings(spark, sf)


@query("blood_pressure_distribution", f"""WITH {READINGS} SELECT round(avg(high), 6) AS high_mean, round(stddev_pop(high), 6) AS high_sd, round(avg(low), 6) AS low_mean, round(stddev_pop(low), 6) AS low_sd
  FROM readings WHERE high IS NOT NULL AND low IS NOT NULL""")  # fmt: skip
def blood_pressure_distribution(spark, sf):
    r = readings(spark, sf).na.drop()
    return r.agg(*[F.round(f(c), 6).alias(f"{c}_{n}") for c in ("high", "low") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


@query("blood_pressure_impute", f"""WITH {READINGS}, fit AS (SELECT regr_slope(low::DOUBLE, high) AS s, regr_intercept(low::DOUBLE, high) AS i, regr_slope(high::DOUBLE, low) AS t, regr_intercept(high::DOUBLE, low) AS j
  FROM readings WHERE high IS NOT NULL AND low IS NOT NULL)
  SELECT patient_id, round(coalesce(high, j + t * low), 4) AS high, round(coalesce(low, i + s * high), 4) AS low, (high IS NULL) <> (low IS NULL) AS imputed FROM readings, fit""")  # fmt: skip
def blood_pressure_impute(spark, sf):
    """One linear fit for each missing side, from complete rows; rows with neither side stay empty."""
    r = readings(spark, sf)
    c = r.na.drop().select(F.col("high").cast("double").alias("h"), F.col("low").cast("double").alias("l"))
    fit = c.agg(F.regr_slope("l", "h").alias("s"), F.regr_intercept("l", "h").alias("i"), F.regr_slope("h", "l").alias("t"), F.regr_intercept("h", "l").alias("j"))
    full = r.join(F.broadcast(fit), how="cross")
    return full.select(
        "patient_id", F.round(F.coalesce("high", F.col("j") + F.col("t") * F.col("low")), 4).alias("high"), F.round(F.coalesce("low", F.col("i") + F.col("s") * F.col("high")), 4).alias("low"),
        (F.col("high").isNull() != F.col("low").isNull()).alias("imputed"),
    )


@query("blood_pressure_kernel_impute")
def blood_pressure_kernel_impute(spark, sf):
    """Rows only: the missing side by kernel ridge, parameters by tenfold cross-validation; a test
    holds the fit against that of all rows."""
    from heddle.operators.ml import kernel_ridge

    r, grid = readings(spark, sf), ([0.1, 1.0, 10.0], [0.001, 0.01])
    down, up = kernel_ridge(r, "high", "low", "patient_id", *grid)[2], kernel_ridge(r, "low", "high", "patient_id", *grid)[2]
    full = r.join(down.select(F.col("x").alias("high"), F.col("predicted").alias("_low")), "high", "left").join(up.select(F.col("x").alias("low"), F.col("predicted").alias("_high")), "low", "left")
    return full.select("patient_id", F.round(F.coalesce("high", "_high"), 4).alias("high"), F.round(F.coalesce("low", "_low"), 4).alias("low"), (F.col("high").isNull() != F.col("low").isNull()).alias("imputed"))


@query("blood_pressure_ridge")
def blood_pressure_ridge(spark, sf):
    """Rows only: the missing side by kernel ridge on sex, age and the other side, one model a side, kernel
    and parameters by tenfold cross-validation; a test holds the fits against dense ones."""
    from heddle.operators.ridge import ridge_grid

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id"), (F.col("c_custkey") % 2).alias("male"), (F.col("c_nationkey") + 40).alias("age"))
    r = materialise(readings(spark, sf).join(c, "patient_id"), "readings")
    filled = [ridge_grid(r, ["male", "age", other], side, "patient_id", [1.0, 10.0], [0.01, 0.1])[1].withColumnRenamed("predicted", f"_{side}") for side, other in (("low", "high"), ("high", "low"))]
    full = r.join(filled[0], "patient_id", "left").join(filled[1], "patient_id", "left")
    sides = [F.round(F.coalesce(side, f"_{side}"), 4).alias(side) for side in ("high", "low")]
    return full.select("patient_id", *sides, (F.col("high").isNull() != F.col("low").isNull()).alias("imputed"))


def customer_fields():
    return {"balance": F.format_string("%.2f", "c_acctbal"), "nation": F.col("c_nationkey").cast("string"), "segment": F.lower("c_mktsegment")}


_FIELDS = "'The balance is ' || printf('%.2f', c_acctbal) || '. The nation is ' || c_nationkey || '. The segment is ' || lower(c_mktsegment) || '.'"


@query("serialise_rows", f"SELECT c_custkey, 'Health values: ' || {_FIELDS} AS out FROM customer")
def serialise_rows(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.serialise_row(customer_fields()).alias("out"))


@query("prompt_pair", f"""SELECT c_custkey, 'Health values: ' || {_FIELDS} || ' Outcome: ''' || (c_custkey % 2) || '''.' AS train, 'Health values: ' || {_FIELDS} || ' Outcome:' AS test FROM customer""")
def prompt_pair(spark, sf):
    base = T.serialise_row(customer_fields())
    train = F.concat(base, F.lit(" Outcome: '"), (F.col("c_custkey") % 2).cast("string"), F.lit("'."))
    return table(spark, sf, "customer").select("c_custkey", train.alias("train"), F.concat(base, F.lit(" Outcome:")).alias("test"))


@query("fill_prompt_template", """SELECT p_partkey, replace(replace(replace(replace('Predict target_column among classes, e.g. classes[0]: features_text', 'target_column', p_brand), 'classes[0]', 'small'), 'classes', 'small, large'),
  'features_text', 'size is ' || p_size || ', price is ' || CASE WHEN p_retailprice = floor(p_retailprice) THEN floor(p_retailprice)::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END) AS out FROM part""")  # fmt: skip
def fill_prompt_template(spark, sf):
    fields = {"size": T.show_number(F.col("p_size")), "price": T.show_number(F.col("p_retailprice"))}
    values = {"target_column": F.col("p_brand"), "classes[0]": F.lit("small"), "classes": F.lit("small, large"), "features_text": T.features_text(fields)}
    out = T.fill_template(F.lit("Predict target_column among classes, e.g. classes[0]: features_text"), values)
    return table(spark, sf, "part").select("p_partkey", out.alias("out"))


CHAT = rf"""chat AS (SELECT conv_id, '{T.BEGIN}' || string_agg('{T.HEAD}' || role || '<|end_header_id|>' || chr(10) || chr(10) || trim(text) || '{T.END}', '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id)"""


@query("chat_template", f"WITH {CHAT} SELECT conv_id, body AS train, body || '{T.HEAD}assistant<|end_header_id|>' || chr(10) || chr(10) AS test FROM chat")
def chat_template(spark, sf):
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    got = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    return got.select("conv_id", T.chat_text(F.col("m"), False).alias("train"), T.chat_text(F.col("m"), True).alias("test"))


@query("few_shot_context", f"WITH {CHAT}, shots AS (SELECT string_agg(body, '' ORDER BY conv_id) AS s FROM (SELECT * FROM chat ORDER BY md5(conv_id::VARCHAR), conv_id LIMIT 2)) SELECT conv_id, s || body AS out FROM chat, shots")
def few_shot_context(spark, sf):
    """Two example conversations, picked by a digest, in front of each."""
    chat = chat_template(spark, sf).select("conv_id", F.col("train").alias("body"))
    shots = chat.orderBy(F.md5(F.col("conv_id").cast("string")), "conv_id").limit(2)
    line = shots.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("conv_id", "body"))), lambda x: x["body"]), "").alias("s"))
    return chat.join(F.broadcast(line), how="cross").select("conv_id", F.concat("s", "body").alias("out"))


_OUT = "'Outcome: ' || (o_orderkey % 3) || '. assistant Outcome: ' || (o_orderkey % 2) || ' then assistant  Outcome: ' || (o_orderkey % 4)"


def answers(spark, sf):
    k = F.col("o_orderkey")
    s = lambda n: (k % n).cast("string")
    return table(spark, sf, "orders").withColumn("answer", F.concat(F.lit("Outcome: "), s(3), F.lit(". assistant Outcome: "), s(2), F.lit(" then assistant  Outcome: "), s(4)))


@query("delete_label_value", rf"SELECT o_orderkey, regexp_replace({_OUT}, 'Outcome: \d.', 'Outcome:', 'g') AS out FROM orders")
def delete_label_value(spark, sf):
    return answers(spark, sf).select("o_orderkey", T.drop_label(F.col("answer")).alias("out"))


@query("prediction_extraction", rf"SELECT o_orderkey, regexp_extract_all({_OUT}, 'assistant\s+Outcome:\s*([01])', 1)[-1] AS out FROM orders")
def prediction_extraction(spark, sf):
    return answers(spark, sf).select("o_orderkey", T.last_outcome(F.col("answer")).alias("out"))


PATTERNS = [r"then assistant\s+Outcome:\s*([0-2])", r"answer is (\w+)"]


@query("postprocess_groundtruths", rf"SELECT o_orderkey, coalesce(CASE WHEN regexp_matches(a, '{PATTERNS[0]}') THEN regexp_extract(a, '{PATTERNS[0]}', 1) END, CASE WHEN regexp_matches(a, '{PATTERNS[1]}') THEN regexp_extract(a, '{PATTERNS[1]}', 1) END) AS out FROM (SELECT o_orderkey, {_OUT} AS a FROM orders)")
def postprocess_groundtruths(spark, sf):
    return answers(spark, sf).select("o_orderkey", T.first_group(F.col("answer"), PATTERNS).alias("out"))


@query("postprocess_predictions", rf"""SELECT o_orderkey, coalesce(g, CASE WHEN truth = '0' THEN '1' ELSE '0' END) AS value, g IS NULL AS unparsed FROM (
  SELECT o_orderkey, (o_orderkey % 2)::VARCHAR AS truth, CASE WHEN list_contains(['0', '1'], regexp_extract(regexp_replace({_OUT}, '[^\w\s:.,()\[\]\-\n]', '', 'g'), '{PATTERNS[0]}', 1))
    THEN regexp_extract(regexp_replace({_OUT}, '[^\w\s:.,()\[\]\-\n]', '', 'g'), '{PATTERNS[0]}', 1) END AS g FROM orders)""")  # fmt: skip
def postprocess_predictions(spark, sf):
    truth = (F.col("o_orderkey") % 2).cast("string")
    return answers(spark, sf).select("o_orderkey", T.prediction(F.col("answer"), PATTERNS, ["0", "1"], truth).alias("p")).select("o_orderkey", "p.value", "p.unparsed")


@query("echo_anchored_answer", rf"""SELECT o_orderkey, digit AS prediction, coalesce(digit IN ('0', '1'), false) AS parsed FROM (
  SELECT o_orderkey, CASE WHEN instr(a, p) > 0 THEN nullif(regexp_extract(substr(a, instr(a, p) + length(p)), '^\s*[''"]?(\d)', 1), '') END AS digit
  FROM (SELECT o_orderkey, {_OUT} AS a, 'assistant Outcome:' AS p FROM orders))""")  # fmt: skip
def echo_anchored_answer(spark, sf):
    """The digit after the exact prompt; rows without one are kept and marked."""
    p = "assistant Outcome:"
    rest = F.expr(f"substring(answer, instr(answer, '{p}') + {len(p)})")
    digit = F.when(F.instr("answer", p) > 0, F.nullif(F.regexp_extract(rest, r"^\s*['\"]?(\d)", 1), F.lit("")))
    return answers(spark, sf).select("o_orderkey", digit.alias("prediction"), F.coalesce(digit.isin("0", "1"), F.lit(False)).alias("parsed"))


@query("fallback_class", A.sql("SELECT row_id, list_sort(list_filter(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], lambda c: c <> y))[1] AS out FROM multi", "multi"))
def fallback_class(spark, sf):
    known = F.array(*map(F.lit, A.SEGMENTS))
    return A.multi(spark, sf).select("row_id", F.get(F.array_sort(F.array_except(known, F.array("y"))), 0).alias("out"))


@query("list_column_text", """SELECT conv_id, turn, string_split(role || ',' || lower(role), ',') AS out FROM conversations""")
def list_column_text(spark, sf):
    """Lists written as text are parsed as JSON, never evaluated."""
    written = F.concat(F.lit("['"), "role", F.lit("', '"), F.lower("role"), F.lit("']"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.from_json(F.regexp_replace(written, "'", '"'), "array<string>").alias("out"))


@query("dataset_specs", """SELECT n_name, len(string_split(n_name, '_')) = 2 AND length(n_name) > 0 AS aligned, n_name || '/' || n_regionkey AS path FROM nation""")
def dataset_specs(spark, sf):
    """Parallel lists zipped to specs; all lengths must be equal."""
    n = table(spark, sf, "nation").withColumns({"a": F.split("n_name", "_"), "b": F.array("n_name", F.col("n_regionkey").cast("string"))})
    zipped = F.arrays_zip("a", "b")
    return n.select("n_name", ((F.size("a") == F.size("b")) & (F.size(zipped) > 0)).alias("aligned"), F.concat_ws("/", "b").alias("path"))


@query("evaluation_record", A.sql("""SELECT '{"accuracy":' || printf('%.4f', avg((y = yhat)::INT)) || ',"model":"stub","rows":' || count(*) || '}' AS record FROM preds""", "preds"))
def evaluation_record(spark, sf):
    p = A.preds(spark, sf).agg(F.avg((F.col("y") == F.col("yhat")).cast("int")).alias("a"), F.count("*").alias("n"))
    return p.select(F.to_json(F.struct(F.format_string("%.4f", "a").cast("decimal(6,4)").alias("accuracy"), F.lit("stub").alias("model"), F.col("n").alias("rows"))).alias("record"))


@query("conversation_variables", """WITH last AS (SELECT max(ts) AS m FROM events), e AS (SELECT user_id, ts::DATE AS day, ts, event_id, event_type, (props->>'k')::INT AS k FROM events, last WHERE ts >= m - INTERVAL 7 DAYS),
  im(intent, var, value) AS (VALUES ('view', 'seen', 1), ('click', 'seen', 2), ('click', 'active', 1), ('purchase', 'buyer', 1), ('error', 'active', 0)),
  hits AS (SELECT user_id, day, var, value, ts, event_id, 0 AS pri FROM e JOIN im ON event_type = intent UNION ALL SELECT user_id, day, 'buyer', k, ts, event_id, 1 FROM e WHERE event_type = 'purchase' AND k IS NOT NULL),
  top AS (SELECT user_id, day, var, value FROM hits QUALIFY row_number() OVER (PARTITION BY user_id, day, var ORDER BY pri DESC, ts DESC, event_id DESC) = 1)
  SELECT e.user_id, e.day::VARCHAR AS day, coalesce(max(value) FILTER (WHERE var = 'seen'), 0)::INT AS seen, coalesce(max(value) FILTER (WHERE var = 'active'), 0)::INT AS active, coalesce(max(value) FILTER (WHERE var = 'buyer'), 0)::INT AS buyer
  FROM (SELECT DISTINCT user_id, day FROM e) e LEFT JOIN top USING (user_id, day) GROUP BY 1, 2""")  # fmt: skip
def conversation_variables(spark, sf):
    """A week's conversations as one row of variables each: intents by a mapping, entities over
    intents, later over earlier, 0 by default."""
    events = table(spark, sf, "events")
    recent = events.join(F.broadcast(events.agg(F.max("ts").alias("m"))), how="cross").where(F.col("ts") >= F.col("m") - F.expr("INTERVAL 7 DAYS"))
    e = recent.select("user_id", F.to_date("ts").cast("string").alias("day"), "ts", "event_id", "event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    rules = [("view", "seen", 1), ("click", "seen", 2), ("click", "active", 1), ("purchase", "buyer", 1), ("error", "active", 0)]
    mapping = spark.createDataFrame(rules, "event_type string, var string, value int")
    intents = e.join(F.broadcast(mapping), "event_type", "left").select("user_id", "day", "var", "value", "ts", "event_id", F.lit(0).alias("pri"))
    entities = e.where("event_type = 'purchase' AND k IS NOT NULL").select("user_id", "day", F.lit("buyer").alias("var"), F.col("k").alias("value"), "ts", "event_id", F.lit(1).alias("pri"))
    top = intents.union(entities).groupBy("user_id", "day").pivot("var", ["seen", "active", "buyer"]).agg(F.max_by("value", F.struct("pri", "ts", "event_id")))
    return top.na.fill(0)


@query("intent_map_lookup", "SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS value FROM events")
def intent_map_lookup(spark, sf):
    """Left outer lookup in a small mapping; intents without an entry keep null."""
    mapping = spark.createDataFrame([("view", 1), ("click", 2), ("purchase", 3)], "event_type string, value int")
    return table(spark, sf, "events").select("event_id", "event_type").join(F.broadcast(mapping), "event_type", "left").select("event_id", "value")


@query("recent_answered", """SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS AND event_type = 'click' AND value > 10""")
def recent_answered(spark, sf):
    e = table(spark, sf, "events")
    m = e.agg(F.max("ts").alias("m"))
    return e.where("event_type = 'click' AND value > 10").join(F.broadcast(m), how="cross").where(F.col("ts") >= F.col("m") - F.expr("INTERVAL 7 DAYS")).select("event_id", "user_id")


@query("variables_default", """SELECT c_custkey, v.var, 0 AS value FROM customer, (VALUES ('age'), ('weight'), ('pressure')) v(var)""")
def variables_default(spark, sf):
    names = F.array(*map(F.lit, ("age", "weight", "pressure")))
    return table(spark, sf, "customer").select("c_custkey", F.explode(names).alias("var"), F.lit(0).alias("value"))


@query("tfidf", r"""WITH tok AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM conversations), n AS (SELECT count(*) AS n FROM conversations),
  tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  w AS (SELECT conv_id, turn, tf.term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (term), n)
  SELECT conv_id, turn, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM w""")  # fmt: skip
def tfidf(spark, sf):
    """Smooth idf, ln((1+N)/(1+df)) + 1, and rows of unit length."""
    c = table(spark, sf, "conversations")
    tok = c.select(*ID, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0))).alias("term"))
    tf = tok.groupBy(*ID, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = tf.join(df, "term").join(F.broadcast(c.agg(F.count("*").alias("n"))), how="cross")
    w = w.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*ID)))
    return w.select(*ID, "term", F.round(F.col("w") / norm, 6).alias("weight"))


@query("positional_join", """WITH a AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings), b AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS i FROM pages) SELECT vec_id, label, page_id, url FROM a JOIN b USING (i)""")
def positional_join(spark, sf):
    """Rows met by position: an explicit index for both, then an equi-join."""
    from heddle.operators.order import with_position

    a = with_position(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "i")
    b = with_position(table(spark, sf, "pages").select("page_id", "url"), "page_id", "i")
    return a.join(b, "i").select("vec_id", "label", "page_id", "url")
