"""Chat formatting: tool calls linked to their results, ordered, validated, and serialised.

Calls and results are two tables. Steps, all with built-in functions:

- Link: calls and results meet in a hash join on conversation and identifier; an identifier may
  recur in other conversations. Of several calls or results with one identifier the first (by turn,
  then content) counts; the others are marked and keep rows of their own.
- Order: a call may depend on results of other calls of its conversation. Its level is the length
  of the longest chain of dependencies below it. Chains of single dependencies are followed by
  pointer doubling; calls with several are placed level by level, each by a join with the calls just
  placed. Calls on or above a cycle, and only they, stay without level. Dependencies on identifiers
  that no call has don't hold a call back and are counted. ``position`` numbers the calls of a
  conversation from 1 by (level, turn, call_id), so that each stands behind those it depends on.
- Validate: arguments must be a JSON object whose fields have the types, bounds and presence that
  the schema of the call's name asks for; the first fault is named.
- Serialise: canonical JSON, UTF-8 with sorted keys and no white space.

One row per call, and one per identifier of results that no call has; ``further_results`` gives the
results that these rows don't hold, so that no content is lost. No conversation is gathered in one
place, however long it is: positions are counted by ranges of rows.

Schemas: ``{name: {field: {"type": "string" | "integer" | "number" | "boolean" | "array" | "object",
"required": bool, "min": n, "max": n}}}``; bounds are for numbers, or the length of strings.

Defined cases. A null identifier or conversation links with nothing; such calls are open, without
level and position, such results orphans. Null arguments are no JSON object. A call of unknown or
null name is invalid. Null turns come first, null results are results with a null content. Repeated
rows are duplicates of their identifier. Very long texts stay in their rows and are validated and
serialised whole. Empty tables give empty tables. Only the named columns are read, so others can't
clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.workspace import materialise, scratch_path

TYPES = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|INT|SMALLINT|TINYINT)$",
    "number": r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY.*$",
    "object": r"^OBJECT.*$",
}


def fault(name: Column, arguments: Column, schemas: dict) -> Column:
    """The first fault of a call, null if it has none."""
    value = F.try_parse_json(arguments)
    tests = [F.when(value.isNull() | ~F.coalesce(F.schema_of_variant(value), F.lit("")).startswith("OBJECT"), "arguments are no object")]
    for call, fields in sorted(schemas.items()):
        for field, rule in sorted(fields.items()):
            got = F.try_variant_get(value, f"$.{field}", "variant")
            kind, own = F.schema_of_variant(got), name == call
            absent = got.isNull() | (kind == "VOID")
            if rule.get("required"):
                tests.append(F.when(own & absent, f"{field} is missing"))
            tests.append(F.when(own & ~absent & ~kind.rlike(TYPES[rule["type"]]), f"{field} is no {rule['type']}"))
            if rule["type"] == "string":
                amount = F.char_length(F.try_variant_get(value, f"$.{field}", "string")).cast("double")
            else:
                amount = F.try_variant_get(value, f"$.{field}", "double")
            if "min" in rule:
                tests.append(F.when(own & ~absent & (amount < rule["min"]), f"{field} is below {rule['min']}"))
            if "max" in rule:
                tests.append(F.when(own & ~absent & (amount > rule["max"]), f"{field} is above {rule['max']}"))
    unknown = F.when(name.isNull() | ~name.isin(*sorted(schemas)), "unknown name")
    return F.coalesce(unknown, *tests)


def _chased(steps: DataFrame) -> DataFrame:
    """call_id, root, steps: where each chain of single dependencies ends, and how far that is.

    ``steps``: call_id, on, of calls with one dependency. Every round a call takes over the pointer
    of the call it points to, so rounds grow with the logarithm of the longest chain. A round in
    which no chain ends leaves none but those on or above a cycle; they are not in the result.
    """
    single = steps.select(F.col("call_id").alias("on"), F.lit(True).alias("_more"))
    state = steps.join(single, "on", "left").select("call_id", F.col("on").alias("root"), F.lit(1).alias("steps"), F.col("_more").isNull().alias("ended"))
    state = materialise(state, "pointers")
    ended, going = [state.where("ended").drop("ended")], state.where("NOT ended").drop("ended")
    while not going.isEmpty():
        known = reduce(DataFrame.unionByName, [part.withColumn("ended", F.lit(True)) for part in ended], going.withColumn("ended", F.lit(False)))
        by = known.select(F.col("call_id").alias("root"), F.col("root").alias("_root"), F.col("steps").alias("_steps"), "ended")
        moved = going.join(by, "root").select("call_id", F.col("_root").alias("root"), (F.col("steps") + F.col("_steps")).alias("steps"), "ended")
        moved = materialise(moved, "pointers")
        if moved.where("ended").isEmpty():
            break
        ended.append(moved.where("ended").drop("ended"))
        going = moved.where("NOT ended").drop("ended")
    return reduce(DataFrame.unionByName, ended)


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level, lost (dependencies without a call), of calls with distinct identifiers.

    Chains of single dependencies are cut short first; what is left are the calls with several, and
    those go level by level until no call is freed, however many levels that takes. So a level is
    null on or above a cycle and nowhere else.
    """
    spark = calls.sparkSession
    ids = calls.select("call_id")
    wants = calls.select("call_id", F.explode(F.array_distinct("depends_on")).alias("on")).where("`on` IS NOT NULL")
    edges = wants.join(ids.withColumnRenamed("call_id", "on").withColumn("_there", F.lit(True)), "on", "left")
    edges = materialise(edges.select("call_id", "on", F.col("_there").isNull().alias("lost")), "edges")
    degree = edges.groupBy("call_id").agg(F.sum((~F.col("lost")).cast("long")).alias("degree"), F.sum(F.col("lost").cast("long")).alias("lost"))
    nodes = ids.join(degree, "call_id", "left").select("call_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("lost", F.lit(0)).alias("lost"))
    nodes = materialise(nodes, "nodes")
    live = edges.where("NOT lost").join(nodes.select("call_id", "degree"), "call_id")
    chased = materialise(_chased(live.where("degree = 1").select("call_id", "on")), "chased")

    # Placed calls are gathered in one folder, so that the plan doesn't grow with the levels.
    path = scratch_path(spark, "placed")
    fresh = nodes.where("degree = 0").select("call_id", F.lit(0).alias("level"))
    fresh.write.parquet(path)
    waiting = nodes.where("degree > 1").select("call_id", "degree", F.lit(0).alias("best"))
    if not waiting.isEmpty():
        ends = chased.select(F.col("call_id").alias("on"), "root", "steps")
        hops = live.where("degree > 1").join(ends, "on", "left")
        hops = materialise(hops.select("call_id", F.coalesce("root", "on").alias("root"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "hops")
        while not fresh.isEmpty():
            # Of each level only the calls it may release are looked at: those it has edges to.
            reached = hops.join(fresh.withColumnRenamed("call_id", "root"), "root").groupBy("call_id")
            freed = reached.agg(F.count("*").alias("freed"), F.max(F.col("level") + F.col("steps")).alias("reach"))
            left = waiting.join(freed, "call_id", "left").select(
                "call_id", (F.col("degree") - F.coalesce("freed", F.lit(0))).alias("degree"), F.greatest("best", "reach").alias("best")
            )
            left = materialise(left, "left")
            fresh = left.where("degree = 0").select("call_id", F.col("best").alias("level"))
            fresh.write.mode("append").parquet(path)
            waiting = left.where("degree > 0")
    placed = spark.read.schema("call_id string, level int").parquet(path)
    below = placed.select(F.col("call_id").alias("root"), F.col("level").alias("_level"))
    ranked = placed.unionByName(chased.join(below, "root").select("call_id", (F.col("_level") + F.col("steps")).alias("level")))
    return nodes.select("call_id", "lost").join(ranked, "call_id", "left").select("call_id", "level", "lost")


def _prefix() -> Column:
    """What makes an identifier one of its conversation; null without a conversation."""
    conv = F.col("conv_id").cast("string")
    return F.concat(F.char_length(conv).cast("string"), F.lit(":"), conv, F.lit(":"))


def positions(ranked: DataFrame) -> DataFrame:
    """key, position: the place of each call in its conversation by (level, turn, call_id).

    Rows are dealt by ranges of that order. A row's position is its rank within its range and
    conversation, and the rows its conversation has in ranges before; a conversation that holds
    a third of all calls is spread over as many ranges as its rows fill.
    """
    order = ["conv_id", "level", "turn", "call_id"]
    dealt = ranked.select("key", *order).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    rank = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("level", "turn", "call_id"))
    # At most one row per range and conversation.
    sums = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = dealt.withColumn("rank", rank).join(offsets, ["conv_id", "part"])
    return placed.select("key", (F.col("rank") + F.col("offset")).alias("position"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """conv_id, turn, call_id, name, kind, level, position, lost, n_results, error, canonical.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), depends_on array<string>.
    ``results``: conv_id, turn, call_id, content. ``kind`` is linked, open (no result), duplicate,
    or orphan (results without a call; turn and name are null).
    """
    prefix = _prefix()
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on", F.concat(prefix, "call_id").alias("key"))
    own = F.struct("turn", "name", "arguments")
    first = calls.where("key IS NOT NULL").groupBy("key").agg(
        F.min(F.struct(own.alias("o"), "depends_on")).alias("f"), F.count("*").alias("copies"), F.first("conv_id").alias("conv_id"), F.first("call_id").alias("call_id")
    )
    keyed = F.transform(F.coalesce("f.depends_on", F.array()), lambda d: F.concat(prefix, d))
    distinct = materialise(first.select("key", "conv_id", "call_id", "f.o.turn", "f.o.name", "f.o.arguments", keyed.alias("depends_on"), "copies"), "calls")
    placed = materialise(levels(distinct.select(F.col("key").alias("call_id"), "depends_on")).withColumnRenamed("call_id", "key"), "levels")
    ranked = placed.where("level IS NOT NULL").join(distinct.select("key", "conv_id", "turn", "call_id"), "key")
    answers = results.select("conv_id", "turn", "call_id", "content", F.concat(prefix, "call_id").alias("key")).where("key IS NOT NULL")
    answers = answers.groupBy("key").agg(
        F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n_results"), F.first("conv_id").alias("_conv"), F.first("call_id").alias("_call")
    )
    linked = distinct.join(placed, "key").join(positions(ranked), "key", "left").join(answers, "key", "full")
    linked = linked.withColumns({"conv_id": F.coalesce("conv_id", "_conv"), "call_id": F.coalesce("call_id", "_call")})
    # Calls beyond the first of their identifier keep their own fields but are not linked.
    shared = distinct.where("copies > 1").select("key", own.alias("first"))
    same = calls.join(shared, "key").groupBy("key", "conv_id", "call_id", "turn", "name", "arguments", "first").agg(F.count("*").alias("n"))
    later = same.withColumn("n", F.col("n") - own.eqNullSafe(F.col("first")).cast("int")).where("n > 0")
    extra = later.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("conv_id", "turn", "call_id", "name", "arguments")
    bare = calls.where("key IS NULL").select("conv_id", "turn", "call_id", "name", "arguments")
    kind = F.when(F.col("copies").isNull(), "orphan").when(F.col("n_results").isNull(), "open").otherwise("linked")
    main = linked.select("conv_id", "turn", "call_id", "name", "arguments", kind.alias("kind"), "level", "position", "lost", F.coalesce("n_results", F.lit(0)).alias("n_results"), "answer")
    null = lambda kind: F.lit(None).cast(kind)
    blank = {"level": null("int"), "position": null("long"), "lost": null("long"), "n_results": F.lit(0).cast("long"), "answer": null(main.schema["answer"].dataType)}
    more = extra.withColumns({"kind": F.lit("duplicate"), **blank}).unionByName(bare.withColumns({"kind": F.lit("open"), **blank}))
    rows = main.unionByName(more.select(*main.columns))
    error = F.when(F.col("kind") != "orphan", fault(F.col("name"), F.col("arguments"), schemas))
    return rows.withColumns({"error": error, "canonical": _canonical(F.col("answer.content"))}).select(*COLUMNS)


COLUMNS = ["conv_id", "turn", "call_id", "name", "kind", "level", "position", "lost", "n_results", "error", "canonical"]


def further_results(results: DataFrame) -> DataFrame:
    """The results that no row of ``link_tool_calls`` holds, a row each, in its columns.

    ``kind`` is duplicate_result for those beyond the first of their identifier, and orphan for
    those without identifier or conversation; ``turn`` is the result's own.
    """
    results = results.select("conv_id", "turn", "call_id", "content", F.concat(_prefix(), "call_id").alias("key"))
    whole = F.struct("turn", "content")
    shared = results.where("key IS NOT NULL").groupBy("key").agg(F.min(whole).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    same = results.join(shared, "key").groupBy("key", "conv_id", "call_id", "turn", "content", "first").agg(F.count("*").alias("n"))
    later = same.withColumn("n", F.col("n") - whole.eqNullSafe(F.col("first")).cast("int")).where("n > 0")
    taken = ["conv_id", "turn", "call_id", "content"]
    extra = later.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*taken, F.lit("duplicate_result").alias("kind"), F.lit(0).cast("long").alias("n_results"))
    bare = results.where("key IS NULL").select(*taken, F.lit("orphan").alias("kind"), F.lit(1).cast("long").alias("n_results"))
    null = lambda kind: F.lit(None).cast(kind)
    rows = extra.unionByName(bare).withColumns({"name": null("string"), "level": null("int"), "position": null("long"), "lost": null("long"), "error": null("string"), "arguments": null("string")})
    return rows.withColumn("canonical", _canonical(F.col("content"))).select(*COLUMNS)


def _canonical(content: Column) -> Column:
    """Canonical JSON of a row: its call and the content of its result."""
    text = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(_json_text(c))
    return F.concat(
        F.lit('{"arguments":'),
        F.coalesce(F.to_json(F.try_parse_json("arguments")), text(F.col("arguments"))),
        F.lit(',"call_id":'), text(F.col("call_id")),
        F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")),
        F.lit(',"name":'), text(F.col("name")),
        F.lit(',"result":'), text(content),
        F.lit("}"),
    )


def _json_text(c: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as tool use: a turn that isn't the assistant's calls ``<role>`` with its text
    and number of words, and depends on the call two turns before; an assistant's turn is the
    result of the call one turn before. Identifiers are those of the turn, as in chat logs."""
    identify = lambda back: F.concat(F.lit("call_"), (F.col("turn") - back).cast("string"))
    count = F.size(F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), ""))
    asked = conversations.where("role IS NULL OR role <> 'assistant'").select(
        "conv_id", "turn", identify(0).alias("call_id"), F.col("role").alias("name"),
        F.to_json(F.struct("text", count.alias("words"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(identify(2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    answered = conversations.where("role = 'assistant'").select("conv_id", "turn", identify(1).alias("call_id"), F.col("text").alias("content"))
    return asked, answered


SCHEMAS = {
    "user": {"text": {"type": "string", "required": True, "min": 1, "max": 300}, "words": {"type": "integer", "required": True, "min": 2}},
    "system": {"text": {"type": "string", "required": True}, "words": {"type": "integer", "required": True, "min": 1, "max": 40}},
}


def op4_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = exchanges(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return link_tool_calls(calls, results, SCHEMAS).unionByName(further_results(results))


OP4_SQL = r"""
WITH RECURSIVE asked AS (
  SELECT conv_id, turn, 'call_' || turn AS call_id, role AS name, text,
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS words,
    CASE WHEN turn >= 2 THEN 'call_' || (turn - 2) END AS dep
  FROM conversations WHERE role IS NULL OR role <> 'assistant'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name NULLS FIRST, text NULLS FIRST) AS nth
  FROM asked WHERE conv_id IS NOT NULL AND call_id IS NOT NULL),
calls AS (SELECT * FROM numbered WHERE nth = 1),
results AS (SELECT conv_id, turn, 'call_' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, content NULLS FIRST) AS nth, count(*) OVER (PARTITION BY conv_id, call_id) AS n
  FROM results WHERE conv_id IS NOT NULL AND call_id IS NOT NULL),
deps AS (SELECT c.conv_id, c.call_id, d.call_id AS dep, c.dep IS NOT NULL AND d.call_id IS NULL AS lost
  FROM calls c LEFT JOIN calls d ON d.conv_id = c.conv_id AND d.call_id = c.dep),
levels AS (
  SELECT conv_id, call_id, lost, 0 AS level FROM deps WHERE dep IS NULL
  UNION ALL SELECT d.conv_id, d.call_id, d.lost, v.level + 1 FROM deps d JOIN levels v ON d.conv_id = v.conv_id AND d.dep = v.call_id),
placed AS (SELECT v.*, row_number() OVER (PARTITION BY v.conv_id ORDER BY level, turn, v.call_id) AS position
  FROM levels v JOIN calls c ON c.conv_id = v.conv_id AND c.call_id = v.call_id),
joined AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, c.turn, coalesce(c.call_id, a.call_id) AS call_id, c.name, c.text, c.words,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN a.call_id IS NULL THEN 'open' ELSE 'linked' END AS kind,
    p.level, p.position, p.lost::BIGINT AS lost, coalesce(a.n, 0) AS n_results, a.content, c.call_id IS NOT NULL AS asks
  FROM calls c LEFT JOIN placed p ON p.conv_id = c.conv_id AND p.call_id = c.call_id
  FULL JOIN (SELECT * FROM ordered WHERE nth = 1) a ON a.conv_id = c.conv_id AND a.call_id = c.call_id
  UNION ALL SELECT conv_id, turn, call_id, name, text, words, 'duplicate', NULL, NULL, NULL, 0, NULL, true FROM numbered WHERE nth > 1
  UNION ALL SELECT conv_id, turn, call_id, name, text, words, 'open', NULL, NULL, NULL, 0, NULL, true FROM asked WHERE conv_id IS NULL OR call_id IS NULL
  UNION ALL SELECT conv_id, turn, call_id, NULL, NULL, NULL, 'duplicate_result', NULL, NULL, NULL, 0, content, false FROM ordered WHERE nth > 1
  UNION ALL SELECT conv_id, turn, call_id, NULL, NULL, NULL, 'orphan', NULL, NULL, NULL, 1, content, false FROM results WHERE conv_id IS NULL OR call_id IS NULL),
checked AS (
  SELECT *, CASE WHEN NOT asks THEN NULL WHEN name IS NULL OR name NOT IN ('user', 'system') THEN 'unknown name'
    WHEN name = 'system' AND text IS NULL THEN 'text is missing' WHEN name = 'system' AND words < 1 THEN 'words is below 1' WHEN name = 'system' AND words > 40 THEN 'words is above 40'
    WHEN name = 'user' AND text IS NULL THEN 'text is missing' WHEN name = 'user' AND length(text) < 1 THEN 'text is below 1'
    WHEN name = 'user' AND length(text) > 300 THEN 'text is above 300' WHEN name = 'user' AND words < 2 THEN 'words is below 2' END AS error
  FROM joined)
SELECT conv_id, turn, call_id, name, kind, level, position, lost, n_results, error,
  concat('{"arguments":', CASE WHEN NOT asks THEN 'null' WHEN text IS NULL THEN '{}' ELSE concat('{"text":', to_json(text), ',"words":', words, '}') END,
    ',"call_id":', coalesce(to_json(call_id)::VARCHAR, 'null'), ',"level":', coalesce(level::VARCHAR, 'null'), ',"name":', coalesce(to_json(name)::VARCHAR, 'null'),
    ',"result":', CASE WHEN content IS NULL THEN 'null' ELSE to_json(content)::VARCHAR END, '}') AS canonical
FROM checked
"""
