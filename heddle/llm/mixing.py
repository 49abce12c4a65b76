"""Mixing sources to target weights.

Method. The words of a source, its documents in a fixed pseudorandom order, are packed end to end
into blocks of ``block`` words. The mix is cut into output shards of ``shard`` slots, one block a
slot. Each shard draws multinomial source counts from the target shares, one independent draw a
slot. A source's slots are numbered through all shards, and slot number k takes block
``permutation(k mod blocks)``, a keyed swap-or-not permutation per source and pass. Slots and
blocks then meet in a join on (source, block).

Plain draws would leave a source off its target by about the square root of its slots. So each
source has a quota, its target in slots. Its draws count until the quota is full; what is drawn
beyond it, in the last shards, goes slot by slot to the sources that stay short of theirs. Quotas
add up to the number of slots, so every slot is filled and every source has its quota to the slot;
all other draws stay as the multinomial law gives them.

Targets: sources by code point, null last, weigh 5, 2, 1, 5, ...; they share the words of all
documents; no target exceeds ``most`` times its source's words, and what is cut off goes to the
others by weight. Rounded to slots, a share could come to a slot more than ``most`` passes over a
source's blocks; quotas end there, and what they lose goes to sources with room below that bound,
most room first. Each pass takes a block once, so no document gives more than ``most`` times its words.

Nothing is drawn from a random state: all draws are digests of their indices, so reruns agree.

A source's prefix sums go by ``lanes`` pseudorandom groups of its documents, so that a source
with a third of all rows is not one task's work; lane totals are at most ``lanes`` rows a source.

Defined cases. Null and empty texts have no words and give none. A null source is a source. A
null ``doc_id`` is a value like others. Wholly equal rows are interchangeable and are each packed.
Very long texts fill as many blocks as they need. An empty table gives an empty table. Columns other
than doc_id, source and text don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.words import words
from heddle.workspace import bind, materialise

WEIGHTS = (5, 2, 1)
BLOCK, SHARD, LANES, MOST, ROUNDS = 64, 16_384, 16_384, 3, 12
#: Lanes are summed up in groups of so many, so that no task has all lanes of a source.
GROUP = 128
#: Equal parts of the sum of all targets by which slots find their source; and bits of a draw.
CELLS, BITS = 1024, 52


def _digest(*parts: Column | str, digits: int = 15) -> Column:
    """60 bits, or four a digit, of the md5 of the parts as text."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.md5(text).alias("tie"), F.size(words(F.col("text"))).cast("long").alias("size")
    )


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """sid, source, source_size, target, bound (words of all targets up to this one), total.

    One row per source. Sources fill up in the order of cap over weight, so which of them are
    capped shows from running sums.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    rows = totals.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("long"))
    rows = rows.withColumns({"cap": most * F.col("source_size"), "total": F.sum("source_size").over(everything)})
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "sid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "full": F.coalesce(F.sum("cap").over(fill), F.lit(0)),
            "taken_weight": F.coalesce(F.sum("weight").over(fill), F.lit(0)),
            "all_weight": F.sum("weight").over(everything),
        }
    )
    capped = F.col("cap").cast("double") * (F.col("all_weight") - F.col("taken_weight")) <= F.col("weight").cast("double") * (F.col("total") - F.col("full"))
    rows = rows.withColumn("capped", capped)
    rest = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    share = F.col("weight").cast("double") * left / F.greatest(rest, F.lit(1))
    rows = rows.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share))
    running = F.sum("target").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    last = F.col("sid") == F.max("sid").over(everything)
    bound = F.when(last, F.col("total")).otherwise(F.least(F.round(running).cast("long"), F.col("total")))
    return rows.withColumn("bound", bound).select("sid", "source", "source_size", "target", "bound", "total")


def _mirrors(key: Column, size: Column, rounds: int = ROUNDS) -> Column:
    """Where each round of a permutation of 0..size-1 folds it."""
    return F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: _digest("k", key, r) % size)


def _permuted(index: Column, size: Column, key: Column, mirrors: Column) -> Column:
    """Swap-or-not: in each round x changes places with its mirror image, or not, by a digest
    of the larger of the two. A bijection of 0..size-1 for any size."""

    def step(x: Column, m: Column) -> Column:
        other = F.when(m["k"] >= x, m["k"] - x).otherwise(m["k"] - x + size)
        swap = F.substring(F.md5(F.concat_ws("|", F.lit("s"), key, m["r"].cast("string"), F.greatest(x, other).cast("string"))), 1, 1) < "8"
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.transform(mirrors, lambda k, r: F.struct(r.alias("r"), k.alias("k"))), index, step)


def quotas(plan: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """``plan`` with low (where its share of all words begins), slots (of the mix), quota (slots of
    the source), blocks (of the source) and mirrors (of each pass over them). One row per source."""
    slots = F.ceil(F.col("total") / F.lit(block)).cast("long")
    order = Window.orderBy("sid")
    high = F.when(F.col("bound") == F.col("total"), slots).otherwise(F.round(F.col("bound").cast("double") / F.col("total") * slots).cast("long"))
    rows = plan.where("total > 0").withColumns({"slots": slots, "high": high, "blocks": F.ceil(F.col("source_size") / F.lit(block)).cast("long")})
    before = lambda c: F.coalesce(F.lag(c).over(order), F.lit(0))
    key = lambda p: F.concat_ws(":", F.col("sid").cast("string"), p.cast("string"))
    passes = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: _mirrors(key(p), F.greatest(F.col("blocks"), F.lit(1))))
    rows = rows.withColumns({"low": before("bound"), "share": F.col("high") - before("high"), "mirrors": passes})
    # The blocks of all sources are as many as the slots at least, so there is always room.
    rows = rows.withColumns({"own": F.least("share", most * F.col("blocks")), "room": F.greatest(F.lit(0), most * F.col("blocks") - F.col("share"))})
    lost = F.sum(F.col("share") - F.col("own")).over(Window.partitionBy())
    earlier = F.coalesce(F.sum("room").over(Window.orderBy(F.desc("room"), "sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("quota", F.col("own") + F.greatest(F.lit(0), F.least(F.col("room"), lost - earlier)))
    return rows.drop("high", "share", "own", "room")


def source_counts(plan: DataFrame, shard: int = SHARD) -> DataFrame:
    """shard, sid, n: how many slots of each shard draw each source.

    A slot's point falls into one of CELLS equal cells, and meets the few sources that the cell
    touches; so a slot's work doesn't grow with the number of sources.
    """
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = plan.groupBy("slots", "total").agg(F.count("*").alias("_"))
    shards = whole.select("slots", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / shard))).alias("shard"))
    # Shards are spread before their slots are made.
    shards = shards.repartition(parts, "shard")
    last = F.least(F.col("slots"), (F.col("shard") + 1) * shard) - 1
    slot = shards.select("shard", "total", F.explode(F.sequence(F.col("shard") * shard, last)).alias("slot"))
    drawn = slot.withColumn("u", _digest("u", F.col("slot"), digits=BITS // 4))
    point = F.col("u").cast("double") / float(2**BITS) * F.col("total").cast("double")
    drawn = drawn.select("shard", point.alias("x"), F.floor(F.col("u") / F.lit(2**BITS // CELLS)).cast("int").alias("cell"))
    # A cell to either side, so that rounding can't part a point from its source.
    cell = lambda c, side: F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), (F.floor(F.col(c) / F.col("total") * CELLS) + side).cast("int")))
    touched = plan.select("sid", "low", "bound", F.explode(F.sequence(cell("low", -1), cell("bound", 1))).alias("cell"))
    met = drawn.join(touched, "cell").where((F.col("x") >= F.col("low").cast("double")) & (F.col("x") < F.col("bound").cast("double")))
    return met.groupBy("shard", "sid").agg(F.count("*").alias("n"))


def draws(plan: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """sid, block, shard of every slot of the mix."""
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = materialise(quotas(plan, block, most), "quotas")
    counts = materialise(source_counts(plan, shard), "counts")
    # Running sums over a source's shards, by lanes of shards.
    lane = counts.withColumn("lane", F.floor(F.col("shard") / 1024))
    sums = lane.groupBy("sid", "lane").agg(F.sum("n").alias("_n"))
    up_to = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "lane", F.coalesce(F.sum("_n").over(up_to(["sid"], "lane")), F.lit(0)).alias("_offset"))
    inner = F.coalesce(F.sum("n").over(up_to(["sid", "lane"], "shard")), F.lit(0))
    numbered = lane.withColumn("inner", inner).join(offsets, ["sid", "lane"]).join(plan.select("sid", "quota", "blocks"), "sid")
    numbered = numbered.withColumn("first", F.col("inner") + F.col("_offset"))
    numbered = numbered.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("first"))))
    numbered = materialise(numbered.select("sid", "shard", "blocks", "first", "n", "kept"), "numbered")

    # Slots beyond a quota, and slots that quotas lack: as many of the one as of the other, few of both.
    over = numbered.where("n > kept").select("shard", "sid", (F.col("n") - F.col("kept")).alias("m"))
    over = over.withColumn("e", F.coalesce(F.sum("m").over(Window.orderBy("shard", "sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    over = over.select("shard", F.explode(F.sequence(F.col("e"), F.col("e") + F.col("m") - 1)).alias("e"))
    have = plan.join(numbered.groupBy("sid").agg(F.sum("kept").alias("have")), "sid", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = have.withColumn("m", F.col("quota") - F.col("have"))
    short = short.withColumn("e", F.coalesce(F.sum("m").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("m > 0")
    short = short.select("sid", "blocks", "have", F.col("e").alias("_e"), F.explode(F.sequence(F.col("e"), F.col("e") + F.col("m") - 1)).alias("e"))
    settled = short.join(over, "e").select("sid", "blocks", "shard", (F.col("have") + F.col("e") - F.col("_e")).alias("k"))

    # A number of partitions keeps rows spread where few of them, as yet, would be put together again.
    kept = numbered.where("kept > 0").repartition(parts, "sid", "shard")
    slot = kept.select("sid", "blocks", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("kept") - 1)).alias("k"))
    slot = slot.unionByName(settled).join(plan.select("sid", "mirrors"), "sid")
    turn = F.floor(F.col("k") / F.col("blocks")).cast("int")
    key = F.concat_ws(":", F.col("sid").cast("string"), turn.cast("string"))
    return slot.select("sid", _permuted(F.col("k") % F.col("blocks"), F.col("blocks"), key, F.get("mirrors", turn)).alias("block"), "shard")


def packed(sized: DataFrame, plan: DataFrame, lanes: int = LANES) -> DataFrame:
    """Rows with words, with ``start``: the word at which a document begins in its source."""
    names = plan.select("sid", F.col("source").alias("_source"), "source_size", "target")
    placed = sized.join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("lane", _digest("lane", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("tie")) % lanes)
    lane = Window.partitionBy("sid", "lane")
    rows = placed.withColumn("inner", F.sum("size").over(lane.orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = placed.groupBy("sid", "lane").agg(F.sum("size").alias("_n")).withColumn("_group", F.floor(F.col("lane") / GROUP))
    up_to = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("sid", "_group").agg(F.sum("_n").alias("_g"))
    groups = groups.select("sid", "_group", F.coalesce(F.sum("_g").over(up_to(["sid"], "_group")), F.lit(0)).alias("_before"))
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_n").over(up_to(["sid", "_group"], "lane")), F.lit(0))).join(groups, ["sid", "_group"])
    offsets = offsets.select("sid", "lane", (F.col("_offset") + F.col("_before")).alias("_offset"))
    return rows.join(offsets, ["sid", "lane"]).withColumn("start", F.col("inner") + F.col("_offset")).drop("inner", "_offset", "lane")


def drawn_blocks(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, lanes: int = LANES, most: int = MOST):
    """(rows, pieces): the packed rows, and for each row and block how many of its words are in
    the block, how often the block is drawn, and the first shard that has it."""
    sized = materialise(_sized(docs), "sizes")
    plan = materialise(targets(sized, most), "targets")
    rows = materialise(packed(sized, plan, lanes), "packed")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    spans = rows.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    drawn = draws(plan, block, shard, most).groupBy("sid", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    # Drawn from a table of a few rows, the draws are taken for small, which they aren't.
    drawn = drawn.hint("merge")
    return rows, spans.withColumn("inside", inside).join(drawn, ["sid", "block"])


def mix(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard (the first output shard with words of
    the row, null without any): one row per document row."""
    rows, pieces = drawn_blocks(docs, **sizes)
    taken = pieces.groupBy("sid", "start").agg(F.sum(F.col("inside") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    # Rows without words share their start with another row, but take nothing.
    full = rows.where("size > 0").join(taken, ["sid", "start"], "left")
    none = rows.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("long")})
    out = full.select(*none.columns).unionByName(none)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mixed_documents(docs: DataFrame, **sizes: int) -> DataFrame:
    """The mix itself, as rows like ``docs``: one row for each pass that takes words of a
    document. A pass over all its words gives its text as it is; one over part of them gives
    those words, joined by spaces. ``n_chars``, where there is one, follows the text."""
    block = sizes.get("block", BLOCK)
    rows, pieces = drawn_blocks(docs, **sizes)
    place = F.col("block") * block
    taken = pieces.groupBy("sid", "start").agg(
        F.sort_array(
            F.collect_list(F.struct((F.greatest(place, F.col("start")) - F.col("start")).alias("at"), F.col("inside").alias("n"), F.col("times").alias("times")))
        ).alias("_pieces")
    )
    copy = Window.partitionBy("doc_id", "tie", "source").orderBy("start")
    keyed = rows.where("size > 0").withColumn("copy", F.row_number().over(copy)).join(taken, ["sid", "start"])
    keyed = keyed.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("source").alias("_source"), F.col("copy").alias("_copy"), F.col("size").alias("_size"), "_pieces")
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.withColumn("_md5", F.md5(text))
    whole = whole.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_md5", "source").orderBy(F.lit(1))))
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id"))
        & (F.col("_md5") == F.col("_tie"))
        & F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("_nth") == F.col("_copy"))
    )
    passes = whole.join(keyed, same).withColumn("_pass", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("_pieces", lambda p: p["times"])).cast("int"))))
    got = F.filter("_pieces", lambda p: p["times"] >= F.col("_pass"))
    passes = passes.withColumn("_got", got)
    full = F.aggregate("_got", F.lit(0).cast("long"), lambda a, p: a + p["n"]) == F.col("_size")
    part = bind(words(F.col("text")), lambda w: F.array_join(F.flatten(F.transform("_got", lambda p: F.slice(w, (p["at"] + 1).cast("int"), p["n"].cast("int")))), " "))
    passes = passes.withColumn("text", F.when(full, F.col("text")).otherwise(part))
    changed = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {}
    return passes.withColumns(changed).select(*docs.columns) if changed else passes.select(*docs.columns)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


def _sql() -> str:
    digest = lambda *p, digits=15: "('0x' || substr(md5(concat_ws('|', " + ", ".join(p) + f")), 1, {digits}))::BIGINT"
    other = "CASE WHEN {k} >= x THEN {k} - x ELSE {k} - x + blocks END"
    rounds, at = [], "k0"
    for r in range(ROUNDS):
        k = f"({digest(chr(39) + 'k' + chr(39), 'key', str(r))} % blocks)"
        rounds.append(f"k{r + 1} AS (SELECT sid, blocks, shard, key, CASE WHEN substr(md5(concat_ws('|', 's', key, {r}, greatest(x, o))), 1, 1) < '8' THEN o ELSE x END AS x FROM (SELECT *, {other.format(k=k)} AS o FROM {at}))")
        at = f"k{r + 1}"
    return f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, sum(source_size) OVER ()::BIGINT AS total FROM s0),
s2 AS (SELECT *, CASE sid % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight, {MOST} * source_size AS cap FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER f, 0)::BIGINT AS full_, coalesce(sum(weight) OVER f, 0)::BIGINT AS tw, sum(weight) OVER ()::BIGINT AS aw
  FROM s2 WINDOW f AS (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, cap::DOUBLE * (aw - tw) <= weight::DOUBLE * (total - full_) AS capped FROM s3),
s5 AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE weight::DOUBLE
    * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()::BIGINT) / greatest(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()::BIGINT, 1) END AS target FROM s4),
plan AS (SELECT *, CASE WHEN sid = max(sid) OVER () THEN total
    ELSE least(round(sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING))::BIGINT, total) END AS bound FROM s5),
q0 AS (SELECT *, ceil(source_size / {BLOCK})::BIGINT AS blocks, CASE WHEN bound = total THEN slots ELSE round(bound::DOUBLE / total * slots)::BIGINT END AS high
  FROM (SELECT *, ceil(total / {BLOCK})::BIGINT AS slots FROM plan WHERE total > 0)),
q1 AS (SELECT *, coalesce(lag(bound) OVER (ORDER BY sid), 0) AS low, high - coalesce(lag(high) OVER (ORDER BY sid), 0) AS share FROM q0),
q2 AS (SELECT *, least(share, {MOST} * blocks) AS own, greatest(0, {MOST} * blocks - share) AS room FROM q1),
quotas AS (SELECT *, (own + greatest(0, least(room, sum(share - own) OVER ()
    - coalesce(sum(room) OVER (ORDER BY room DESC, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS quota FROM q2),
drawn AS (SELECT slot // {SHARD} AS shard, {digest("'u'", "slot", digits=BITS // 4)}::DOUBLE / {float(2**BITS)!r}::DOUBLE * total::DOUBLE AS x
  FROM (SELECT total, unnest(range(0, slots)) AS slot FROM (SELECT DISTINCT slots, total FROM quotas))),
counts AS (SELECT shard, sid, count(*) AS n FROM drawn JOIN quotas ON x >= low::DOUBLE AND x < bound::DOUBLE GROUP BY shard, sid),
numbered AS (SELECT c.*, quota, blocks, coalesce(sum(n) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_
  FROM counts c JOIN quotas USING (sid)),
kept AS (SELECT *, greatest(0, least(n, quota - first_)) AS kept FROM numbered),
over_ AS (SELECT shard, row_number() OVER (ORDER BY shard, sid) - 1 AS e FROM (SELECT shard, sid, unnest(range(kept, n)) FROM kept)),
have AS (SELECT q.sid, q.blocks, q.quota, coalesce(sum(kept), 0)::BIGINT AS have FROM quotas q LEFT JOIN kept k USING (sid) GROUP BY ALL),
short AS (SELECT sid, blocks, k, row_number() OVER (ORDER BY sid, k) - 1 AS e FROM (SELECT sid, blocks, unnest(range(have, quota)) AS k FROM have)),
slot AS (SELECT sid, blocks, shard, unnest(range(first_, first_ + kept)) AS k FROM kept UNION ALL SELECT sid, blocks, shard, k FROM short JOIN over_ USING (e)),
k0 AS (SELECT sid, blocks, shard, concat_ws(':', sid, k // blocks) AS key, k % blocks AS x FROM slot),
{", ".join(rounds)},
times AS (SELECT sid, x AS block, count(*) AS times, min(shard) AS shard FROM {at} GROUP BY sid, x),
placed AS (SELECT d.*, p.sid, p.source_size, p.target, {digest("'lane'", "coalesce(doc_id::VARCHAR, 'null')", "tie")} % {LANES} AS lane
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
packed AS (SELECT *, row_number() OVER () AS row,
  (sum(size) OVER (PARTITION BY sid ORDER BY lane, doc_id, tie ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM placed),
spans AS (SELECT *, least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK}) AS inside FROM (
  SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM packed WHERE size > 0)),
taken AS (SELECT row, sum(inside * times)::BIGINT AS taken, min(shard) AS first_shard FROM spans JOIN times USING (sid, block) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_shard FROM packed LEFT JOIN taken USING (row)
"""


OP6_SQL = _sql()
