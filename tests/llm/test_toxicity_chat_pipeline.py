"""Toxicity by held-out accuracy, tool calls by small cases, and the pipeline end to end."""

import hashlib
import json
from collections import Counter
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import boosting, tool_chat, toxic_features, toxicity


def test_boosting_learns_and_isotonic_rises():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.Boosted().fit(x[:1000], y[:1000])
    raw = m.raw(x[1000:])
    assert ((raw > 0) == (y[1000:] > 0)).mean() > 0.95
    iso = boosting.Isotonic.fit(raw, y[1000:])
    assert np.all(np.diff(iso(np.sort(raw))) >= 0)


def test_hidden_words_are_seen():
    f = toxic_features.Features(frozenset())
    rows = f(["you 1d10t", "s-t-u-p-i-d thing", "looooser", "a fine day", ""])
    hits = rows[:, toxic_features.NAMES.index("log_hits")]
    assert (hits[:3] > 0).all() and (hits[3:] == 0).all()
    assert rows[0, toxic_features.NAMES.index("near_second")] == 1


@pytest.fixture(scope="module")
def planted(spark):
    """2400 documents, a fifth toxic, by words that only labels tell."""
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(400)]
    bad = ["grobnik", "zulpfen", "mertok", "vaskirr"]
    rows, labels = [], []
    for d in range(2400):
        words = rng.choice(plain, 60).tolist()
        toxic = int(rng.random() < 0.2)
        if toxic:
            for at in rng.choice(60, 3, replace=False):
                words[at] = str(rng.choice(bad))
        rows.append((d, " ".join(words)))
        labels.append((d, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(planted):
    docs, labels = planted
    out = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {d for d in range(2400) if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.98
    assert min(r.score for r in held if r.toxic) > max(r.score for r in held if not r.toxic) - 0.5


def test_held_out_labels_are_not_learned(planted):
    docs, labels = planted
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda lab: {r.doc_id: round(r.score, 9) for r in toxicity.score(docs, toxicity.fit(docs, lab)).collect()}
    assert score(labels) == score(flipped)


def test_training_rows_are_bounded(spark):
    """A labelled id that has a third of all rows, or many equal rows, doesn't widen the sample."""
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"text {i}") for i in ids] + [(ids[0], f"other text {k}") for k in range(3000)] + [(ids[1], "equal")] * 3000
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.training_rows(docs, labels, 500).collect()
    assert len(got) == 500
    assert len({r.text for r in got}) >= 499
    assert sorted(got) == sorted(toxicity.training_rows(docs.repartition(9), labels, 500).collect())


def test_toxicity_of_one_label(spark, awkward, clashing, empty):
    """Without both labels there is nothing to learn: the share of toxic rows, of those not held out."""
    a, b = [i for i in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 13, 14, 15) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    cases = [([(a, None), (None, 1)], 1 / 2), ([(a, 1), (a, 0), (b, 1)], 3 / 4), ([(a, 0), (b, None)], 1 / 3)]
    for rows, share in cases:
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        for frame in (awkward, clashing):
            out = toxicity.score(frame, toxicity.fit(frame, labels)).collect()
            assert len(out) == frame.count() and all(r.score == share and r.predicted == (r.score >= 0.7) for r in out)
        assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_trained_on_awkward_rows(spark, awkward, clashing, empty):
    """Null, empty, repeated and very long texts among the learned and the scored, by the trees."""
    insults = [f"you are such a stupid worthless idiot number {i}" for i in range(60)]
    plain = [f"the river runs by the old mill and the road number {i}" for i in range(60)]
    texts = insults + plain + [None, "", "x" * 3_000_000, "you idiot " * 200_000, " \n\t "]
    made = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)] + [(100, texts[0])] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, int(i < 60 or i == 123)) for i in range(len(texts))] + [(None, 1), (100, None)], "doc_id long, toxic int")
    scorer = toxicity.fit(made, labels)
    assert scorer.trees is not None
    got = {r.doc_id: r.score for r in toxicity.score(made, scorer).collect()}
    assert min(got[100 + i] for i in range(60)) > max(got[160 + i] for i in range(60))
    for frame in (awkward, clashing, empty):
        out = toxicity.score(frame, scorer).collect()
        assert len(out) == frame.count() and all(0 <= r.score <= 1 for r in out)


CALLS = [
    (1, 0, "a", "user", '{"words":3,"text":"one two three"}', []), (1, 1, "b", "user", '{"text":"x y","words":2}', ["a"]), (1, 2, "c", "user", "not json", ["b", "a"]),
    (1, 3, "d", "user", '{"text":"", "words":2}', ["e"]), (1, 4, "e", "user", '{"text":"x", "words":"2"}', ["d"]), (2, 0, "a", "user", "{}", []), (1, 9, "a", "user", "{}", []), (None, None, None, None, None, None),
    (2, 1, "f", "nobody", '{"b":{"z":1,"a":[1,2]},"a":"é\\n"}', ["gone"]),
]
RESULTS = [
    (1, 5, "a", "first"), (1, 6, "a", "second"), (1, 7, "zz", "orphan"), (1, 8, None, "lost"), (1, 9, "b", None), (2, 9, "f", 'say "hi"'), (None, 9, "f", "nowhere"),
    (2, 3, "a", "another conversation's"),
]


@pytest.fixture(scope="module")
def linked(spark):
    calls = spark.createDataFrame(CALLS, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>").withColumn("kind", F.lit("extra"))
    results = spark.createDataFrame(RESULTS, "conv_id long, turn long, call_id string, content string").withColumn("level", F.lit("extra"))
    return tool_chat.link_tool_calls(calls, results, tool_chat.SCHEMAS).collect()


def test_links_levels_and_faults(linked):
    main = {(r.conv_id, r.call_id): r for r in linked if r.kind in ("linked", "open", "orphan") and r.call_id}
    kinds = {(1, "a"): "linked", (1, "b"): "linked", (1, "c"): "open", (1, "d"): "open", (1, "e"): "open", (2, "a"): "linked", (2, "f"): "linked", (1, "zz"): "orphan"}
    assert {k: r.kind for k, r in main.items()} == kinds
    levels = {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): None, (1, "e"): None, (2, "a"): 0, (2, "f"): 0, (1, "zz"): None}
    assert {k: r.level for k, r in main.items()} == levels
    places = {(1, "a"): 1, (1, "b"): 2, (1, "c"): 3, (1, "d"): None, (1, "e"): None, (2, "a"): 1, (2, "f"): 2, (1, "zz"): None}
    assert {k: r.position for k, r in main.items()} == places
    assert main[2, "f"].lost == 1 and main[1, "a"].n_results == 2 and main[2, "a"].n_results == 1
    assert [(r.call_id, r.conv_id, r.error) for r in linked if r.kind == "duplicate"] == [("a", 1, "text is missing")]
    faults = {k: main[1, k].error for k in "abcde"}
    assert faults == {"a": None, "b": None, "c": "arguments are no object", "d": "text is below 1", "e": "words is no integer"}
    assert main[2, "f"].error == "unknown name"
    assert [r.error for r in linked if r.call_id is None] == ["unknown name"]


def test_canonical_json(linked):
    text = {(r.conv_id, r.call_id): r.canonical for r in linked if r.kind != "duplicate"}
    assert text[1, "a"] == '{"arguments":{"text":"one two three","words":3},"call_id":"a","level":0,"name":"user","result":"first"}'
    assert text[2, "a"] == '{"arguments":{},"call_id":"a","level":0,"name":"user","result":"another conversation\'s"}'
    assert text[2, "f"] == '{"arguments":{"a":"é\\n","b":{"a":[1,2],"z":1}},"call_id":"f","level":0,"name":"nobody","result":"say \\"hi\\""}'
    for t in text.values():
        assert json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == t


def test_positions_by_level_turn_and_identifier(spark):
    """A conversation of many ties, one of a chain against the order of its turns, and one of one call."""
    rng = np.random.default_rng(3)
    rows = [(1, int(rng.integers(0, 4)), f"k{i}", [f"k{d}" for d in rng.integers(0, i, min(i, 2)).tolist()]) for i in range(60)]
    rows += [(2, 20 - i, f"k{i}", [f"k{i - 1}"] if i else []) for i in range(20)] + [(3, None, "k0", ["gone"])]
    calls = spark.createDataFrame([(c, t, k, "user", "{}", on) for c, t, k, on in rows], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_chat.link_tool_calls(calls.repartition(5), results, {"user": {}}).collect()}
    for c in (1, 2, 3):
        own = [(t, k, on) for conv, t, k, on in rows if conv == c]
        level = brute_levels([(k, set(on)) for _, k, on in own])
        order = sorted(own, key=lambda r: (level[r[1]], -1 if r[0] is None else r[0], r[1]))
        assert [got[c, k].position for _, k, _ in order] == list(range(1, len(own) + 1))
        assert all(got[c, d].position < got[c, k].position for _, k, on in own for d in on if (c, d) in got)


def test_no_result_is_lost(spark, tmp_path):
    """Every assistant text of a conversation is in a row of its own, whatever its keys."""
    turns = [(1, 0, "user", "ask this"), (1, 1, "assistant", "A"), (1, 1, "assistant", "B"), (1, 1, "assistant", "B"), (1, 1, "assistant", None)]
    turns += [(None, 3, "assistant", "C"), (2, None, "assistant", "D"), (None, None, "assistant", "D"), (3, 5, "assistant", "E"), (3, 5, "assistant", "F"), (4, 0, "user", "and that")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = tool_chat.op4_tool_chat(spark, str(tmp_path)).collect()
    held = sorted((r.kind, r.call_id or "", str(json.loads(r.canonical)["result"])) for r in rows)
    assert held == sorted(
        [("linked", "call_0", "None"), *[("duplicate_result", "call_0", t) for t in "ABB"], ("orphan", "call_2", "C"), *[("orphan", "", "D")] * 2]
        + [("orphan", "call_4", "E"), ("duplicate_result", "call_4", "F"), ("open", "call_0", "None")]
    )
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(tool_chat.OP4_SQL)
    assert Counter(tuple(r[n] for n in want.columns) for r in rows) == Counter(want.fetchall())
    assert {(r.kind, r.turn) for r in rows if r.kind == "duplicate_result"} == {("duplicate_result", 1), ("duplicate_result", 5)}


def brute_levels(calls):
    depends, level = {c: {d for d in on if d in dict(calls)} for c, on in calls}, {}
    while free := [c for c, on in depends.items() if c not in level and on <= set(level)]:
        level |= {c: max([level[d] + 1 for d in depends[c]], default=0) for c in free}
    return {c: level.get(c) for c, _ in calls}


def test_levels_of_chains_joins_and_cycles(spark):
    """Chains of every length, calls with several dependencies, cycles and what hangs on them."""
    rng = np.random.default_rng(11)
    calls = [(f"c{k}", [f"c{k - 1}"] if k else []) for k in range(37)]
    calls += [("m0", ["c36", "c5", "gone"]), ("t0", ["m0"]), ("t1", ["t0"]), ("m1", ["t1", "m0", "c2"]), ("t2", ["m1"]), ("hub", [])]
    calls += [("x", ["x"]), ("y0", ["y2"]), ("y1", ["y0"]), ("y2", ["y1"]), ("z0", ["y1"]), ("z1", ["z0"]), ("m2", ["z1", "c3"]), ("t3", ["m2"])]
    calls += [(f"h{k}", ["hub"]) for k in range(20)]
    calls += [(f"r{k}", [f"r{d}" for d in sorted(set(rng.integers(0, max(k, 1), rng.integers(0, 4)).tolist())) if d < k]) for k in range(40)]
    got = tool_chat.levels(spark.createDataFrame(calls, "call_id string, depends_on array<string>")).collect()
    assert {r.call_id: r.level for r in got} == brute_levels(calls)
    assert len(got) == len(calls)
    assert {r.call_id: r.lost for r in got if r.lost} == {"m0": 1}


def test_long_chains_take_few_jobs(spark):
    """Twenty thousand calls, each on the one before: beyond any bound of one job per level."""
    calls = spark.range(20_001).selectExpr("CAST(id AS STRING) AS call_id", "CASE WHEN id > 0 THEN array(CAST(id - 1 AS STRING)) ELSE array() END AS depends_on")
    got = tool_chat.levels(calls)
    assert got.count() == 20_001 and got.where("level IS NULL OR level <> CAST(call_id AS INT)").isEmpty()


def test_no_calls(spark):
    calls = spark.createDataFrame([], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    assert tool_chat.link_tool_calls(calls, results, tool_chat.SCHEMAS).count() == 0


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    from heddle.workspace import materialise

    frame, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        frame = materialise(stage(spark, frame, sf), name)
        now = {r.doc_id for r in frame.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
        if name != "sentencepiece":
            assert frame.columns == docs.columns
    assert corpus_pipeline.run(spark, sf).count() == frame.count()


def test_pipeline_matches_brute_force(spark, sf, docs):
    """All five stages by plain Python, the fences of the first by SQL."""
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece
    from test_near_dedup import brute_classes
    from test_text_stages import brute_mix, dropped_lines, sql

    rows = {r.doc_id: r for r in docs.collect()}
    kept = sorted(d for d, k in sql("op8_quality_rules").select("doc_id, kept").fetchall() if k)
    cut = [(d, text) for d, _, _, text in dropped_lines([(d, rows[d].text) for d in kept])]
    least = brute_classes(cut)
    single = [(d, text, rows[d].source) for (d, text), c in zip(cut, least, strict=True) if d == c]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for (d, text), n in brute_mix(single).items():
        ids = library.encode(text)
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(text.encode()).hexdigest()] += n
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.decoded_sha256) for r in got) == want
    assert all(r.same_text and len(r.tokens) == r.n_tokens for r in got)


def test_pipeline_takes_awkward_rows(spark, sf, awkward, empty):
    import corpus_pipeline

    from heddle.workspace import materialise

    for frame in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            frame = materialise(stage(spark, frame, sf), name)
