"""BagMinHash and near-dedup against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import bag_min_hash as B
from heddle.llm import components, near_dedup


def bag(text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def brute_classes(rows):
    """Row number -> least doc_id of its class."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if jaccard(bags[i], bags[j]) >= 0.8:
            parent[find(j)] = find(i)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [least[find(i)] for i in range(len(rows))]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for k in range(60):
        shingle = rng.integers(0, 2**63, 120).astype("uint64")
        wa, wb = rng.integers(0, 9, 120), rng.integers(0, 9, 120)
        true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        owner = np.concatenate([np.zeros((wa > 0).sum(), int), np.ones((wb > 0).sum(), int)])
        s = B.signatures(owner, np.concatenate([shingle[wa > 0], shingle[wb > 0]]), np.concatenate([wa[wa > 0], wb[wb > 0]]), 2, 160)
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


@pytest.mark.parametrize(("a", "b"), [(3, 4), (5, 6), (7, 8), (15, 16), (1023, 1024)])
def test_registers_agree_by_fixed_weights(a, b):
    shingle = np.random.default_rng(a).integers(0, 2**63, 40).astype("uint64")
    owner = np.repeat([0, 1], 40)
    s = B.signatures(owner, np.concatenate([shingle, shingle]), np.repeat([a, b], 40), 2, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(a / b, abs=0.04)


def test_classes_by_weight(spark):
    """Pairs of texts of the same shingles, of which one has each once less."""
    rows = []
    for k in range(40):
        cycle = " ".join(f"p{k}w{i}" for i in range(12)) + " "
        rows += [(4 * k + j, cycle * n) for j, n in enumerate([16, 15] if k % 2 else [8, 7])]
    want = dict(zip([d for d, _ in rows], brute_classes(rows), strict=True))
    assert len(set(want.values())) == 40
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_shingles_are_those_of_plain_splitting():
    texts = ["a b c d e f", "x", "", " \t a  b\nc\rd\x0be f ", "é ü ß ñ ö ä", "a b"]
    hashes, offsets = B.shingles(texts, 5)
    sizes = np.diff(offsets).tolist()
    assert sizes == [sum(bag(t).values()) for t in texts]
    assert hashes[:2].tolist() == hashes[offsets[3] : offsets[3] + 2].tolist()
    assert len(set(hashes.tolist())) == len(hashes) - 2


def test_overlaps_match_brute_force(docs):
    texts = [r.text for r in docs.select("text").limit(60).collect()]
    a, b = texts[:30] + ["", "x"], texts[30:] + ["", "x"]
    b[:10] = [t.replace("the", "a", 3) for t in a[:10]]
    assert near_dedup.overlaps(a, b, 5).tolist() == pytest.approx([jaccard(bag(x), bag(y)) for x, y in zip(a, b, strict=True)])


def test_blocks_find_all_links():
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:k] + [f"q{k}"] + base[k + 1 :]) for k in range(0, 80, 4)] + [" ".join(base)] + ["other words of no likeness at all here"]
    n = np.arange(len(texts))
    u, v, s = near_dedup.linked_in_block(n, n, np.zeros(len(n), int), texts, 5, 0.8)
    assert s.tolist() == pytest.approx([jaccard(bag(texts[i]), bag(texts[j])) for i, j in zip(u, v, strict=True)])
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(bag(texts[i]), bag(texts[j])) >= 0.8}
    assert {(min(p), max(p)) for p in zip(u.tolist(), v.tolist(), strict=True)} == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_classes_of_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(zip([d for d, _ in rows], brute_classes(rows), strict=True))
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == want
    kept = near_dedup.near_dedup(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_hub_of_near_copies(spark):
    """Copies that are like the base but not like one another: all links go through the base."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)]
    for k in range(30):
        own = list(base)
        own[3 * k + 5], own[(3 * k + 47) % 100] = f"a{k}", f"b{k}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r.class_id for r in near_dedup.classes(df, block=8).collect()) == Counter(brute_classes(rows))


def test_recall_by_edits(spark, docs):
    """Copies of documents with 1 to 12 words changed: every pair at 0.8 or more must be found, and no
    text may join a class without a link."""
    rng = np.random.default_rng(9)
    base = [r.text.split() for r in docs.where("n_chars > 400").limit(14).collect()]
    rows, pairs = [], []
    for k, w in enumerate(base):
        rows.append((1000 * k, " ".join(w)))
        for e in range(1, 13):
            own = list(w)
            for at in rng.integers(0, len(own), e):
                own[at] = f"changed{rng.integers(10**9)}"
            rows.append((1000 * k + e, " ".join(own)))
            pairs.append((1000 * k, 1000 * k + e, jaccard(bag(rows[-1][1]), bag(" ".join(w)))))
    got = {r.doc_id: (r.class_id, r.n_texts) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = [(a, b) for a, b, s in pairs if s >= 0.8]
    found = sum(got[a] == got[b] for a, b in like)
    assert len(like) > 60 and found == len(like)
    want = dict(zip([d for d, _ in rows], brute_classes(rows), strict=True))
    assert {d: c for d, (c, _) in got.items()} == want
    sizes = Counter(want.values())
    assert all(n == sizes[c] for c, n in got.values())


def test_links_are_true_and_span_their_classes(spark, docs):
    """Links have their true similarity, and classes are the components of links between texts."""
    one = docs.where("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    texts = {r.doc_id: r.text for r in one.collect()}
    links = near_dedup.near_links(docs).collect()
    assert links and len({(r.doc_id, r.other_id) for r in links}) == len(links)
    for r in links:
        assert r.similarity >= 0.8 and r.similarity == pytest.approx(jaccard(bag(texts[r.doc_id]), bag(texts[r.other_id])))
    rows = near_dedup.classes(docs).collect()
    counts = {r.class_id: (r.n_texts, r.n_links) for r in rows}
    of = {r.doc_id: r.class_id for r in rows}
    assert Counter(of[r.doc_id] for r in links) == Counter({c: n for c, (_, n) in counts.items() if n})
    assert all(of[r.doc_id] == of[r.other_id] for r in links) and all(n >= t - 1 for t, n in counts.values())


@pytest.mark.parametrize("limits", [{"PAIRS": 2}, {"BLOCK_SHINGLES": 300}])
def test_limits_change_no_class(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    test_hub_of_near_copies(spark)


def test_awkward_rows(awkward, clashing, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = Counter(zip([d for d, _ in rows], brute_classes(rows), strict=True))
    for frame in (awkward, clashing):
        assert Counter((r.doc_id, r.class_id) for r in near_dedup.classes(frame).collect()) == want
        kept = near_dedup.near_dedup(frame)
        assert kept.columns == frame.columns
        assert kept.count() == len({c for _, c in want})
    assert near_dedup.classes(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0


def test_all_ids_null(spark):
    df = spark.createDataFrame([(None, "some text"), (None, "some text"), (None, "other text")], "doc_id long, text string")
    assert [r.class_id for r in near_dedup.classes(df).collect()] == [None] * 3
    assert near_dedup.near_dedup(df.where(F.col("text") == "some text")).count() == 1
    assert sorted(r.text for r in near_dedup.near_dedup(df).collect()) == ["other text", "some text"]


def test_shared_ids_keep_their_classes(spark):
    """Rows of one id with unlike texts are different classes, of which each keeps a row."""
    words = [" ".join(f"{p}{i}" for i in range(40)) for p in "abc"]
    rows = [(5, words[0]), (5, words[1]), (5, words[1]), (6, words[1] + " more"), (None, words[2]), (None, words[2] + " more"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, (r.text or "")[:1]) for r in near_dedup.near_dedup(df).collect())
    assert kept == [(0, ""), (0, "c"), (5, "a"), (5, "b")]
