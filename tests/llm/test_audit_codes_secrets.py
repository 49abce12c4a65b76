"""Filter audit, vector codes and secret scans against brute force."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import automaton, filter_audit, secret_scan, vector_codes

LABELS = [(5, 1, 0), (5, 0, 1), (6, 1, None), (9, None, 1), (11, 1, 1), (12, 1, 1), (None, 1, 1), (999, 1, 1)]


def _failures(rows):
    """part, failing filters, good, toxic of each row."""
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, t in LABELS if t == 1 and i is not None}
    place = lambda i: (i is not None, i or 0)
    first = {}
    for i, text, *_ in rows:
        first[text or ""] = min(first.get(text or "", place(i)), place(i))
    out = []
    for i, text, lang, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": place(i) > first[text],
        }
        out.append((lang or "", {k for k, v in bad.items() if v}, i in good, i in toxic))
    return out


def _audited(rows):
    found, failures = {}, _failures(rows)
    for part in {f[0] for f in failures}:
        own, totals = [f[1:] for f in failures if f[0] == part], {}
        for order in permutations("ABCDE"):
            left = own
            for k, name in enumerate(order):
                out, left = [f for f in left if name in f[0]], [f for f in left if name not in f[0]]
                redundant = sum(name in f[0] for f in own) - len(out)
                totals[name] = totals.get(name, 0) + len(out)
                unique = sum(f[0] == {name} for f in own)
                found[part, "".join(order), k + 1] = [len(left), len(out), redundant, unique, sum(f[1] for f in out), sum(f[2] for f in out)]
        for (p, order, k), v in found.items():
            if p == part:
                v.append(totals[order[k - 1]])
    return found


def _audit(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(docs, labels).collect()}


def test_audit_of_awkward_rows(spark, awkward, clashing):
    expected = _audited([tuple(r) for r in awkward.collect()])
    assert _audit(spark, awkward) == expected
    assert _audit(spark, clashing.withColumns({n: F.lit("x") for n in ["part", "n", "A", "E", "good"]})) == expected


def test_audit_of_many_copies(spark):
    rng = random.Random(3)
    kinds = ["word " * 120, " ".join(f"w{i}" for i in range(120)), "SHOUT " * 3, "50 % off", " ".join(f"x{i}" for i in range(150)) + " #", ""]
    rows = [(rng.randint(0, 60), rng.choice(kinds), rng.choice(["en", "fr", None, ""])) for _ in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert _audit(spark, docs) == _audited(rows)


def test_audit_of_an_empty_table(spark, empty):
    assert _audit(spark, empty) == {}


def test_shapley_values_add_up(spark, docs, sf):
    rows = filter_audit.op11_filter_audit(spark, sf).where("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r")).collect()
    assert rows and all(r["s"] == 120 * r["r"] for r in rows)


def _coded(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.floor(np.array([r[1] for r in kept], "float32").astype(float) * 1024).astype(int)
    width = v.shape[1] // parts
    cut = [v[:, p * width : (p + 1) * width] for p in range(parts)]
    books = [c[:entries].copy() for c in cut]

    def assign():
        d = [((c[:, None] - b[None]) ** 2).sum(2) for c, b in zip(cut, books, strict=True)]
        return [x.argmin(1) for x in d], sum(x.min(1) for x in d)

    for _ in range(rounds):
        for p, index in enumerate(assign()[0]):
            for e in set(index):
                own = cut[p][index == e]
                books[p][e] = [int(s) // len(own) for s in own.sum(0)]
    index, error = assign()
    codes = ["".join(f"{i[n]:02x}" for i in index) for n in range(len(kept))]
    sums = {}
    for r, e in zip(kept, error, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], c, int(e), sums[r[2]], digest) for r, c, e in zip(kept, codes, error, strict=True)), key=repr)


def _compressed(df, **options):
    return sorted((tuple(r) for r in vector_codes.compress(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=8))], int(i) % 3 if i % 7 else None) for i in rng.permutation(300)]
    rows += [rows[0], (None, rows[1][1], 1), (900, None, 1), (901, [1.0, None, *[0.0] * 6], 1), (902, [float("nan"), *[0.0] * 7], 1), (903, [float("-inf"), *[0.0] * 7], 2)]
    rows += [(1000 + i, [0.5] * 8, 9) for i in range(40)]
    df = spark.createDataFrame(rows, VECTORS)
    assert _compressed(df, entries=16) == _coded(rows, entries=16)
    assert _compressed(df.repartition(7), entries=16) == _coded(rows, entries=16)
    assert _compressed(df) == _coded(rows)


def test_codes_of_odd_tables(spark):
    assert _compressed(spark.createDataFrame([], VECTORS)) == []
    few = [(1, [0.25] * 4, None), (2, [1.0, -1.0, 0.001, 5.0], None)]
    assert _compressed(spark.createDataFrame(few, VECTORS)) == _coded(few)
    odd = [*few, (3, [1.0] * 5, 1), (4, [], 1), (5, [1e30, 0.0, 0.0, 0.0], 1), (6, [1.0] * 8, None)]
    got = _compressed(spark.createDataFrame(odd, VECTORS))
    assert [r[:4] for r in got if r[0] > 2] == [(3, None, None, None), (4, None, None, None), (5, None, None, None), (6, None, None, 0)]
    assert [r for r in got if r[0] <= 2] == _coded(few)
    clashing = spark.createDataFrame(few, VECTORS).withColumns({"code": F.lit("x"), "v": F.lit("kept"), "id": F.lit(7)})
    out = vector_codes.compress(clashing)
    assert out.columns == ["vec_id", "label", "v", "id", "code", "error", "label_error", "codebooks_sha256"]
    assert {(r["v"], r["id"]) for r in out.collect()} == {("kept", 7)}
    assert all(len(r["code"]) == 8 for r in out.collect())
    with pytest.raises(ValueError):
        vector_codes.compress(clashing, entries=300)


@pytest.mark.parametrize("spread", [1, 300, 2**26])
def test_pruned_search_is_exact(spread):
    rng = np.random.default_rng(spread)
    entries, parts = rng.integers(-spread, spread + 1, (64, 4)), rng.integers(-spread, spread + 1, (2000, 4))
    entries[10] = entries[40]
    index, error = vector_codes.Codebook(entries).nearest(parts)
    d = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (error == d.min(1)).all()
    assert (vector_codes.Codebook(entries).nearest(entries)[1] == 0).all()


KEYWORD = re.compile(r"\(\?i:([^)]*)\)")


def _spans(text, rules=secret_scan.RULES):
    found = []
    for k, r in enumerate(rules):
        either = KEYWORD.sub(lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c.group()}{c.group().upper()}]", m.group(1)) + ")", r.pattern)
        for m in re.finditer(either, text):
            run = re.search(r"[A-Za-z0-9+/_.=-]+$", m.group()[re.search("[:=]", m.group()).end() :]).group() if r.last else m.group()
            if len(run) >= r.least:
                found.append((m.start(), k, m.end()))
    return [(rules[k].kind, a, b) for a, k, b in sorted(found)]


PIECES = [
    "password", "passwd", "Secret", "toKEN", "api_key", "apikey", "apik", "pass", "secre", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef", " ", "  ", "=", ":", '"', "'", "é",
    "x", "abcdef123", "ghp_", "a1" * 20, "xoxb-", "eyJ", "eyJhb", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", "-", "\n", "=abc", "token", "ſ", "\U0001f511",
]


def test_automaton_by_brute_force():
    scan, rng = secret_scan.Scanner(secret_scan.RULES), random.Random(11)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert scan(text) == _spans(text), text


def test_automaton_of_other_patterns():
    few = automaton.Automaton(["ab+", "(?i:x|yz)[0-9]*", r"a\x20?b"])
    assert sorted(few.scan(b"aabbb a b Yz12X")) == [(0, 1, 5), (1, 10, 14), (1, 14, 15), (2, 1, 3), (2, 6, 9)]
    for bad in ["a*", "(ab", "a[bc"]:
        with pytest.raises((ValueError, IndexError)):
            automaton.Automaton([bad])
    with pytest.raises(ValueError):
        automaton.Automaton(["ab|abcd"])


def test_minimal_states_behave_alike():
    one, rng = automaton.Automaton(["a[ab]+", "b+"], [3, 2]), random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        expected = sorted((r, m.start(), m.end()) for r, (p, n) in enumerate([("a[ab]+", 3), ("b+", 2)]) for m in re.finditer(p, text) if m.end() - m.start() >= n)
        assert sorted(one.scan(text.encode())) == expected


def test_scan_of_awkward_rows(spark, awkward, empty, clashing):
    long = ("some words é " * 40_000) + 'Token = "abcdef0123456789abcdef0123"' + "0123456789abcdef" * 100_000
    more = spark.createDataFrame([(50, long, "en", "a", 0), (51, "é passwd: geheim7 ghp_" + "x" * 36, "en", "a", 0)], awkward.schema)
    rows = awkward.union(more)
    got = sorted(((r["doc_id"], [tuple(s) for s in r["secrets"]]) for r in secret_scan.scan_secrets(rows.select("doc_id", "text")).collect()), key=repr)
    assert got == sorted(((r["doc_id"], _spans(r["text"] or "")) for r in rows.collect()), key=repr)
    assert secret_scan.scan_secrets(empty).collect() == []
    out = secret_scan.scan_secrets(clashing.withColumn("secrets", F.lit("x")))
    assert out.columns == [*[c for c in clashing.columns if c != "text"], "secrets"] and out.count() == awkward.count()
