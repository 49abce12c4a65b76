"""Quality rules, line dedup, mixing and fingerprints against plain Python and SQL."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from heddle.llm import fingerprint, line_dedup, mixing, quality, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sql(name, docs=None):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    if docs is not None:
        frame = docs.toPandas()
        c.sql("DROP VIEW documents")
        c.register("documents", frame)
    return c.sql(registry.SQL[name])


def same_rows(df, relation):
    names = sorted(df.columns)
    key = lambda r: tuple((x is None, str(round(x, 6) if isinstance(x, float) else x)) for x in r)
    got = sorted(key([r[c] for c in names]) for r in df.collect())
    want = sorted(key(r) for r in relation.select(*[f'"{n}"' for n in names]).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf, name):
    same_rows(registry.QUERIES[name](spark, sf), sql(name))


def dropped_lines(rows, min_chars=20, min_docs=3):
    """Brute force of line dedup: list of (doc_id, lines, kept text)."""
    fold = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(fold(line)) >= min_chars:
                holders[fold(line)].add(d)
    rank = lambda d: (d is not None, d or 0)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[fold(x)]) >= min_docs and max(holders[fold(x)], key=rank) != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_awkward(awkward, clashing):
    want = Counter(dropped_lines([(r.doc_id, r.text) for r in awkward.collect()]))
    for frame in (awkward, clashing):
        got = line_dedup.line_dedup(frame)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == want
    assert set(line_dedup.line_dedup(clashing).columns) == set(clashing.columns)


def test_line_dedup_null_and_repeated_ids(spark):
    line = "x" * 25
    rows = [(None, line), (None, line + "\n" + "y" * 20), (1, line), (1, line), (2, "z\n" + line)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == Counter(dropped_lines(rows))


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("keep_text", [True, False])
def test_quality_awkward(awkward, clashing, keep_text):
    for frame in (awkward, clashing):
        got = quality.quality_rules(frame, keep_text=keep_text)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        want = Counter((r.doc_id, *measures(r.text)) for r in awkward.collect())
        assert Counter((r.doc_id, *[r[n] for n in names]) for r in got.collect()) == want
        assert got.where("kept AND base_failed").isEmpty()


def test_each_fence_can_reject(spark):
    """In sources without oddities, a document that passes the base rules is off in one rate alone."""
    plain = lambda k, n=100: [f"word{(7 * k + j) % 9973:04d}" for j in range(n)]
    rows = [(k, " ".join(plain(101 * k)), "en", "s") for k in range(300)]
    w = plain(50_000)
    odd = {
        "symbol_rate": " ".join(["#####" + x if j % 10 == 0 else x for j, x in enumerate(w)]),
        "dup_line_rate": "\n".join(f"{x}\nsame" if j % 2 else x for j, x in enumerate(w)),
        "repeat_rate": " ".join(w[:12] + w[20:85] + w[:12]),
        "echo_rate": " ".join(x + (" " + x if j % 8 == 0 else "") for j, x in enumerate(w)),
        "word_length": " ".join(x + "longer" for x in w),
        "short words": " ".join(x[:1] + x[-3:] for x in w),
        "none": " ".join(w),
    }
    names = list(odd)
    rows += [(1000 + i, odd[n], "en", "s") for i, n in enumerate(names)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("doc_id >= 1000").collect()
    assert not any(r.base_failed for r in got)
    assert {names[r.doc_id - 1000] for r in got if not r.kept} == set(names) - {"none"}


def test_small_groups_lean_on_larger_ones(spark):
    """A quartile moves smoothly from the language's to the group's own as documents are added."""
    def high(n):
        rows = [("en", "big", "symbol_rate", b, 10**7) for b in (-100, -99)] + [("en", "small", "symbol_rate", 0, n)]
        sketch = spark.createDataFrame(rows, "lang string, source string, metric string, bucket int, n long")
        return quality.fences(sketch).where("source = 'small'").first().symbol_rate.high

    found = [high(n) for n in (1, 10, 100, 199, 201, 1000, 100_000)]
    assert found == sorted(found) and found[4] - found[3] < 0.05 and found[0] < 0.3 and found[-1] > 0.9


def test_sketches_merge(docs):
    """The sketch of all rows is the sum of the sketches of two halves."""
    measured = quality.measure(docs).drop("text").cache()
    whole = {tuple(r)[:4]: r.n for r in quality.sketches(measured).collect()}
    halves = [quality.sketches(measured.where(F.col("doc_id") % 2 == k)).collect() for k in (0, 1)]
    merged = Counter()
    for h in halves:
        merged.update({tuple(r)[:4]: r.n for r in h})
    assert merged == whole


def test_quality_keeps_clean_and_drops_junk(spark, docs):
    judged = quality.quality_rules(docs, keep_text=False).select("doc_id", "kept", "base_failed")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    j = judged.join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"), F.count("*").alias("n"))
    shares = {r.quality: r.k for r in j.collect()}
    assert shares[1] > 0.97
    assert shares.get(0, 0) < 0.35


def test_mix_targets_and_limits(awkward, clashing, docs):
    for frame in (awkward, clashing, docs):
        rows = mixing.mix(frame).collect()
        assert len(rows) == frame.count()
        assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
        assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in frame.collect())
    by_source = docs.select("doc_id", "source").join(mixing.mix(docs), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s"))
    for r in by_source.collect():
        assert r.g <= 3 * r.s + 1e-6
        assert abs(r.t - r.g) <= 2 * mixing.BLOCK


def test_mix_reruns_agree(docs):
    assert sorted(mixing.mix(docs).collect()) == sorted(mixing.mix(docs.repartition(7)).collect())


def plan_of(spark, sizes):
    rows = [(i, "w " * n, f"s{i:02d}") for i, n in enumerate(sizes)]
    return mixing.targets(mixing._sized(spark.createDataFrame(rows, "doc_id long, text string, source string")))


def test_draws_fill_quotas(spark):
    """Every slot is filled, every source has its quota, and no block goes beyond three passes."""
    plan = plan_of(spark, [4000, 90, 3000, 1, 0, 700, 64])
    rows = {r.sid: r for r in mixing.quotas(plan, 8).collect()}
    got = mixing.draws(plan, 8, 50).collect()
    n = Counter(r.sid for r in got)
    assert len(got) == sum(r.quota for r in rows.values()) == next(iter(rows.values())).slots
    assert all(n[s] == r.quota <= 3 * r.blocks and abs(r.quota * 8 - r.target) <= 8 for s, r in rows.items())
    assert max(Counter((r.sid, r.block) for r in got).values()) <= 3
    assert all(r.block < rows[r.sid].blocks for r in got)
    full = Counter(r.shard for r in got)
    assert all(full[k] == 50 for k in range(max(full)))


@pytest.mark.parametrize("sizes", [[128, 64, 776], [1630, 128, 128, 2896]])
def test_no_document_exceeds_three_times_its_size(spark, sizes):
    """Capped sources whose words fill their blocks: rounding would give them a fourth pass."""
    rows = [(i, "w " * n, f"s{i:02d}") for i, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_quotas_of_random_tables(spark):
    """Quotas fill the slots, stay within three passes, and leave their shares by few slots."""
    rng = random.Random(8)
    for block in (8, 64):
        for _ in range(4):
            sizes = [rng.choice([rng.randint(0, 40) * block, rng.randint(0, 40 * block)]) for _ in range(rng.randint(1, 9))]
            rows = mixing.quotas(plan_of(spark, sizes), block).collect()
            assert sum(r.quota for r in rows) == (rows[0].slots if rows else 0)
            assert all(0 <= r.quota <= 3 * r.blocks for r in rows)
            assert all(abs(r.quota * block - r.target) <= (len(rows) + 1) * block for r in rows)


def test_source_counts_are_multinomial(spark):
    """Counts of a source over many shards vary by the binomial law, and draws fall by their shares."""
    plan = mixing.quotas(plan_of(spark, [60_000, 50_000, 40_000, 30_000]), 1).cache()
    shares = {r.sid: (r.bound - r.low) / r.total for r in plan.collect()}
    counts = defaultdict(dict)
    for r in mixing.source_counts(plan, 200).collect():
        counts[r.shard][r.sid] = r.n
    assert len(counts) == 900 and all(sum(c.values()) == 200 for c in counts.values())
    for s, p in shares.items():
        n = [c.get(s, 0) for c in counts.values()]
        mean = sum(n) / len(n)
        variance = sum((x - mean) ** 2 for x in n) / (len(n) - 1)
        assert abs(mean - 200 * p) < 5 * (200 * p * (1 - p) / len(n)) ** 0.5
        assert 0.75 < variance / (200 * p * (1 - p)) < 1.3


def test_capped_targets(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 300, "b"), (3, "w " * 300, None)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].target == 30.0
    assert got[2].target == pytest.approx(580 * 2 / 3) and got[3].target == pytest.approx(580 / 3)


def test_mixed_documents_hold_what_is_taken(docs, awkward):
    for frame in (docs, awkward):
        taken = Counter()
        for r in mixing.mix(frame).collect():
            taken[r.doc_id] += r.taken
        out = mixing.mixed_documents(frame)
        assert out.columns == frame.columns
        got, texts = Counter(), defaultdict(set)
        for r in out.collect():
            got[r.doc_id] += len(WORD.findall(r.text))
            texts[r.doc_id].add(r.text)
            assert r.n_chars == len(r.text)
        assert got == Counter({k: v for k, v in taken.items() if v})


def digest(*parts, digits=15):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:digits], 16)


def brute_targets(sizes):
    """Targets by weight, capped at three times a source's words, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}, {}
    while True:
        free = [s for s in names if s not in target]
        left, heavy = sum(sizes.values()) - sum(target.values()), sum(weight[s] for s in free)
        above = {s: 3.0 * sizes[s] for s in free if weight[s] * left / heavy >= 3 * sizes[s]}
        if not above:
            return names, target | {s: weight[s] * left / heavy for s in free}
        target |= above


def permuted(x, size, key):
    for r in range(mixing.ROUNDS):
        other = (digest("k", key, r) - x) % size
        if hashlib.md5(f"s|{key}|{r}|{max(x, other)}".encode()).hexdigest()[0] < "8":
            x = other
    return x


def brute_mix(rows):
    """(doc_id, text) of the mix of rows (doc_id, text, source), by the rules as they are written."""
    sizes, order = Counter(), defaultdict(list)
    for d, text, s in rows:
        n = len(WORD.findall(text or ""))
        sizes[s] += n
        tie = hashlib.md5((text or "").encode()).hexdigest()
        order[s].append((digest("lane", "null" if d is None else d, tie) % mixing.LANES, (d is not None, d or 0), tie, d, text or "", n))
    names, target = brute_targets(sizes)
    total, block = sum(sizes.values()), mixing.BLOCK
    slots, bounds, run = -(-total // block), [0], 0.0
    for s in names:
        run += target[s]
        bounds.append(total if s == names[-1] else min(total, int(run + 0.5)))
    ends = [0, *[int(b / total * slots + 0.5) for b in bounds[1:-1]], slots]
    quota, blocks = [b - a for a, b in zip(ends, ends[1:], strict=False)], [-(-sizes[s] // block) for s in names]
    taken, beyond = [[] for _ in names], 0
    for slot in range(slots):
        x = digest("u", slot, digits=13) / 2.0**52 * total
        sid = next(i for i in range(len(names)) if bounds[i] <= x < bounds[i + 1])
        if len(taken[sid]) < quota[sid]:
            taken[sid].append(len(taken[sid]))
        else:
            beyond += 1
    assert beyond == sum(q - len(t) for q, t in zip(quota, taken, strict=True))
    out = Counter()
    for sid, s in enumerate(names):
        # What others draw beyond their quotas fills this one's.
        times = Counter(permuted(k % blocks[sid], blocks[sid], f"{sid}:{k // blocks[sid]}") for k in range(quota[sid]))
        start = 0
        for _, _, _, d, text, n in sorted(order[s], key=lambda r: r[:3]):
            words, pieces = WORD.findall(text), []
            for b in range(start // block, (start + n - 1) // block + 1) if n else ():
                a, e = max(start, b * block) - start, min(start + n, (b + 1) * block) - start
                pieces.append((a, e, times[b]))
            for p in range(1, max((t for *_, t in pieces), default=0) + 1):
                got = [words[a:e] for a, e, t in pieces if t >= p]
                out[d, text if sum(map(len, got)) == n else " ".join(sum(got, []))] += 1
            start += n
    return out


def test_mixed_documents_match_brute_force(docs, awkward):
    for frame in (docs, awkward):
        want = brute_mix([(r.doc_id, r.text, r.source) for r in frame.collect()])
        assert Counter((r.doc_id, r.text) for r in mixing.mixed_documents(frame).collect()) == want


def runs(paragraph):
    """Words between cuts, each run with the run before it."""
    out, own = [""], []
    for w in re.findall(r"[^\x20\x09\x0b-\x0d]+", paragraph):
        own.append(w)
        if (ord(w[-1]) + len(w)) % 8 == 0:
            out.append(" ".join(own))
            own = []
    out += [" ".join(own)] if own else []
    return [f"{a} {b}" for a, b in zip(out, out[1:], strict=False)]


def vector(text):
    """Brute force of a fingerprint."""
    lanes = [0] * 133
    for p in text.split("\n"):
        h = hashlib.sha256(p.encode()).hexdigest()
        for k in range(8):
            lanes[k] += int(h[8 * k : 8 * k + 8], 16)
        for run in runs(p):
            d = hashlib.md5(run.encode()).hexdigest()
            for g in range(4):
                bits = int(d[8 * g : 8 * g + 8], 16)
                for k in range(31):
                    lanes[8 + 31 * g + k] += bits >> k & 1
            lanes[132] += 1
    return "".join(f"{x % 2**32:08x}" for x in lanes)


def test_fingerprints_awkward(awkward, clashing):
    rows = [(r.doc_id, r.text or "") for r in awkward.collect()]
    ids = sorted({d for d, _ in rows}, key=lambda d: (d is not None, d or 0), reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    stands = {d: max(t for e, t in rows if e == d) for d in ids}
    want = Counter()
    for d, t in rows:
        half = len(t) // 2
        edited = t[: len(t) - half] + stands[after[d]][:half]
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), vector(t), vector(edited)] += 1
    for frame in (awkward, clashing):
        got = fingerprint.fingerprints(frame).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == want
        assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


def test_fingerprint_is_homomorphic(spark):
    df = spark.createDataFrame([("a b\nc d\ne", "e\na b\nc d", "a b\ne", "c d")], "x string, y string, less string, part string")
    v = {c: fingerprint.vector(F.col(c)) for c in df.columns}
    back = df.select((v["x"] == v["y"]).alias("order"), (fingerprint.combine(v["less"], v["part"]) == v["x"]).alias("add"), (fingerprint.combine(v["x"], v["part"], -1) == v["less"]).alias("sub"))
    assert tuple(back.first()) == (True, True, True)


def test_likeness_survives_words_put_in(spark):
    """One long line, and the line with a word put in near its start, or taken out, or changed."""
    words = [f"{'abcdefgh'[i % 8]}word{i * 7919 % 1009}" for i in range(400)]
    other = [f"{'qrstuvw'[i % 7]}term{i * 104729 % 997}" for i in range(400)]
    texts = {"in": words[:3] + ["new"] + words[3:], "out": words[:5] + words[6:], "change": [*words[:9], "else", *words[10:]], "other": other}
    df = spark.createDataFrame([(k, " ".join(words), " ".join(v)) for k, v in texts.items()], "k string, a string, b string")
    got = {r.k: r.n for r in df.select("k", fingerprint.likeness(fingerprint.vector(F.col("a")), fingerprint.vector(F.col("b"))).alias("n")).collect()}
    assert min(got["in"], got["out"], got["change"]) > 0.9 and got["other"] < 0.35


def test_likeness_tells_edits_from_strangers(docs):
    got = fingerprint.fingerprints(docs).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert got.e > 0.4 > 0.2 > got.n


def test_empty_tables(empty):
    for f in (line_dedup.line_dedup, quality.quality_rules, mixing.mix, mixing.mixed_documents, fingerprint.fingerprints):
        assert f(empty).count() == 0
