"""Queries on intervals, windows, tokens and sequences, and on sets, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import genomics as S
from heddle.plans import adapters as A
from heddle.plans.registry import query
from heddle.workspace import table

R = lambda c: F.round(c, 6)


@query("interval_left_join", A.sql('SELECT a.motif_id, a.chrom, a.start, a."end", b.peak_id, b.start AS b_start, b."end" AS b_end FROM motifs a LEFT JOIN peaks b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end"', "motifs", "peaks"))
def interval_left_join(spark, sf):
    a, b = A.intervals(spark, sf)
    return S.overlap_join(a.drop("strand"), b, "motif_id", "peak_id")


@query("strand_extension", A.sql("SELECT motif_id, CASE WHEN strand = '+' THEN start - 249 ELSE start - 50 END AS start, CASE WHEN strand = '+' THEN \"end\" + 50 ELSE \"end\" + 249 END AS stop FROM motifs", "motifs"))
def strand_extension(spark, sf):
    start, end = S.extend_by_strand(F.col("start"), F.col("end"), F.col("strand"))
    return A.intervals(spark, sf)[0].select("motif_id", start.alias("start"), end.alias("stop"))


@query("motif_centre_bin", A.sql("""SELECT motif_id, a.start + (a."end" - a.start) // 2 - 500 AS low, a.start + (a."end" - a.start) // 2 + 500 AS high, max((b.peak_id IS NOT NULL)::INT) AS y
  FROM motifs a LEFT JOIN peaks b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" GROUP BY 1, 2, 3""", "motifs", "peaks"))  # fmt: skip
def motif_centre_bin(spark, sf):
    a, b = A.intervals(spark, sf)
    mid = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)
    j = S.overlap_join(a.drop("strand"), b, "motif_id", "peak_id").withColumn("mid", mid)
    return j.groupBy("motif_id", (F.col("mid") - 500).alias("low"), (F.col("mid") + 500).alias("high")).agg(F.max(F.col("peak_id").isNotNull().cast("int")).alias("y"))


_CHR = "CASE c_nationkey WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrY' WHEN 2 THEN 'chrUn_gl000220' ELSE 'chr' || c_nationkey END"


@query("chromosome_filter_code", f"SELECT c_custkey, CASE c WHEN 'chrX' THEN '23' WHEN 'chrY' THEN '24' ELSE regexp_replace(c, '^chr', '') END AS code FROM (SELECT c_custkey, {_CHR} AS c FROM customer) WHERE length(c) <= 5")
def chromosome_filter_code(spark, sf):
    k = F.col("c_nationkey")
    c = F.when(k == 0, "chrX").when(k == 1, "chrY").when(k == 2, "chrUn_gl000220").otherwise(F.concat(F.lit("chr"), k.cast("string")))
    return table(spark, sf, "customer").select("c_custkey", c.alias("c")).where(F.char_length("c") <= 5).select("c_custkey", S.chromosome_code(F.col("c")).alias("code"))


@query("overlapping_windows", A.sql('SELECT motif_id, s AS start, s + 1001 AS stop, (s <= a.start + 250 AND a.start + 250 <= s + 1001) AS tss FROM (SELECT *, unnest(range(start, start + 1500, 300)) AS s FROM motifs) a', "motifs"))
def overlapping_windows(spark, sf):
    """Windows of 1001 every 300 over 1500 bases, with a flag for the site inside."""
    a = A.intervals(spark, sf)[0]
    w = a.select("motif_id", F.col("start").alias("a"), F.explode(F.sequence(F.col("start"), F.col("start") + 1499, F.lit(300))).alias("start"))
    site = F.col("a") + 250
    return w.select("motif_id", "start", (F.col("start") + 1001).alias("stop"), ((F.col("start") <= site) & (site <= F.col("start") + 1001)).alias("tss"))


DNA = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def dna(spark, sf, name="conversations"):
    """Texts as sequences: letters become bases, everything else N."""
    seq = F.regexp_replace(F.translate(F.lower("text"), *LETTERS), "[^ACGT]", "N")
    return table(spark, sf, name).select("conv_id", "turn", seq.alias("seq"))


SEQ = f"seqs AS (SELECT conv_id, turn, regexp_replace({DNA}, '[^ACGT]', 'N', 'g') AS seq FROM conversations)"


@query("fixed_windows_without_n", f"WITH {SEQ} SELECT conv_id, turn, s::INT AS start, substr(seq, s, 8) AS window FROM (SELECT *, unnest(range(1, length(seq) - 6, 8)) AS s FROM seqs WHERE length(seq) >= 8) WHERE substr(seq, s, 8) NOT LIKE '%N%'")
def fixed_windows_without_n(spark, sf):
    d = dna(spark, sf).where(F.char_length("seq") >= 8).withColumn("start", F.explode(F.sequence(F.lit(1), F.char_length("seq") - 7, F.lit(8))))
    return d.select("conv_id", "turn", "start", F.substring("seq", F.col("start"), F.lit(8)).alias("window")).where(~F.col("window").contains("N"))


@query("gaps_between_n_runs", f"""WITH {SEQ}, p AS (SELECT conv_id * 1000 + turn AS doc, unnest(range(1, length(seq) + 1)) - 1 AS position, seq FROM seqs), n AS (SELECT doc, position, lead(position) OVER (PARTITION BY doc ORDER BY position) AS nxt FROM p WHERE substr(seq, position + 1, 1) = 'N')
  SELECT doc, position + 1 AS start, nxt AS stop FROM n WHERE nxt > position + 1""")  # fmt: skip
def gaps_between_n_runs(spark, sf):
    chars = dna(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.posexplode(F.split("seq", "")).alias("position", "c"))
    marks = chars.where("c = 'N'").select("doc", F.col("position").cast("long").alias("position"))
    return S.gaps_between(marks).select("doc", "start", F.col("end").alias("stop"))


TOK = "tok AS (SELECT conv_id * 1000 + turn AS doc, unnest(range(1, len(l) + 1)) - 1 AS index, unnest(l) AS token FROM (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations))"


def tokens(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.posexplode(F.split("text", " ")).alias("index", "token"))


STARTS = f"{TOK}, st AS (SELECT *, sum(length(token)) OVER (PARTITION BY doc ORDER BY index ROWS UNBOUNDED PRECEDING) - length(token) AS start FROM tok)"


@query("token_start_offsets", f"WITH {STARTS} SELECT doc, index, start::BIGINT AS start FROM st")
def token_start_offsets(spark, sf):
    w = Window.partitionBy("doc").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length("token")
    return tokens(spark, sf).select("doc", F.col("index").cast("long").alias("index"), (F.sum(n).over(w) - n).alias("start"))


@query("position_to_token", f"WITH {STARTS}, p AS (SELECT DISTINCT doc, index * 7 AS position FROM tok) SELECT p.doc, p.position, st.index AS token_index FROM p JOIN st ON p.doc = st.doc AND p.position >= st.start AND p.position < st.start + length(token)")
def position_to_token(spark, sf):
    t = token_start_offsets(spark, sf).join(tokens(spark, sf).select("doc", F.col("index").cast("long").alias("index"), F.char_length("token").alias("length")), ["doc", "index"]).where("length > 0")
    p = tokens(spark, sf).select("doc", (F.col("index") * 7).cast("long").alias("position")).distinct()
    return S.covering_token(t, p)


@query("bigram_scan", f"""WITH {TOK}, l AS (SELECT doc, index, lower(token) AS token FROM tok), h AS (SELECT doc, index, index - row_number() OVER (PARTITION BY doc ORDER BY index) AS island FROM (SELECT *, lead(token) OVER (PARTITION BY doc ORDER BY index) AS nxt FROM l) WHERE token = 'the' AND nxt = 'the')
  SELECT doc, index FROM (SELECT *, row_number() OVER (PARTITION BY doc, island ORDER BY index) % 2 AS odd FROM h) WHERE odd = 1""")  # fmt: skip
def bigram_scan(spark, sf):
    t = tokens(spark, sf).select("doc", F.col("index").cast("long").alias("index"), F.lower("token").alias("token"))
    return S.pair_marks(t, "the", "the")


@query("bpe_merge", """WITH c AS (SELECT conv_id, turn, string_split(lower(text), '') AS l FROM conversations) SELECT conv_id, turn, regexp_replace(lower(text), 'th', '<th>', 'g') AS merged FROM c JOIN conversations USING (conv_id, turn)""")
def bpe_merge(spark, sf):
    """One merge rule over characters; joined tokens are shown in brackets."""
    chars = F.filter(F.split(F.lower("text"), ""), lambda x: x != "")
    merged = F.transform(T.merge_pair(chars, "t", "h"), lambda x: F.when(x == "th", "<th>").otherwise(x))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(merged, "").alias("merged"))


@query("overlapping_kmers", f"WITH {SEQ} SELECT conv_id, turn, array_to_string(list_transform(range(1, greatest(length(seq) - 4, 1)), lambda i: substr(seq, i, 6)), ' ') AS kmers FROM seqs WHERE length(seq) >= 6")
def overlapping_kmers(spark, sf):
    return dna(spark, sf).where(F.char_length("seq") >= 6).select("conv_id", "turn", F.array_join(T.kmers(F.col("seq"), 6), " ").alias("kmers"))


@query("step_kmers", f"WITH {SEQ} SELECT conv_id, turn, array_to_string(list_transform(range(1, length(seq) + 2 - 6, 6), lambda i: substr(seq, i, 6))[1:511], ' ') AS kmers FROM seqs WHERE length(seq) + 1 > 6")
def step_kmers(spark, sf):
    return dna(spark, sf).where(F.char_length("seq") + 1 > 6).select("conv_id", "turn", F.array_join(T.steps(F.col("seq"), 6), " ").alias("kmers"))


_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACG"


@query("kmer_vocabulary", f"""WITH s AS (SELECT translate(lower(p_name), '{_LETTERS}', '{_BASES}') AS s FROM part),
  w AS (SELECT substr(s, i, 4) AS kmer FROM (SELECT s, unnest(range(1, length(s) - 2)) AS i FROM s)), n AS (SELECT kmer, count(*) AS n FROM w GROUP BY 1), b(c) AS (VALUES ('A'), ('C'), ('G'), ('T'))
  SELECT a.c || b.c || d.c || e.c AS kmer, coalesce(n, 0) AS n FROM b a, b, b d, b e LEFT JOIN n ON n.kmer = a.c || b.c || d.c || e.c""")  # fmt: skip
def kmer_vocabulary(spark, sf):
    """All k-mers of four bases, and how often the table's sequences (part names in bases) have each."""
    v = spark.createDataFrame([("",)], "kmer string")
    for _ in range(4):
        v = v.select(F.explode(F.array(*[F.concat("kmer", F.lit(c)) for c in "ACGT"])).alias("kmer"))
    s = table(spark, sf, "part").select(F.translate(F.lower("p_name"), _LETTERS, _BASES).alias("s")).where(F.char_length("s") >= 4)
    found = s.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("s") - 3), lambda i: F.substring(F.col("s"), i, F.lit(4)))).alias("kmer"))
    return v.join(found.groupBy("kmer").agg(F.count("*").alias("n")), "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


@query("next_kmer_target", f"WITH {TOK} SELECT doc, array_to_string(list(token ORDER BY index)[1:5], ' ') AS x, substr(array_to_string(list(token ORDER BY index)[6:], ''), 1, 3) AS y FROM tok GROUP BY doc")
def next_kmer_target(spark, sf):
    c = table(spark, sf, "conversations").withColumn("l", F.split("text", " "))
    rest = F.array_join(F.slice("l", F.lit(6), F.greatest(F.lit(0), F.size("l") - 5)), "")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.array_join(F.slice("l", 1, 5), " ").alias("x"), F.substring(rest, 1, 3).alias("y"))


@query("truncate_tokens", "SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:512], ' ') AS out FROM conversations")
def truncate_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.slice(F.split("text", " "), 1, 512), " ").alias("out"))


@query("pad_and_mask", "WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations), m AS (SELECT *, max(len(l)) OVER (PARTITION BY conv_id) AS n FROM t) SELECT conv_id, turn, n::INT AS length, len(l)::INT AS mask, md5(array_to_string(list_concat(l, list_transform(range(n - len(l)), lambda i: '[PAD]')), ' ')) AS padded FROM m")
def pad_and_mask(spark, sf):
    """Right-padded to the longest of the batch; the mask says which tokens are real."""
    t = table(spark, sf, "conversations").withColumn("l", F.split("text", " "))
    t = t.withColumn("n", F.max(F.size("l")).over(Window.partitionBy("conv_id")))
    padded = T.pad(F.col("l"), F.col("n"), "[PAD]")
    mask = F.size(F.filter(padded, lambda x: x != "[PAD]"))
    return t.select("conv_id", "turn", F.col("n").alias("length"), mask.alias("mask"), F.md5(F.array_join(padded, " ")).alias("padded"))


@query("vocabulary_file", "WITH w AS (SELECT DISTINCT lower(role) AS token FROM conversations), s AS (SELECT * FROM (VALUES (0, '[PAD]'), (1, '[UNK]'), (2, '[CLS]'), (3, '[SEP]'), (4, '[MASK]')) t(id, token)) SELECT id, token FROM s UNION ALL SELECT (4 + row_number() OVER (ORDER BY token))::INT, token FROM w")
def vocabulary_file(spark, sf):
    special = spark.createDataFrame(list(enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"])), "id int, token string")
    w = table(spark, sf, "conversations").select(F.lower("role").alias("token")).distinct()
    return special.unionByName(w.select((F.row_number().over(Window.orderBy("token")) + 4).alias("id"), "token"))


@query("masked_token_choice", f"WITH {TOK}, r AS (SELECT doc, index, token, row_number() OVER (PARTITION BY doc ORDER BY md5(doc || ':' || index), index) AS k FROM tok WHERE token <> '') SELECT doc, index, token AS label FROM r WHERE k = 1")
def masked_token_choice(spark, sf):
    """One position per row by digest; the label is read before it is masked."""
    key = F.md5(F.concat(F.col("doc").cast("string"), F.lit(":"), F.col("index").cast("string")))
    t = tokens(spark, sf).where("token <> ''")
    best = t.groupBy("doc").agg(F.min_by(F.struct("index", "token"), F.struct(key, "index")).alias("b"))
    return best.select("doc", F.col("b.index").cast("long").alias("index"), F.col("b.token").alias("label"))


@query("variant_effect", "SELECT label, round(avg(CASE WHEN vec_id % 2 = 0 THEN embedding[1]::DOUBLE END) - avg(CASE WHEN vec_id % 2 = 1 THEN embedding[1]::DOUBLE END), 6) AS delta FROM embeddings GROUP BY label")
def variant_effect(spark, sf):
    x = F.get("embedding", F.lit(0)).cast("double")
    even = F.col("vec_id") % 2 == 0
    return table(spark, sf, "embeddings").groupBy("label").agg(R(F.avg(F.when(even, x)) - F.avg(F.when(~even, x))).alias("delta"))


@query("union_of_experiments", "SELECT o_orderkey AS id, 'orders' AS origin FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def union_of_experiments(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("origin"))
    return a.unionByName(table(spark, sf, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id")))


_SIDES = ("SELECT l_orderkey AS gene FROM lineitem WHERE l_returnflag = 'A'", "SELECT l_orderkey AS gene FROM lineitem WHERE l_returnflag = 'R'")


def sides(spark, sf):
    li = table(spark, sf, "lineitem")
    return [li.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("gene")) for f in "AR"]


@query("gene_intersection", f"{_SIDES[0]} INTERSECT {_SIDES[1]}")
def gene_intersection(spark, sf):
    a, b = sides(spark, sf)
    return a.intersect(b)


@query("gene_difference", f"{_SIDES[0]} EXCEPT {_SIDES[1]}")
def gene_difference(spark, sf):
    a, b = sides(spark, sf)
    return a.subtract(b)


@query("gene_union", f"{_SIDES[0]} UNION {_SIDES[1]}")
def gene_union(spark, sf):
    a, b = sides(spark, sf)
    return a.union(b).distinct()


@query("global_sort", "SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_brand, p_retailprice DESC, p_partkey")
def global_sort(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice").orderBy("p_brand", F.desc("p_retailprice"), "p_partkey")


@query("first_rows", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 300")
def first_rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(300)


@query("seeded_shuffle", "SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || ':5'), c_custkey) AS position FROM customer")
def seeded_shuffle(spark, sf):
    from heddle.operators.order import with_position
    from heddle.operators.splits import digest

    c = table(spark, sf, "customer").select("c_custkey", F.struct(digest(F.col("c_custkey"), 5).alias("d"), "c_custkey").alias("k"))
    return with_position(c, "k", "position").select("c_custkey", F.col("position").cast("long").alias("position"))


@query("drop_duplicate_rows", "SELECT DISTINCT user_id, event_type FROM events")
def drop_duplicate_rows(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").dropDuplicates()


@query("complete_rows", "SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def complete_rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").na.drop()


@query("drop_deceased", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal <= 0")
def drop_deceased(spark, sf):
    """Rows with a positive mark go, then the column of marks."""
    return table(spark, sf, "customer").where("c_acctbal <= 0").drop("c_acctbal")


@query("uniqueness_check", "SELECT 'lineitem' AS name, count(*) - count(DISTINCT l_orderkey) AS repeats FROM lineitem UNION ALL SELECT 'documents', count(*) - count(DISTINCT doc_id) FROM documents")
def uniqueness_check(spark, sf):
    one = lambda n, k: table(spark, sf, n).agg((F.count("*") - F.count_distinct(k)).alias("repeats")).select(F.lit(n).alias("name"), "repeats")
    return one("lineitem", "l_orderkey").unionByName(one("documents", "doc_id"))


@query("names_made_unique", "SELECT p_partkey, p_name || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)")
def names_made_unique(spark, sf):
    k = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) - 1
    p = table(spark, sf, "part").select("p_partkey", "p_name", k.alias("k"))
    return p.select("p_partkey", F.concat("p_name", F.when(F.col("k") > 0, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("")).alias("name"))


@query("column_domains", "SELECT 'p_brand' AS name, p_brand AS value FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type FROM part GROUP BY 2")
def column_domains(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").unpivot([], ["p_brand", "p_type"], "name", "value").distinct()


@query("expressed_genes", A.sql("SELECT c_custkey FROM customer SEMI JOIN expr ON sample_id = c_custkey", "expr"))
def expressed_genes(spark, sf):
    return table(spark, sf, "customer").join(A.expr(spark, sf).withColumnRenamed("sample_id", "c_custkey"), "c_custkey", "left_semi").select("c_custkey")


@query("knee_location", A.sql("""WITH t AS (SELECT gene_id, sum(value) AS v FROM expr GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY v DESC, gene_id) AS i, v FROM t),
  n AS (SELECT i, (i - 1) / (max(i) OVER () - 1)::DOUBLE AS x, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS y FROM r), d AS (SELECT i, 1 - y - x AS d FROM n)
  SELECT i FROM d ORDER BY round(d, 9) DESC, i LIMIT 1""", "expr"))  # fmt: skip
def knee_location(spark, sf):
    """Where a falling convex curve lies furthest below its chord. One row per gene is ordered."""
    t = A.expr(spark, sf).groupBy("gene_id").agg(F.sum("value").alias("v"))
    r = t.select(F.row_number().over(Window.orderBy(F.desc("v"), "gene_id")).cast("long").alias("i"), "v")
    s = r.join(F.broadcast(r.agg(F.max("i").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))), how="cross")
    d = 1 - (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) - (F.col("i") - 1) / (F.col("n") - 1)
    return s.select("i", F.round(d, 9).alias("d")).orderBy(F.desc("d"), "i").limit(1).select("i")


@query("half_even_rounding", "SELECT p_partkey, round_even(p_retailprice / 4, 1) AS rounded, round(log10(p_retailprice + 1), 6) AS log10, sign(p_size - 25)::DOUBLE AS sign, greatest(0, p_size - 25) AS clipped FROM part")
def half_even_rounding(spark, sf):
    p = F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", F.bround((p / 4), 1).alias("rounded"), R(F.log10(p + 1)).alias("log10"), F.signum(F.col("p_size") - 25).alias("sign"), F.greatest(F.lit(0), F.col("p_size") - 25).alias("clipped"))
