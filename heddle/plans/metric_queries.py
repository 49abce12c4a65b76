"""Queries that evaluate predictions, discoveries and experiments, and splits of data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.operators import metrics as E
from heddle.operators.matrix import one_row, ratio
from heddle.plans import adapters as A
from heddle.plans.registry import query
from heddle.workspace import table

R = lambda c: F.round(c, 6)


@query("confusion_matrix", A.sql("SELECT y, yhat, count(*) AS n FROM multi GROUP BY 1, 2", "multi"))
def confusion_matrix(spark, sf):
    return E.confusion(A.multi(spark, sf))


CLASSES = """t AS (SELECT y AS label, count(*) AS support, count(*) FILTER (WHERE y = yhat) AS tp FROM multi GROUP BY 1), p AS (SELECT yhat AS label, count(*) AS predicted FROM multi GROUP BY 1),
  s AS (SELECT label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp FROM t FULL JOIN p USING (label)),
  pr AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall FROM s),
  per AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


@query("per_class_scores", A.sql(f"WITH {CLASSES} SELECT label, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per", "multi"))
def per_class_scores(spark, sf):
    s = E.per_class(E.confusion(A.multi(spark, sf)))
    return s.select("label", "support", "predicted", "tp", *[R(m).alias(m) for m in ("precision", "recall", "f1")])


@query("averaged_scores", A.sql(f"""WITH {CLASSES} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(tp) / sum(predicted), 6) AS precision_micro, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
  round(avg(f1), 6) AS f1_macro, round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM per""", "multi"))  # fmt: skip
def averaged_scores(spark, sf):
    a = E.averages(E.confusion(A.multi(spark, sf)))
    return a.select(*[R(c).alias(c) for c in a.columns])


@query("binary_scores", A.sql("""WITH c AS (SELECT count(*) FILTER (WHERE y = 1 AND yhat = 1)::DOUBLE AS tp, count(*) FILTER (WHERE yhat = 1) AS p, count(*) FILTER (WHERE y = 1) AS t FROM preds)
  SELECT round(coalesce(tp / nullif(p, 0), 0), 6) AS precision, round(coalesce(tp / nullif(t, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(p + t, 0), 0), 6) AS f1 FROM c""", "preds"))  # fmt: skip
def binary_scores(spark, sf):
    return E.per_class(E.confusion(A.preds(spark, sf))).where("label = 1").select(*[R(m).alias(m) for m in ("precision", "recall", "f1")])


@query("matthews_correlation", A.sql(f"WITH {CLASSES} SELECT round(coalesce((sum(tp)::DOUBLE * sum(support) - sum(predicted * support)) / nullif(sqrt((sum(support)::DOUBLE ** 2 - sum(predicted * predicted)) * (sum(support)::DOUBLE ** 2 - sum(support * support))), 0), 0), 6) AS mcc FROM per", "multi"))
def matthews_correlation(spark, sf):
    return E.matthews(E.confusion(A.multi(spark, sf))).select(R("mcc").alias("mcc"))


@query("roc_curve", A.sql("""WITH c AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM preds GROUP BY score)
  SELECT score AS threshold, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""", "preds"))  # fmt: skip
def roc_curve(spark, sf):
    s = E.score_steps(A.preds(spark, sf), [])
    return s.select(F.col("score").alias("threshold"), R(F.col("tp") / F.col("pos")).alias("tpr"), R(F.col("fp") / F.col("neg")).alias("fpr"))


@query("roc_auc", A.sql("""WITH r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM preds)
  SELECT round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r""", "preds"))  # fmt: skip
def roc_auc(spark, sf):
    return E.auc(A.preds(spark, sf), []).select(R("auc").alias("auc"))


_OVR = f"""ovr AS (SELECT row_id, k.label, (y = k.label)::INT AS y, (yhat = k.label)::INT + (row_id * 7 % 11) / 10.0::DOUBLE AS score FROM multi, (SELECT unnest({list(A.SEGMENTS)!r}) AS label) k),
  r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS rk FROM ovr),
  a AS (SELECT label, sum(y) AS support, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY label)"""


def ovr(spark, sf):
    each = A.multi(spark, sf).withColumn("label", F.explode(F.array(*map(F.lit, A.SEGMENTS))))
    score = (F.col("yhat") == F.col("label")).cast("int") + (F.col("row_id") * 7 % 11) / 10.0
    return E.auc(each.select("label", (F.col("y") == F.col("label")).cast("int").alias("y"), score.alias("score")), ["label"])


@query("roc_auc_per_class", A.sql(f"WITH {_OVR} SELECT label, support::BIGINT AS support, round(auc, 6) AS auc FROM a", "multi"))
def roc_auc_per_class(spark, sf):
    return ovr(spark, sf).select("label", F.col("pos").alias("support"), R("auc").alias("auc"))


@query("roc_auc_ovr", A.sql(f"WITH {_OVR} SELECT round(avg(auc), 6) AS macro, round(sum(auc * support) / sum(support), 6) AS weighted FROM a", "multi"))
def roc_auc_ovr(spark, sf):
    return ovr(spark, sf).agg(R(F.avg("auc")).alias("macro"), R(F.sum(F.col("auc") * F.col("pos")) / F.sum("pos")).alias("weighted"))


@query("top_k_accuracy", """WITH s AS (SELECT vec_id, label, unnest(range(10)) AS c, list_transform(range(10), lambda i: embedding[i + 1]::DOUBLE) AS e FROM embeddings), t AS (SELECT vec_id, label, count(*) FILTER (WHERE e[c + 1] > e[label + 1]) AS above FROM s GROUP BY 1, 2)
  SELECT label, count(*) AS n, round(avg((above < 1)::INT), 6) AS top1, round(avg((above < 3)::INT), 6) AS top3 FROM t GROUP BY label""")  # fmt: skip
def top_k_accuracy(spark, sf):
    """Per true class, how often it is among the k highest of ten scores."""
    scores = F.slice("embedding", 1, 10)
    above = F.size(F.filter(scores, lambda x: x > F.get(scores, F.col("label"))))
    e = table(spark, sf, "embeddings").select("label", above.alias("above"))
    hit = lambda k: R(F.avg((F.col("above") < k).cast("int")))
    return e.groupBy("label").agg(F.count("*").alias("n"), hit(1).alias("top1"), hit(3).alias("top3"))


@query("adjusted_rand", A.sql("""WITH c AS (SELECT y, yhat, count(*)::DOUBLE AS n FROM multi GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM c),
  a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY y)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY yhat))
  SELECT round((i - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM i, a, b""", "multi"))  # fmt: skip
def adjusted_rand(spark, sf):
    return E.adjusted_rand(A.multi(spark, sf), "y", "yhat").select(R("ari").alias("ari"))


@query("frequency_table", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def frequency_table(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return one_row(n, n.agg(F.sum("n").alias("t"))).select("event_type", "n", R(F.col("n") / F.col("t")).alias("share"))


#: A day ends at midnight, not half a second before. Means have nine decimals, so that the order in which
#: values are summed decides neither what ties nor the remainder of a whole number.
RUNS = "runs AS (SELECT user_id AS run, floor(epoch_us(ts) / 86400000000.0)::BIGINT % 7 AS iter, avg(value)::DECIMAL(38, 9)::DOUBLE AS score, count(*) AS n FROM events GROUP BY 1, 2)"


def nine(c):
    return c.cast("decimal(38,9)").cast("double")


def half_up(c, digits=6):
    """Rounded, ties away from zero, from a decimal of three digits more, in SQL too."""
    return F.round(c.cast(f"decimal(38,{digits + 3})"), digits).cast("double")


def runs(spark, sf):
    it = F.floor(F.unix_timestamp("ts") / 86400) % 7
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run"), it.alias("iter")).agg(nine(F.avg("value")).alias("score"), F.count("*").alias("n"))


@query("iteration_statistics", f"WITH {RUNS} SELECT run, round(avg(score)::DECIMAL(38, 9), 6)::DOUBLE AS mean, round(stddev_pop(score)::DECIMAL(38, 9), 6)::DOUBLE AS sd, count(*) AS iterations FROM runs GROUP BY run")
def iteration_statistics(spark, sf):
    return runs(spark, sf).groupBy("run").agg(half_up(F.avg("score")).alias("mean"), half_up(F.stddev_pop("score")).alias("sd"), F.count("*").alias("iterations"))


@query("average_confusion", A.sql("WITH c AS (SELECT row_id % 4 AS iter, y, yhat, count(*) AS n FROM multi GROUP BY 1, 2, 3), s AS (SELECT count(*) AS rows FROM multi) SELECT y, yhat, round(sum(n) / any_value(rows)::DOUBLE, 6) AS share FROM c, s GROUP BY y, yhat", "multi"))
def average_confusion(spark, sf):
    """Confusion tables of several iterations, averaged, as shares of the tested rows."""
    m = A.multi(spark, sf)
    c = m.groupBy((F.col("row_id") % 4).alias("iter"), "y", "yhat").agg(F.count("*").alias("n")).groupBy("y", "yhat").agg(F.sum("n").alias("n"))
    return one_row(c, m.agg(F.count("*").alias("rows"))).select("y", "yhat", R(F.col("n") / F.col("rows")).alias("share"))


@query("median_and_argmedian", "WITH r AS (SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_mktsegment, round(median(c_acctbal), 6) AS median, max(c_custkey) FILTER (WHERE k = n // 2 + 1) AS argmedian FROM r GROUP BY 1")
def median_and_argmedian(spark, sf):
    """Median, and the row in the middle."""
    w = Window.partitionBy("c_mktsegment")
    r = table(spark, sf, "customer").withColumns({"k": F.row_number().over(w.orderBy("c_acctbal", "c_custkey")), "n": F.count("*").over(w)})
    middle = F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("c_custkey")))
    return r.groupBy("c_mktsegment").agg(R(F.median("c_acctbal")).alias("median"), middle.alias("argmedian"))


@query("five_number_summary", "SELECT c_mktsegment, " + ", ".join(f"round(quantile_cont(c_acctbal, {q}), 6) AS q{int(q * 100)}" for q in (0.0, 0.25, 0.5, 0.75, 1.0)) + " FROM customer GROUP BY 1")
def five_number_summary(spark, sf):
    q = (0.0, 0.25, 0.5, 0.75, 1.0)
    s = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.percentile("c_acctbal", F.array(*map(F.lit, q))).alias("p"))
    return s.select("c_mktsegment", *[R(F.get("p", F.lit(i))).alias(f"q{int(x * 100)}") for i, x in enumerate(q)])


@query("histogram", "WITH r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 50 AS w FROM events) SELECT least(49, floor((value - lo) / w))::INT AS bin, count(*) AS n FROM events, r GROUP BY 1")
def histogram(spark, sf):
    e = table(spark, sf, "events")
    r = e.agg(F.min("value").alias("lo"), ((F.max("value") - F.min("value")) / 50).alias("w"))
    b = F.least(F.lit(49), F.floor(F.try_divide(F.col("value") - F.col("lo"), F.col("w")))).cast("int")
    return one_row(e, r).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


_SETS = """gt AS (SELECT o_custkey % 10 AS gt, list(DISTINCT (l_partkey % 200)::INT) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 200 < (o_custkey % 10 + 1) * 12 GROUP BY 1),
  disc AS (SELECT o_custkey % 8 AS disc, list(DISTINCT (l_partkey % 200)::INT) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_partkey * 7 + o_custkey) % 200 < 60 AND l_partkey % 200 < (o_custkey % 8 + 1) * 16 GROUP BY 1)"""


def sets(spark, sf):
    """Two families of gene sets: (gt, a) and (disc, b)."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = (F.col("l_partkey") % 200).cast("int")
    gt = j.where(F.col("l_partkey") % 200 < (F.col("o_custkey") % 10 + 1) * 12).groupBy((F.col("o_custkey") % 10).alias("gt")).agg(F.collect_set(g).alias("a"))
    hit = ((F.col("l_partkey") * 7 + F.col("o_custkey")) % 200 < 60) & (F.col("l_partkey") % 200 < (F.col("o_custkey") % 8 + 1) * 16)
    return gt, j.where(hit).groupBy((F.col("o_custkey") % 8).alias("disc")).agg(F.collect_set(g).alias("b"))


_PAIRS = f"{_SETS}, pairs AS (SELECT gt, disc, len(list_intersect(a, b)) AS c, len(a) AS na, len(b) AS nb FROM gt, disc)"


def similar(spark, sf):
    """Set scores of each truth and each discovery: members meet in a join on the gene."""
    gt, disc = sets(spark, sf)
    a = gt.select("gt", F.size("a").alias("na"), F.explode("a").alias("g"))
    b = disc.select("disc", F.size("b").alias("nb"), F.explode("b").alias("g"))
    common = a.join(b, "g").groupBy("gt", "disc", "na", "nb").agg(F.count("*").alias("c"))
    grid = one_row(gt.select("gt", F.size("a").alias("na")), disc.agg(F.collect_list(F.struct("disc", F.size("b").alias("nb"))).alias("d"))).select("gt", "na", F.explode("d").alias("d")).select("gt", "na", "d.*")
    return grid.join(common, ["gt", "disc", "na", "nb"], "left").na.fill(0, ["c"])


@query("mechanism_similarity", A.sql(f"WITH {_PAIRS} SELECT gt, disc, round(c / (na + nb - c)::DOUBLE, 6) AS jaccard, round(c / nb::DOUBLE, 6) AS precision, round(c / na::DOUBLE, 6) AS recall, round(coalesce(2 * c / nullif(na + nb, 0)::DOUBLE, 0), 6) AS f1 FROM pairs"))
def mechanism_similarity(spark, sf):
    s, c = similar(spark, sf), F.col("c")
    return s.select("gt", "disc", R(ratio(c, F.col("na") + F.col("nb") - c)).alias("jaccard"), R(ratio(c, F.col("nb"))).alias("precision"), R(ratio(c, F.col("na"))).alias("recall"), R(ratio(2 * c, F.col("na") + F.col("nb"))).alias("f1"))


@query("set_scores", A.sql(f"WITH {_PAIRS} SELECT gt, round(c / (na + nb - c)::DOUBLE, 6) AS jaccard, round(c / nb::DOUBLE, 6) AS precision, round(c / na::DOUBLE, 6) AS recall, round(coalesce(2 * c / nullif(na + nb, 0)::DOUBLE, 0), 6) AS f1 FROM pairs WHERE gt = disc"))
def set_scores(spark, sf):
    """The same from arrays, truth and discovery of the same number."""
    gt, disc = sets(spark, sf)
    j = gt.join(disc, F.col("gt") == F.col("disc"))
    return j.select("gt", *[R(v).alias(k) for k, v in E.set_scores(F.col("a"), F.col("b")).items()])


@query("recovery_rate", A.sql(f"WITH {_PAIRS}, best AS (SELECT gt, max(c / (na + nb - c)::DOUBLE) AS j FROM pairs GROUP BY gt) SELECT round(avg((j > 0.3)::INT), 6) AS recovered, round(avg(j), 6) AS mean, round(max(j), 6) AS best FROM best"))
def recovery_rate(spark, sf):
    b = similar(spark, sf).groupBy("gt").agg(F.max(ratio(F.col("c"), F.col("na") + F.col("nb") - F.col("c"))).alias("j"))
    return b.agg(R(F.avg((F.col("j") > 0.3).cast("int"))).alias("recovered"), R(F.avg("j")).alias("mean"), R(F.max("j")).alias("best"))


@query("greedy_matching", A.sql(f"""WITH RECURSIVE {_PAIRS}, sc AS (SELECT gt, disc, c / (na + nb - c)::DOUBLE AS score FROM pairs),
  m(gt, used, disc, score) AS (SELECT -1::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::DOUBLE UNION ALL
    SELECT m.gt + 1, CASE WHEN b.score > 0.1 THEN list_append(m.used, b.disc) ELSE m.used END, CASE WHEN b.score > 0.1 THEN b.disc END, b.score
    FROM m LEFT JOIN LATERAL (SELECT sc.disc, sc.score FROM sc WHERE sc.gt = m.gt + 1 AND NOT list_contains(m.used, sc.disc) ORDER BY sc.score DESC, sc.disc LIMIT 1) b ON true WHERE m.gt < 9)
  SELECT gt, disc, round(score, 6) AS score FROM m WHERE disc IS NOT NULL"""))  # fmt: skip
def greedy_matching(spark, sf):
    """Each match depends on those before it."""
    s = similar(spark, sf).select("gt", "disc", ratio(F.col("c"), F.col("na") + F.col("nb") - F.col("c")).alias("score"))
    return E.greedy_match(s).withColumn("score", R("score"))


@query("gene_coverage", A.sql(f"WITH {_SETS}, t AS (SELECT DISTINCT unnest(a) AS g FROM gt), d AS (SELECT DISTINCT unnest(b) AS g FROM disc) SELECT count(*) FILTER (WHERE d.g IS NOT NULL) AS hits, count(*) AS truths, round(count(*) FILTER (WHERE d.g IS NOT NULL) / count(*)::DOUBLE, 6) AS coverage FROM t LEFT JOIN d USING (g)"))
def gene_coverage(spark, sf):
    gt, disc = sets(spark, sf)
    t, d = gt.select(F.explode("a").alias("g")).distinct(), disc.select(F.explode("b").alias("g")).distinct()
    n, h = t.agg(F.count("*").alias("truths")), t.join(d, "g", "left_semi").agg(F.count("*").alias("hits"))
    return one_row(h, n).select("hits", "truths", R(ratio(F.col("hits"), F.col("truths"))).alias("coverage"))


@query("edge_coverage", A.sql(f"""WITH {_SETS}, m AS (SELECT gt, unnest(a) AS g FROM gt), pairs AS (SELECT DISTINCT x.g AS g1, y.g AS g2 FROM m x JOIN m y ON x.gt = y.gt AND x.g <> y.g), e AS (SELECT DISTINCT (l_partkey % 200)::INT AS g1, (l_suppkey % 200)::INT AS g2 FROM lineitem)
  SELECT count(*) AS pairs, count(*) FILTER (WHERE e.g1 IS NOT NULL) AS hits, round(count(*) FILTER (WHERE e.g1 IS NOT NULL) / count(*)::DOUBLE, 6) AS coverage FROM pairs LEFT JOIN e USING (g1, g2)"""))  # fmt: skip
def edge_coverage(spark, sf):
    """All ordered pairs within a mechanism against the edges of a graph."""
    m = sets(spark, sf)[0].select("gt", F.explode("a").alias("g"))
    pairs = m.select("gt", F.col("g").alias("g1")).join(m.select("gt", F.col("g").alias("g2")), "gt").where("g1 <> g2").select("g1", "g2").distinct()
    e = table(spark, sf, "lineitem").select((F.col("l_partkey") % 200).cast("int").alias("g1"), (F.col("l_suppkey") % 200).cast("int").alias("g2")).distinct().withColumn("hit", F.lit(1))
    s = pairs.join(e, ["g1", "g2"], "left").agg(F.count("*").alias("pairs"), F.count("hit").alias("hits"))
    return s.select("pairs", "hits", R(ratio(F.col("hits"), F.col("pairs"))).alias("coverage"))


@query("global_scores", f"""WITH {RUNS}, e AS (SELECT run, iter, score, n, greatest(0, 100 - score / 300 * 50) AS t, greatest(0, 100 - n * 10 / 1000.0 * 30) AS m FROM runs)
  SELECT run, iter, round(((t + m) / 2)::DECIMAL(38, 12), 9)::DOUBLE AS efficiency, round(least(100, greatest(0, 0.4 * (score % 100) + 0.2 * (n % 100) + 0.2 * 70 + 0.2 * (70 + ((t + m) / 2 - 50) * 0.1)))::DECIMAL(38, 12), 9)::DOUBLE AS score FROM e""")  # fmt: skip
def global_scores(spark, sf):
    eff = E.efficiency(F.col("score"), F.col("n") * 10)
    g = E.global_score(F.col("score") % 100, F.col("n") % 100, eff)
    return runs(spark, sf).select("run", "iter", half_up(eff, 9).alias("efficiency"), half_up(g, 9).alias("score"))


@query("best_per_algorithm", f"WITH {RUNS} SELECT run, arg_max(iter, (score, iter)) AS iter, round(max(score)::DECIMAL(38, 9), 6)::DOUBLE AS score FROM runs GROUP BY run")
def best_per_algorithm(spark, sf):
    return runs(spark, sf).groupBy("run").agg(F.max_by("iter", F.struct("score", "iter")).alias("iter"), half_up(F.max("score")).alias("score"))


@query("argmin_over_k", f"WITH {RUNS} SELECT run, arg_min(iter, (score, iter)) AS k FROM runs GROUP BY run")
def argmin_over_k(spark, sf):
    return runs(spark, sf).groupBy("run").agg(F.min_by("iter", F.struct("score", "iter")).alias("k"))


@query("average_coefficients", "WITH c AS (SELECT i - 1 AS feature, avg(embedding[i]::DOUBLE) AS coef FROM embeddings, range(1, 65) r(i) GROUP BY 1) SELECT feature, round(coef, 6) AS coef, coef = 0 AS zero, coef > 0.01 AS large FROM c")
def average_coefficients(spark, sf):
    c = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("feature", "v")).groupBy(F.col("feature").cast("long").alias("feature")).agg(F.avg(F.col("v").cast("double")).alias("coef"))
    return c.select("feature", R("coef").alias("coef"), (F.col("coef") == 0).alias("zero"), (F.col("coef") > 0.01).alias("large"))


@query("self_similarity", "WITH u AS (SELECT label, i, sum(embedding[i]::DOUBLE / n) AS s FROM (SELECT label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings), range(1, 65) r(i) GROUP BY 1, 2), k AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, k.n, round((sum(s * s) - k.n) / (k.n * (k.n - 1)), 6) AS similarity FROM u JOIN k USING (label) GROUP BY label, k.n")
def self_similarity(spark, sf):
    """Mean cosine of all pairs of a class: from the squared norm of the sum of unit vectors."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    e = table(spark, sf, "embeddings").select("label", norm.alias("n"), "embedding").select("label", "n", F.posexplode("embedding").alias("i", "x"))
    u = e.groupBy("label", "i").agg(F.sum(F.col("x").cast("double") / F.col("n")).alias("s"), F.count("*").alias("k"))
    return u.groupBy("label").agg(F.max("k").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).select("label", "n", R(ratio(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1))).alias("similarity"))


@query("stratified_split", """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, CASE WHEN k <= floor(0.2 * n) THEN 'test' WHEN k <= floor(0.4 * n) THEN 'validation' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, sf):
    from heddle.operators.splits import stratified

    return stratified(table(spark, sf, "labels"), "doc_id", "quality", {"test": 0.2, "validation": 0.2}, 42).select("doc_id", "quality", "part")


@query("hash_split", "SELECT doc_id, CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.9 THEN 'validation' ELSE 'test' END AS part FROM (SELECT doc_id, ('0x' || substr(md5(doc_id || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS h FROM documents)")
def hash_split(spark, sf):
    from heddle.operators.splits import unit_hash

    h = unit_hash(F.col("doc_id"), 7)
    return table(spark, sf, "documents").select("doc_id", F.when(h < 0.8, "train").when(h < 0.9, "validation").otherwise("test").alias("part"))


@query("cross_validation_folds", "SELECT doc_id, floor(('0x' || substr(md5(doc_id || ':3'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 10)::INT AS fold FROM documents")
def cross_validation_folds(spark, sf):
    from heddle.operators.splits import unit_hash

    return table(spark, sf, "documents").select("doc_id", F.floor(unit_hash(F.col("doc_id"), 3) * 10).cast("int").alias("fold"))


@query("row_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || ':11'), doc_id LIMIT 100")
def row_sample(spark, sf):
    from heddle.operators.splits import digest

    return table(spark, sf, "documents").orderBy(digest(F.col("doc_id"), 11), "doc_id").limit(100).select("doc_id")


@query("train_without_examples", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def train_without_examples(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("label_encoding", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM customer")
def label_encoding(spark, sf):
    """Codes by the order of labels: ranks of the distinct labels, joined back."""
    c = table(spark, sf, "customer")
    codes = c.select("c_mktsegment").distinct().withColumn("code", F.row_number().over(Window.orderBy("c_mktsegment")) - 1)
    return c.join(codes, "c_mktsegment").select("c_custkey", "code")


@query("recursive_feature_cut", "WITH c AS (SELECT i - 1 AS feature, avg(embedding[i]::DOUBLE) AS coef FROM embeddings, range(1, 65) r(i) GROUP BY 1), k AS (SELECT feature, row_number() OVER (ORDER BY round(abs(coef), 9), feature) AS rk FROM c) SELECT round::INT AS round, feature FROM k, range(0, 7) x(round) WHERE rk > 10 * round")
def recursive_feature_cut(spark, sf):
    """In each round the ten least important features more are gone."""
    m = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("feature", "v")).groupBy(F.col("feature").cast("long").alias("feature")).agg(F.avg(F.col("v").cast("double")).alias("coef"))
    k = m.withColumn("rk", F.row_number().over(Window.orderBy(F.round(F.abs("coef"), 9), "feature")))
    return k.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(6)))).where("rk > 10 * round").select("round", "feature")


@query("parameter_grid", """WITH f AS (SELECT doc_id % 5 AS fold, count(*) AS validated FROM labels GROUP BY 1)
  SELECT n_estimators, max_depth, fold, (SELECT count(*) FROM labels) - validated AS trained, validated FROM range(100, 401, 100) a(n_estimators), (VALUES (3), (5), (7)) b(max_depth), f""")
def parameter_grid(spark, sf):
    """Each setting with each fold of the labelled rows, and the rows it trains and validates on."""
    labels = table(spark, sf, "labels")
    folds = labels.groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.count("*").alias("validated"))
    every = one_row(folds, labels.agg(F.count("*").alias("_n")))
    settings = F.array(*[F.struct(F.lit(n).cast("long").alias("n_estimators"), F.lit(d).alias("max_depth")) for n in range(100, 401, 100) for d in (3, 5, 7)])
    return every.select("*", F.inline(settings)).select("n_estimators", "max_depth", "fold", (F.col("_n") - F.col("validated")).alias("trained"), "validated")


@query("training_history", "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 500)::INT AS step, round(exp(value / 100), 6) AS perplexity FROM events WHERE event_type = 'view'")
def training_history(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'view'")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) * 500
    return e.select("event_id", step.alias("step"), R(F.exp(F.col("value") / 100)).alias("perplexity"))


@query("experiment_pivot", "SELECT p_brand, " + ", ".join(f"max(p_retailprice) FILTER (WHERE p_size % 5 + 2 = {k}) AS n{k}" for k in range(2, 7)) + " FROM part GROUP BY 1")
def experiment_pivot(spark, sf):
    p = table(spark, sf, "part").withColumn("n", F.concat(F.lit("n"), (F.col("p_size") % 5 + 2).cast("string")))
    return p.groupBy("p_brand").pivot("n", [f"n{k}" for k in range(2, 7)]).agg(F.max("p_retailprice"))


@query("argmax_ignoring", "SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS prediction, label FROM embeddings WHERE label <> 0")
def argmax_ignoring(spark, sf):
    """Argmax of scores; rows of the ignored label are left out."""
    e = table(spark, sf, "embeddings").where("label <> 0")
    return e.select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("prediction"), "label")
