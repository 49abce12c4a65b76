"""Queries on count matrices: shaping, quality control, filters, normalisation, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.functions.special import normal_two_sided, t_two_sided
from heddle.operators import matrix as M
from heddle.plans import adapters as A
from heddle.plans.registry import query
from heddle.workspace import table

R = lambda c: F.round(c, 6)


def n_cells(spark, sf):
    return A.counts(spark, sf).agg(F.count_distinct("cell_id").alias("rows"))


def n_samples(spark, sf):
    return A.expr(spark, sf).agg(F.count_distinct("sample_id").alias("rows"))


def flags(spark):
    return spark.range(A.GENES).select(F.col("id").alias("gene_id"), (F.col("id") % 20 == 0).alias("mt"), (F.col("id") % 20 == 1).alias("ribo"), (F.col("id") % 20 == 2).alias("hb"))


QC = """qc AS (SELECT cell_id, count(*) FILTER (WHERE value > 0) AS n_genes_by_counts, sum(value) AS total_counts,
  coalesce(sum(value) FILTER (WHERE rk <= 50), 0) AS top, coalesce(sum(value) FILTER (WHERE gene_id % 20 = 0), 0) AS total_counts_mt,
  coalesce(sum(value) FILTER (WHERE gene_id % 20 = 1), 0) AS total_counts_ribo, coalesce(sum(value) FILTER (WHERE gene_id % 20 = 2), 0) AS total_counts_hb
  FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene_id) AS rk FROM counts) GROUP BY cell_id)"""


@query("qc_cell_metrics", A.sql(f"""WITH {QC} SELECT cell_id, n_genes_by_counts, total_counts, round(ln(1 + n_genes_by_counts), 6) AS log1p_n_genes_by_counts,
  round(ln(1 + total_counts), 6) AS log1p_total_counts, round(100.0 * coalesce(top / nullif(total_counts, 0), 0), 6) AS pct_counts_in_top_50_genes,
  total_counts_mt, total_counts_ribo, total_counts_hb, round(100.0 * coalesce(total_counts_mt / nullif(total_counts, 0), 0), 6) AS pct_counts_mt,
  round(100.0 * coalesce(total_counts_ribo / nullif(total_counts, 0), 0), 6) AS pct_counts_ribo, round(100.0 * coalesce(total_counts_hb / nullif(total_counts, 0), 0), 6) AS pct_counts_hb
  FROM qc""", "counts"))  # fmt: skip
def qc_cell_metrics(spark, sf):
    qc = M.cell_qc(A.counts(spark, sf), flags(spark))
    return qc.select(*[R(c).alias(c) if c.startswith(("log", "pct")) else c for c in qc.columns])


@query("qc_gene_metrics", A.sql("""SELECT gene_id, sum(value) AS total_counts, count(*) FILTER (WHERE value > 0) AS n_cells_by_counts,
  round(sum(value) / any_value(n), 6) AS mean_counts, round(100.0 * (1 - count(*) FILTER (WHERE value > 0) / any_value(n)::DOUBLE), 6) AS pct_dropout_by_counts
  FROM counts, (SELECT count(DISTINCT cell_id) AS n FROM counts) GROUP BY gene_id""", "counts"))  # fmt: skip
def qc_gene_metrics(spark, sf):
    s = M.gene_stats(A.counts(spark, sf), "gene_id", n_cells(spark, sf))
    return s.select("gene_id", F.col("total").alias("total_counts"), F.col("n").alias("n_cells_by_counts"), R("mean").alias("mean_counts"), R(100.0 * (1 - F.col("n") / F.col("rows"))).alias("pct_dropout_by_counts"))


FILTERED = f"{QC}, kept AS (SELECT c.* FROM counts c SEMI JOIN (SELECT cell_id FROM qc WHERE n_genes_by_counts >= 3 AND total_counts >= 50 AND 100.0 * total_counts_mt / total_counts < 20) g USING (cell_id))"


def filtered(spark, sf):
    counts = A.counts(spark, sf)
    return M.filter_cells(counts, M.cell_qc(counts, flags(spark)), 3, 50, 20)


@query("filter_cells", A.sql(f"WITH {FILTERED} SELECT cell_id, gene_id, value FROM kept", "counts"))
def filter_cells(spark, sf):
    return filtered(spark, sf)


NORMAL = f"{FILTERED}, normal AS (SELECT cell_id, gene_id, ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY cell_id)) AS value FROM kept)"


@query("normalise_log1p", A.sql(f"WITH {NORMAL} SELECT cell_id, gene_id, round(value, 6) AS value FROM normal", "counts"))
def normalise_log1p(spark, sf):
    return M.normalise(filtered(spark, sf)).withColumn("value", R("value"))


@query("qc_filter_normalize", A.sql(f"""WITH {NORMAL}, lab AS (SELECT DISTINCT cell_id, y FROM kept JOIN obs USING (cell_id)),
  sizes AS (SELECT sum(y) AS n1, sum(1 - y) AS n0 FROM lab)
  SELECT gene_id, round(coalesce(sum(value) FILTER (WHERE y = 1), 0) / n1, 6) AS mean_case, round(coalesce(sum(value) FILTER (WHERE y = 0), 0) / n0, 6) AS mean_control,
    round(coalesce(sum(value) FILTER (WHERE y = 1), 0) / n1 - coalesce(sum(value) FILTER (WHERE y = 0), 0) / n0, 6) AS diff
  FROM normal JOIN lab USING (cell_id), sizes GROUP BY gene_id, n1, n0 ORDER BY abs(coalesce(sum(value) FILTER (WHERE y = 1), 0) / n1 - coalesce(sum(value) FILTER (WHERE y = 0), 0) / n0) DESC, gene_id LIMIT 10""", "counts", "obs"))  # fmt: skip
def qc_filter_normalize(spark, sf):
    """The flagship: QC, filter, normalise, case/control means, top ten genes."""
    kept = filtered(spark, sf)
    labels = A.obs(spark, sf).join(kept.select("cell_id").distinct(), "cell_id").select("cell_id", "y")
    diff = M.case_control(M.normalise(kept), labels, "cell_id")
    return diff.orderBy(F.abs("diff").desc(), "gene_id").limit(10).select("gene_id", *[R(c).alias(c) for c in ("mean_case", "mean_control", "diff")])


@query("transpose_pivot", A.sql("SELECT gene_id % 10 AS gene_group, " + ", ".join(f"coalesce(sum(value) FILTER (WHERE l_returnflag = '{k}'), 0) AS {k}" for k in "ANR")
  + f" FROM (SELECT l_partkey % {A.GENES} AS gene_id, l_quantity AS value, l_returnflag FROM lineitem) GROUP BY 1"))
def transpose_pivot(spark, sf):
    """Rows become columns and back: groups of genes by flags."""
    lines = table(spark, sf, "lineitem").select((F.col("l_partkey") % A.GENES % 10).alias("gene_group"), "l_returnflag", "l_quantity")
    return lines.groupBy("gene_group").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).na.fill(0.0)


@query("unpivot_back", """SELECT l_shipmonth, flag, qty FROM (SELECT l_shipmonth, unnest([{'flag': 'A', 'qty': a}, {'flag': 'N', 'qty': n}, {'flag': 'R', 'qty': r}], recursive := true) FROM (
  SELECT month(l_shipdate)::INT AS l_shipmonth, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS n, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r
  FROM lineitem GROUP BY 1)) WHERE qty IS NOT NULL""")  # fmt: skip
def unpivot_back(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy(F.month("l_shipdate").alias("l_shipmonth")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return wide.unpivot("l_shipmonth", ["A", "N", "R"], "flag", "qty").where("qty IS NOT NULL")


@query("attach_metadata", """SELECT o_orderkey AS cell_id, s.stage, s.experiment, s.days, 'fibroblast' AS cell_type, 'line-' || lower(s.experiment) AS cell_line, 0 AS y
  FROM orders JOIN (VALUES ('1-URGENT', 'S1', 'E1', 0), ('2-HIGH', 'S1', 'E2', 4), ('3-MEDIUM', 'S2', 'E1', 8), ('4-NOT SPECIFIED', 'S2', 'E2', 12), ('5-LOW', 'S3', 'E1', 16)) s(p, stage, experiment, days) ON o_orderpriority = s.p""")  # fmt: skip
def attach_metadata(spark, sf):
    """Constant columns from a sample sheet, and a constant label."""
    sheet = spark.createDataFrame(
        [("1-URGENT", "S1", "E1", 0), ("2-HIGH", "S1", "E2", 4), ("3-MEDIUM", "S2", "E1", 8), ("4-NOT SPECIFIED", "S2", "E2", 12), ("5-LOW", "S3", "E1", 16)],
        "p string, stage string, experiment string, days int",
    )
    rows = table(spark, sf, "orders").join(F.broadcast(sheet), F.col("o_orderpriority") == F.col("p"))
    made = {"cell_type": F.lit("fibroblast"), "cell_line": F.concat(F.lit("line-"), F.lower("experiment")), "y": F.lit(0)}
    return rows.withColumns(made).select(F.col("o_orderkey").alias("cell_id"), "stage", "experiment", "days", "cell_type", "cell_line", "y")


@query("label_by_substring", """SELECT o_orderkey AS cell_id, label FROM (SELECT o_orderkey, '0' AS label FROM orders WHERE o_orderpriority LIKE '%1-%' OR o_orderpriority LIKE '%2-%'
  UNION ALL SELECT o_orderkey, '1' FROM orders WHERE o_orderpriority LIKE '%3-%' OR o_orderpriority LIKE '%4-%' OR o_orderpriority LIKE '%5-%')""")  # fmt: skip
def label_by_substring(spark, sf):
    """Independent tests: each pattern met gives a label, none gives none."""
    p = F.col("o_orderpriority")
    has = lambda *xs: F.greatest(*[p.contains(x) for x in xs])
    labels = F.array_compact(F.array(F.when(has("1-", "2-"), "0"), F.when(has("3-", "4-", "5-"), "1")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), F.explode(labels).alias("label"))


@query("binary_label", A.sql("SELECT cell_id, y FROM obs", "obs"))
def binary_label(spark, sf):
    return A.obs(spark, sf).select("cell_id", "y")


@query("shape_columns", "SELECT 'c' || c_custkey AS barcode, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS c_nationkey FROM customer")
def shape_columns(spark, sf):
    """Insert, rename, reorder, drop."""
    c = table(spark, sf, "customer").withColumnsRenamed({"c_mktsegment": "segment", "c_acctbal": "balance"})
    return c.withColumn("barcode", F.concat(F.lit("c"), "c_custkey")).drop("c_custkey", "c_name").select("barcode", "segment", "balance", "c_nationkey")


@query("explode_vector", "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS embedding_feature_{i}" for i in range(64)) + " FROM embeddings")
def explode_vector(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"embedding_feature_{i}") for i in range(64)])


@query("gene_flags", "SELECT p_partkey, upper(p_name) LIKE 'RED%' AS mt, upper(p_name) LIKE 'OLD%' OR upper(p_name) LIKE 'HOT%' AS ribo, regexp_matches(upper(p_name), '^SM[^(P)]') AS hb FROM part")
def gene_flags(spark, sf):
    """Prefix flags of gene names; the last is a character class, not a group."""
    n = F.upper("p_name")
    return table(spark, sf, "part").select("p_partkey", n.startswith("RED").alias("mt"), (n.startswith("OLD") | n.startswith("HOT")).alias("ribo"), n.rlike(r"^SM[^(P)]").alias("hb"))


@query("subset_by_category", A.sql("SELECT cell_id, gene_id, value FROM counts SEMI JOIN (SELECT cell_id FROM obs WHERE batch = '1-URGENT') USING (cell_id)", "counts", "obs"))
def subset_by_category(spark, sf):
    return A.counts(spark, sf).join(A.obs(spark, sf).where("batch = '1-URGENT'").select("cell_id"), "cell_id", "left_semi")


@query("near_constant_genes", A.sql("""WITH n AS (SELECT count(DISTINCT cell_id) AS rows FROM counts),
  freq AS (SELECT gene_id, value, count(*) AS k FROM counts GROUP BY 1, 2), top AS (SELECT gene_id, max(k) AS k, sum(k) AS nz FROM freq GROUP BY 1)
  SELECT gene_id, round(greatest(k, rows - nz) / rows::DOUBLE, 6) AS modal_share, greatest(k, rows - nz) / rows::DOUBLE < 0.95 AS kept FROM top, n""", "counts"))  # fmt: skip
def near_constant_genes(spark, sf):
    """Share of the modal value, zeros included; genes at 0.95 or more go."""
    freq = A.counts(spark, sf).groupBy("gene_id", "value").agg(F.count("*").alias("k"))
    top = M.one_row(freq.groupBy("gene_id").agg(F.max("k").alias("k"), F.sum("k").alias("nz")), n_cells(spark, sf))
    share = F.greatest("k", F.col("rows") - F.col("nz")) / F.col("rows")
    return top.select("gene_id", R(share).alias("modal_share"), (share < 0.95).alias("kept"))


STATS = """nr AS (SELECT count(DISTINCT sample_id) AS rows FROM expr),
  st AS (SELECT gene_id, count(*) FILTER (WHERE value > 0) AS n, sum(value) AS total, sum(value) / any_value(rows) AS mean,
    greatest(0, sum(value * value) / any_value(rows) - (sum(value) / any_value(rows)) * (sum(value) / any_value(rows))) AS var_pop, any_value(rows) AS rows FROM expr, nr GROUP BY gene_id),
  stats AS (SELECT *, coalesce(var_pop * rows / nullif(rows - 1, 0), 0) AS var_samp FROM st)"""


@query("zero_variance_filter", A.sql(f"WITH {STATS} SELECT gene_id, round(var_pop, 6) AS var_pop FROM stats WHERE var_pop <> 0", "expr"))
def zero_variance_filter(spark, sf):
    return M.gene_stats(A.expr(spark, sf), "gene_id", n_samples(spark, sf)).where("var_pop <> 0").select("gene_id", R("var_pop").alias("var_pop"))


@query("low_expression_filter", A.sql(f"WITH {STATS} SELECT gene_id, total FROM stats WHERE total > (SELECT quantile_cont(total, 0.1) FROM stats)", "expr"))
def low_expression_filter(spark, sf):
    s = A.expr(spark, sf).groupBy("gene_id").agg(F.sum("value").alias("total"))
    return M.one_row(s, s.agg(F.percentile("total", 0.1).alias("p10"))).where("total > p10").select("gene_id", "total")


@query("variance_prevalence_filter", A.sql(f"WITH {STATS} SELECT gene_id, n, round(var_pop, 6) AS var_pop FROM stats WHERE var_pop > (SELECT quantile_cont(var_pop, 0.2) FROM stats) AND n > 0.1 * rows", "expr"))
def variance_prevalence_filter(spark, sf):
    s = M.gene_stats(A.expr(spark, sf), "gene_id", n_samples(spark, sf))
    return M.one_row(s, s.agg(F.percentile("var_pop", 0.2).alias("p20"))).where("var_pop > p20 AND n > 0.1 * rows").select("gene_id", "n", R("var_pop").alias("var_pop"))


@query("correlation_matrix", A.sql("""WITH n AS (SELECT count(DISTINCT sample_id) AS rows FROM expr), s AS (SELECT gene_id, sum(value) AS s, sum(value * value) AS q FROM expr GROUP BY 1),
  p AS (SELECT a.gene_id AS g1, b.gene_id AS g2, sum(a.value * b.value) AS p FROM expr a JOIN expr b ON a.sample_id = b.sample_id AND a.gene_id < b.gene_id GROUP BY 1, 2)
  SELECT a.gene_id AS g1, b.gene_id AS g2, round(CASE WHEN (rows * a.q - a.s * a.s) * (rows * b.q - b.s * b.s) > 0
    THEN (rows * coalesce(p, 0) - a.s * b.s) / sqrt((rows * a.q - a.s * a.s) * (rows * b.q - b.s * b.s)) ELSE 0 END, 6) AS corr
  FROM s a JOIN s b ON a.gene_id < b.gene_id LEFT JOIN p ON p.g1 = a.gene_id AND p.g2 = b.gene_id, n""", "expr"))  # fmt: skip
def correlation_matrix(spark, sf):
    return M.pair_correlations(A.expr(spark, sf), "sample_id", n_samples(spark, sf)).withColumn("corr", R("corr"))


CORR = """n AS (SELECT count(DISTINCT sample_id) AS rows FROM expr), s AS (SELECT gene_id, sum(value) AS s, sum(value * value) AS q FROM expr GROUP BY 1),
  p AS (SELECT a.gene_id AS g1, b.gene_id AS g2, sum(a.value * b.value) AS p FROM expr a JOIN expr b ON a.sample_id = b.sample_id AND a.gene_id < b.gene_id GROUP BY 1, 2),
  corr AS (SELECT a.gene_id AS g1, b.gene_id AS g2, CASE WHEN (rows * a.q - a.s * a.s) * (rows * b.q - b.s * b.s) > 0
    THEN (rows * coalesce(p, 0) - a.s * b.s) / sqrt((rows * a.q - a.s * a.s) * (rows * b.q - b.s * b.s)) ELSE 0 END AS corr
  FROM s a JOIN s b ON a.gene_id < b.gene_id LEFT JOIN p ON p.g1 = a.gene_id AND p.g2 = b.gene_id, n)"""


@query("correlation_band", A.sql(f"WITH {CORR} SELECT g1, g2, round(corr, 6) AS corr FROM corr WHERE corr > 0.1 AND corr < 0.2", "expr"))
def correlation_band(spark, sf):
    c = M.pair_correlations(A.expr(spark, sf), "sample_id", n_samples(spark, sf))
    return c.where("corr > 0.1 AND corr < 0.2").withColumn("corr", R("corr"))


@query("highly_variable_genes", A.sql("""WITH norm AS (SELECT sample_id, gene_id, ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY sample_id)) AS value FROM expr),
  raw AS (SELECT sample_id, gene_id, exp(value) - 1 AS value FROM norm), nr AS (SELECT count(DISTINCT sample_id) AS rows FROM expr),
  st AS (SELECT gene_id, sum(value) / any_value(rows) AS m, greatest(0, sum(value * value) / any_value(rows) - (sum(value) / any_value(rows)) ** 2) * any_value(rows) / (any_value(rows) - 1) AS v FROM raw, nr GROUP BY 1),
  lg AS (SELECT gene_id, ln(1 + CASE WHEN m = 0 THEN 1e-12 ELSE m END) AS mean, CASE WHEN v > 0 THEN ln(v / m) END AS disp FROM st),
  b AS (SELECT lg.*, least(19, floor(coalesce((mean - lo) / nullif((hi - lo) / 20, 0), 0)))::INT AS bin FROM lg, (SELECT min(mean) AS lo, max(mean) AS hi FROM lg)),
  z AS (SELECT *, avg(disp) OVER w AS bm, stddev_samp(disp) OVER w AS bs, count(disp) OVER w AS k FROM b WINDOW w AS (PARTITION BY bin))
  SELECT gene_id, round(mean, 5) AS mean, round(disp, 5) AS disp, bin, round(CASE WHEN k > 1 THEN (disp - bm) / nullif(bs, 0) ELSE disp / nullif(bm, 0) END, 4) AS disp_norm FROM z""", "expr"))  # fmt: skip
def highly_variable_genes(spark, sf):
    norm = M.normalise(A.expr(spark, sf).withColumnRenamed("sample_id", "cell_id"))
    h = M.variable_genes(norm, n_samples(spark, sf))
    return h.select("gene_id", F.round("mean", 5).alias("mean"), F.round("disp", 5).alias("disp"), "bin", F.round("disp_norm", 4).alias("disp_norm"))


def _z(name, ddof, limit):
    var = "var_samp" if ddof else "var_pop"
    inner = f"(value - mean) / CASE WHEN {var} > 0 THEN sqrt({var}) ELSE 1 END"
    if limit:
        inner = f"least({limit}, greatest(-{limit}, {inner}))"

    @query(name, A.sql(f"WITH {STATS} SELECT sample_id, gene_id, value, round({inner}, 6) AS z FROM expr JOIN stats USING (gene_id)", "expr"))
    def scaled(spark, sf):
        z = M.standardise(A.expr(spark, sf), n_samples(spark, sf), ddof=ddof, limit=limit)
        return z.select("sample_id", "gene_id", "value", R("z").alias("z"))


_z("zscore_clipped", 1, 10.0)
_z("standard_scaler", 0, None)


@query("gene_group_difference", A.sql("""WITH sz AS (SELECT sum(y) AS n1, sum(1 - y) AS n0 FROM samples),
  m AS (SELECT gene_id, coalesce(sum(ln(1 + value)) FILTER (WHERE y = 1), 0) / n1 AS a, coalesce(sum(ln(1 + value)) FILTER (WHERE y = 0), 0) / n0 AS b FROM expr JOIN samples USING (sample_id), sz GROUP BY gene_id, n1, n0)
  SELECT gene_id, round(a - b, 6) AS fold_change, abs(a - b) > (SELECT quantile_cont(abs(a - b), 0.75) FROM m) AS differential FROM m""", "expr", "samples"))  # fmt: skip
def gene_group_difference(spark, sf):
    """Difference of group means of log1p, and whether it is in the top quarter."""
    logged = A.expr(spark, sf).withColumn("value", F.log1p("value"))
    d = M.case_control(logged, A.samples(spark, sf), "sample_id")
    p = d.agg(F.percentile(F.abs("diff"), 0.75).alias("p75"))
    return M.one_row(d, p).select("gene_id", R("diff").alias("fold_change"), (F.abs("diff") > F.col("p75")).alias("differential"))


@query("highest_expressed_genes", A.sql("""WITH t AS (SELECT *, 100.0 * value / sum(value) OVER (PARTITION BY cell_id) AS pct FROM counts), n AS (SELECT count(DISTINCT cell_id) AS rows FROM counts)
  SELECT gene_id, round(sum(pct) / any_value(rows), 6) AS mean_pct FROM t, n GROUP BY gene_id ORDER BY round(sum(pct) / any_value(rows), 9) DESC, gene_id LIMIT 20""", "counts"))  # fmt: skip
def highest_expressed_genes(spark, sf):
    pct = A.counts(spark, sf).withColumn("pct", 100.0 * F.col("value") / F.sum("value").over(Window.partitionBy("cell_id")))
    means = M.one_row(pct.groupBy("gene_id").agg(F.sum("pct").alias("s")), n_cells(spark, sf)).withColumn("m", F.col("s") / F.col("rows"))
    return means.orderBy(F.round("m", 9).desc(), "gene_id").limit(20).select("gene_id", R("m").alias("mean_pct"))


@query("variance_ranked_genes", A.sql(f"WITH {STATS} SELECT gene_id, round(var_samp, 6) AS var_samp FROM stats ORDER BY round(var_samp, 9) DESC, gene_id LIMIT 100", "expr"))
def variance_ranked_genes(spark, sf):
    s = M.gene_stats(A.expr(spark, sf), "gene_id", n_samples(spark, sf))
    return s.orderBy(F.round("var_samp", 9).desc(), "gene_id").limit(100).select("gene_id", R("var_samp").alias("var_samp"))


@query("empty_droplets", A.sql("WITH t AS (SELECT cell_id, sum(value) AS total_counts FROM counts GROUP BY 1) SELECT cell_id, total_counts, total_counts < (SELECT quantile_cont(total_counts, 0.05) FROM t) AS empty FROM t", "counts"))
def empty_droplets(spark, sf):
    t = A.counts(spark, sf).groupBy("cell_id").agg(F.sum("value").alias("total_counts"))
    return M.one_row(t, t.agg(F.percentile("total_counts", 0.05).alias("p"))).select("cell_id", "total_counts", (F.col("total_counts") < F.col("p")).alias("empty"))


_U_SQL = """sz AS (SELECT sum(y) AS n1, count(*) AS n FROM samples), nz AS (SELECT gene_id, value, y FROM expr JOIN samples USING (sample_id)),
  g AS (SELECT gene_id, count(*) AS k FROM nz GROUP BY 1),
  r AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0 AS rk FROM nz),
  u AS (SELECT r.gene_id, coalesce(sum(rk + n - k) FILTER (WHERE y = 1), 0) + (n1 - count(*) FILTER (WHERE y = 1)) * (n - k + 1) / 2.0 - n1 * (n1 + 1) / 2.0 AS u, n1, n - n1 AS n0, n FROM r JOIN g USING (gene_id), sz GROUP BY r.gene_id, n1, n, k)"""


@query("wilcoxon_markers", A.sql(f"""WITH {_U_SQL}
  SELECT gene_id, round(u, 6) AS u, round((u - n1 * n0 / 2.0) / sqrt(n1 * n0 * (n + 1) / 12.0), 6) AS z FROM u""", "expr", "samples"))  # fmt: skip
def wilcoxon_markers(spark, sf):
    """Rank-sum U of cases, and z by the normal approximation. Zeros are below all entries and tie;
    they enter by number alone."""
    return _wilcoxon(spark, sf).select("gene_id", R("u").alias("u"), R("z").alias("z"))


def _wilcoxon(spark, sf):
    sizes = A.samples(spark, sf).agg(F.sum("y").alias("n1"), F.count("*").alias("n_all"))
    rows = A.expr(spark, sf).join(A.samples(spark, sf), "sample_id")
    ranked = M.average_ranks(rows, ["gene_id"], "value")
    per = ranked.groupBy("gene_id").agg(F.count("*").alias("k"), F.sum("y").alias("k1"), F.sum(F.when(F.col("y") == 1, F.col("rank")).otherwise(0.0)).alias("r1"))
    zeros = F.col("n_all") - F.col("k")
    n1, n0 = F.col("n1"), F.col("n_all") - F.col("n1")
    u = F.col("r1") + F.col("k1") * zeros + (n1 - F.col("k1")) * (zeros + 1) / 2.0 - n1 * (n1 + 1) / 2.0
    z = (u - n1 * n0 / 2.0) / F.sqrt(n1 * n0 * (F.col("n_all") + 1) / 12.0)
    return M.one_row(per, sizes).select("gene_id", u.alias("u"), z.alias("z"))


_T_SQL = """sz AS (SELECT sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM samples),
  s AS (SELECT gene_id, coalesce(sum(value) FILTER (WHERE y = 1), 0) / n1 AS m1, coalesce(sum(value) FILTER (WHERE y = 0), 0) / n0 AS m0,
    coalesce(sum(value * value) FILTER (WHERE y = 1), 0) / n1 AS q1, coalesce(sum(value * value) FILTER (WHERE y = 0), 0) / n0 AS q0, n1, n0 FROM expr JOIN samples USING (sample_id), sz GROUP BY gene_id, n1, n0),
  v AS (SELECT *, greatest(0, q1 - m1 * m1) AS v1, greatest(0, q0 - m0 * m0) AS v0 FROM s),
  e AS (SELECT *, greatest(v1, v0) < 2 * least(v1, v0) AS equal_var, v1 * n1 / (n1 - 1) AS s1, v0 * n0 / (n0 - 1) AS s0 FROM v),
  t AS (SELECT *, CASE WHEN equal_var THEN ((n1 - 1) * s1 + (n0 - 1) * s0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0) ELSE s1 / n1 + s0 / n0 END AS se2,
    CASE WHEN equal_var THEN n1 + n0 - 2 ELSE (s1 / n1 + s0 / n0) ** 2 / nullif((s1 / n1) ** 2 / (n1 - 1) + (s0 / n0) ** 2 / (n0 - 1), 0) END AS df FROM e)"""


@query("t_statistics", A.sql(f"""WITH {_T_SQL}
  SELECT gene_id, equal_var, round(coalesce((m1 - m0) / nullif(sqrt(se2), 0), 0), 6) AS t, round(df, 5) AS df FROM t""", "expr", "samples"))  # fmt: skip
def t_statistics(spark, sf):
    """Student's t if the larger variance is below twice the smaller, else Welch's; with df."""
    return _t_statistics(spark, sf).select("gene_id", "equal_var", R("t").alias("t"), F.round("df", 5).alias("df"))


def _t_statistics(spark, sf):
    sizes = A.samples(spark, sf).agg(F.sum("y").cast("double").alias("n1"), F.sum(1 - F.col("y")).cast("double").alias("n0"))
    rows = A.expr(spark, sf).join(A.samples(spark, sf), "sample_id")
    of = lambda k, p: F.sum(F.when(F.col("y") == k, F.pow("value", F.lit(p))).otherwise(0.0))
    s = M.one_row(rows.groupBy("gene_id").agg(of(1, 1).alias("a1"), of(0, 1).alias("a0"), of(1, 2).alias("b1"), of(0, 2).alias("b0")), sizes)
    m1, m0, n1, n0 = F.col("a1") / F.col("n1"), F.col("a0") / F.col("n0"), F.col("n1"), F.col("n0")
    v1, v0 = F.greatest(F.lit(0.0), F.col("b1") / n1 - m1 * m1), F.greatest(F.lit(0.0), F.col("b0") / n0 - m0 * m0)
    s = s.select("gene_id", n1, n0, m1.alias("m1"), m0.alias("m0"), v1.alias("v1"), v0.alias("v0"))
    s1, s0 = F.col("v1") * n1 / (n1 - 1), F.col("v0") * n0 / (n0 - 1)
    s = s.withColumn("equal_var", F.greatest("v1", "v0") < 2 * F.least("v1", "v0"))
    welch = s1 / n1 + s0 / n0
    se2 = F.when(F.col("equal_var"), ((n1 - 1) * s1 + (n0 - 1) * s0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)).otherwise(welch)
    wdf = F.try_divide(welch * welch, F.pow(s1 / n1, F.lit(2)) / (n1 - 1) + F.pow(s0 / n0, F.lit(2)) / (n0 - 1))
    df = F.when(F.col("equal_var"), n1 + n0 - 2).otherwise(wdf)
    return s.select("gene_id", "equal_var", M.ratio(F.col("m1") - F.col("m0"), F.sqrt(se2)).alias("t"), df.alias("df"))


#: Points of Simpson's rule in the SQL of tails.
POINTS = 20_000
_SIMPSON = f"CASE WHEN i = 0 OR i = {POINTS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


@query("t_test_p_values", A.sql(f"""WITH {_T_SQL}, t2 AS (SELECT gene_id, coalesce((m1 - m0) / nullif(sqrt(se2), 0), 0) AS t, df FROM t),
  ends AS (SELECT *, atan(abs(t) / sqrt(df)) AS low, pi() / 2 AS high FROM t2), points AS (SELECT unnest(range(0, {POINTS} + 1)) AS i)
  SELECT gene_id, round(sum({_SIMPSON} * cos(low + (high - low) * i / {POINTS}) ** (df - 1)) * (high - low) / (sum({_SIMPSON} * cos(high * i / {POINTS}) ** (df - 1)) * high), 7) AS p FROM ends, points WHERE df IS NOT NULL GROUP BY gene_id, low, high
  UNION ALL SELECT gene_id, NULL FROM t2 WHERE df IS NULL""", "expr", "samples"))  # fmt: skip
def t_test_p_values(spark, sf):
    """Two-sided p of the t statistics, by the incomplete beta function."""
    return _t_statistics(spark, sf).select("gene_id", F.round(t_two_sided(F.col("t"), F.col("df")), 7).alias("p"))


@query("wilcoxon_p_values", A.sql(f"""WITH {_U_SQL}, z AS (SELECT gene_id, abs((u - n1 * n0 / 2.0) / sqrt(n1 * n0 * (n + 1) / 12.0)) AS z FROM u), points AS (SELECT unnest(range(0, {POINTS} + 1)) AS i)
  SELECT gene_id, round(1 - 2 / sqrt(2 * pi()) * z / {POINTS} / 3 * sum({_SIMPSON} * exp(-((z * i / {POINTS}) ** 2) / 2)), 7) AS p FROM z, points GROUP BY gene_id, z""", "expr", "samples"))  # fmt: skip
def wilcoxon_p_values(spark, sf):
    """Two-sided p of the rank sums, by the normal tail."""
    return _wilcoxon(spark, sf).select("gene_id", F.round(normal_two_sided(F.col("z")), 7).alias("p"))


@query("anova_select", A.sql("""WITH lab AS (SELECT c_custkey AS sample_id, c_mktsegment AS g FROM customer), n AS (SELECT g, count(*)::DOUBLE AS n FROM lab GROUP BY g), tot AS (SELECT sum(n) AS n, count(*) AS k FROM n),
  c AS (SELECT gene_id, g, sum(value) AS s, sum(value * value) AS q FROM expr JOIN lab USING (sample_id) GROUP BY 1, 2),
  a AS (SELECT gene_id, sum(q) AS q, sum(s) AS s, sum(s * s / n.n) AS between_raw FROM c JOIN n USING (g) GROUP BY gene_id),
  f AS (SELECT gene_id, coalesce(((between_raw - s * s / tot.n) / (k - 1)) / nullif((q - between_raw) / (tot.n - k), 0), 0) AS f FROM a, tot)
  SELECT gene_id, round(f, 5) AS f, rank <= round(0.2 * p) AS selected FROM (SELECT *, row_number() OVER (ORDER BY round(f, 8) DESC, gene_id) AS rank, count(*) OVER () AS p FROM f)""", "expr"))  # fmt: skip
def anova_select(spark, sf):
    """F statistic per feature over the five segments; the best fifth is selected."""
    lab = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("g"))
    n = lab.groupBy("g").agg(F.count("*").cast("double").alias("n"))
    cells = A.expr(spark, sf).join(lab, "sample_id").groupBy("gene_id", "g").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    per = cells.join(n, "g").groupBy("gene_id").agg(F.sum("q").alias("q"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    per = M.one_row(per, n.agg(F.sum("n").alias("n"), F.count("*").alias("k")))
    f = M.ratio((F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1), (F.col("q") - F.col("b")) / (F.col("n") - F.col("k")))
    # One row per feature.
    ranked = per.select("gene_id", f.alias("f")).withColumn("_r", F.row_number().over(Window.orderBy(F.round("f", 8).desc(), "gene_id"))).withColumn("_p", F.count("*").over(Window.partitionBy()))
    return ranked.select("gene_id", F.round("f", 5).alias("f"), (F.col("_r") <= F.round(0.2 * F.col("_p"))).alias("selected"))


@query("binned_mutual_information", A.sql("""WITH lab AS (SELECT c_custkey AS sample_id, c_mktsegment AS g FROM customer), n AS (SELECT g, count(*) AS n FROM lab GROUP BY g), tot AS (SELECT count(*)::DOUBLE AS n FROM lab),
  nz AS (SELECT gene_id, g, least(9, 1 + floor(value / 25))::INT AS b, count(*) AS k FROM expr JOIN lab USING (sample_id) GROUP BY 1, 2, 3),
  genes AS (SELECT DISTINCT gene_id FROM expr), z AS (SELECT genes.gene_id, n.g, 0 AS b, n.n - coalesce(sum(nz.k), 0) AS k FROM genes CROSS JOIN n LEFT JOIN nz ON nz.gene_id = genes.gene_id AND nz.g = n.g GROUP BY 1, 2, n.n),
  j AS (SELECT * FROM nz UNION ALL SELECT * FROM z WHERE k > 0), pb AS (SELECT gene_id, b, sum(k) AS kb FROM j GROUP BY 1, 2)
  SELECT gene_id, round(sum(k / tot.n * ln(k * tot.n / (kb * n.n))), 6) AS mi FROM j JOIN pb USING (gene_id, b) JOIN n USING (g), tot GROUP BY gene_id""", "expr"))  # fmt: skip
def binned_mutual_information(spark, sf):
    """Mutual information of binned values and classes; bin 0 holds the zeros."""
    lab = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("g"))
    n = lab.groupBy("g").agg(F.count("*").alias("n"))
    expr = A.expr(spark, sf)
    b = F.least(F.lit(9), 1 + F.floor(F.col("value") / 25)).cast("int").alias("b")
    nz = expr.join(lab, "sample_id").groupBy("gene_id", "g", b).agg(F.count("*").alias("k"))
    grid = expr.select("gene_id").distinct().join(n, how="cross")
    got = nz.groupBy("gene_id", "g").agg(F.sum("k").alias("nz"))
    zeros = grid.join(got, ["gene_id", "g"], "left").select("gene_id", "g", F.lit(0).alias("b"), (F.col("n") - F.coalesce("nz", F.lit(0))).alias("k")).where("k > 0")
    joint = nz.unionByName(zeros)
    joint = joint.withColumn("kb", F.sum("k").over(Window.partitionBy("gene_id", "b"))).join(n, "g")
    joint = M.one_row(joint, lab.agg(F.count("*").cast("double").alias("t")))
    return joint.groupBy("gene_id").agg(R(F.sum(F.col("k") / F.col("t") * F.log(F.col("k") * F.col("t") / (F.col("kb") * F.col("n"))))).alias("mi"))


@query("neighbour_mutual_information", """WITH v AS (SELECT vec_id AS id, i - 1 AS feature, label, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
  s AS (SELECT *, count(*) OVER (PARTITION BY feature, label) AS size FROM v), w AS (SELECT * FROM s WHERE size > 1),
  f AS (SELECT *, list_sort(list_filter([abs(x - lag(x, 1) OVER o), abs(x - lag(x, 2) OVER o), abs(x - lag(x, 3) OVER o), abs(x - lead(x, 1) OVER o), abs(x - lead(x, 2) OVER o), abs(x - lead(x, 3) OVER o)], lambda z: z IS NOT NULL)) AS far
    FROM w WINDOW o AS (PARTITION BY feature, label ORDER BY x, id)),
  r AS (SELECT id, feature, x, size, least(3, size - 1) AS k, far[least(3, size - 1)] AS d FROM f),
  m AS (SELECT a.id, a.feature, a.size, a.k, count(*) AS m FROM r a JOIN r b ON b.feature = a.feature AND (abs(b.x - a.x) < a.d OR b.x = a.x) GROUP BY ALL),
  h AS (SELECT feature, n, k, size, m, count(*) OVER (PARTITION BY feature) AS total FROM (SELECT *, 1 AS n FROM m)),
  p AS (SELECT n, -0.5772156649015329 + coalesce(sum(1.0 / j) FILTER (WHERE j < n), 0)::DOUBLE AS psi FROM (SELECT unnest(range(1, (SELECT max(total) FROM h) + 1)) AS n), (SELECT unnest(range(1, (SELECT max(total) FROM h) + 1)) AS j) GROUP BY n)
  SELECT feature::INT AS feature, round(greatest(0, any_value(t.psi) + avg(k.psi) - avg(c.psi) - avg(m.psi)), 6) AS mi FROM h JOIN p t ON t.n = h.total JOIN p k ON k.n = h.k JOIN p c ON c.n = h.size JOIN p m ON m.n = h.m GROUP BY 1""")  # fmt: skip
def neighbour_mutual_information(spark, sf):
    """Mutual information of each component and the labels, by the third nearest neighbour."""
    from heddle.operators.information import neighbour_information

    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"), F.posexplode("embedding").alias("feature", "value"))
    return neighbour_information(rows).select("feature", R("mi").alias("mi"))


@query("nb_moments", A.sql(f"WITH {STATS} SELECT gene_id, round(mean / nullif(var_samp, 0), 6) AS p, CASE WHEN var_samp > mean THEN round(mean * mean / (var_samp - mean), 5) END AS r FROM stats", "expr"))
def nb_moments(spark, sf):
    """Negative binomial parameters by moments; no r without overdispersion."""
    s = M.gene_stats(A.expr(spark, sf), "gene_id", n_samples(spark, sf))
    m, v = F.col("mean"), F.col("var_samp")
    return s.select("gene_id", R(F.try_divide(m, v)).alias("p"), F.when(v > m, F.round(m * m / (v - m), 5)).alias("r"))


@query("nb_likelihood", A.sql(f"""WITH {STATS}, sz AS (SELECT count(DISTINCT sample_id)::DOUBLE AS n FROM expr), top AS (SELECT gene_id, max(value)::INT AS top FROM expr GROUP BY 1),
  tail AS (SELECT t.gene_id, j, count(*) AS m FROM (SELECT gene_id, unnest(range(0, top)) AS j FROM top) t JOIN expr e ON e.gene_id = t.gene_id AND e.value > j GROUP BY 1, 2),
  b(gene_id, step, low, high) AS (SELECT gene_id, 0, -15.0::DOUBLE, 15.0::DOUBLE FROM stats WHERE var_pop > mean UNION ALL
    SELECT gene_id, step + 1, CASE WHEN rises THEN x ELSE low END, CASE WHEN rises THEN high ELSE x END FROM (
      SELECT b.gene_id, step, low, high, (low + high) / 2 AS x, sum(m / (exp((low + high) / 2) + j)) + any_value(sz.n) * ln(exp((low + high) / 2) / (exp((low + high) / 2) + any_value(mean))) > 0 AS rises
      FROM b JOIN tail USING (gene_id) JOIN stats USING (gene_id), sz WHERE step < 50 GROUP BY b.gene_id, step, low, high)),
  r AS (SELECT gene_id, (low + high) / 2 AS x FROM b WHERE step = 50)
  SELECT gene_id, round(x, 6) AS log_r, round(exp(x) / (exp(x) + mean), 6) AS p FROM stats LEFT JOIN r USING (gene_id)""", "expr").replace("WITH ", "WITH RECURSIVE ", 1))  # fmt: skip
def nb_likelihood(spark, sf):
    """The likeliest negative binomial of each gene; the SQL bisects what Newton steps solve."""
    from heddle.operators.dispersion import likeliest_dispersion

    e = A.expr(spark, sf)
    stats = M.one_row(M.gene_stats(e, "gene_id", n_samples(spark, sf)), n_samples(spark, sf).withColumnRenamed("rows", "samples"))
    got = likeliest_dispersion(e, stats.select("gene_id", F.col("samples").cast("double").alias("n"), "mean", "var_pop"))
    return got.select("gene_id", R(F.log("r")).alias("log_r"), R("p").alias("p"))


@query("scale_not_center", A.sql("""WITH n AS (SELECT count(DISTINCT sample_id) AS rows FROM expr), s AS (SELECT gene_id, sqrt(sum(value * value) / (any_value(rows) - 1)) AS rms FROM expr, n GROUP BY 1)
  SELECT sample_id, gene_id, round(value / rms, 6) AS value FROM expr JOIN s USING (gene_id)""", "expr"))  # fmt: skip
def scale_not_center(spark, sf):
    e = A.expr(spark, sf)
    s = M.one_row(e.groupBy("gene_id").agg(F.sum(F.col("value") * F.col("value")).alias("q")), n_samples(spark, sf))
    return e.join(s, "gene_id").select("sample_id", "gene_id", R(F.col("value") / F.sqrt(F.col("q") / (F.col("rows") - 1))).alias("value"))


@query("centroid_inverse", A.sql(f"""WITH {STATS}, z AS (SELECT sample_id % 5 AS cluster, gene_id, (value - mean) / sqrt(var_pop) AS z FROM expr JOIN stats USING (gene_id) WHERE var_pop > 0),
  c AS (SELECT cluster, gene_id, avg(z) AS z FROM z GROUP BY 1, 2) SELECT cluster, gene_id, round(c.z * sqrt(var_pop) + mean, 8) AS value FROM c JOIN stats USING (gene_id)""", "expr"))  # fmt: skip
def centroid_inverse(spark, sf):
    """Centroids of standardised values, back in original units."""
    e = A.expr(spark, sf)
    stats = M.gene_stats(e, "gene_id", n_samples(spark, sf)).where("var_pop > 0").select("gene_id", "mean", F.sqrt("var_pop").alias("sd"))
    z = e.join(stats, "gene_id").groupBy((F.col("sample_id") % 5).alias("cluster"), "gene_id").agg(F.avg((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))
    return z.join(stats, "gene_id").select("cluster", "gene_id", F.round(F.col("z") * F.col("sd") + F.col("mean"), 8).alias("value"))


@query("quantile_normalise", A.sql("""SELECT sample_id, gene_id, value, round(percent_rank() OVER (PARTITION BY gene_id ORDER BY value), 6) AS rank,
  round(quantile_cont(value, 0.5) OVER (PARTITION BY gene_id), 6) AS reference FROM expr""", "expr"))  # fmt: skip
def quantile_normalise(spark, sf):
    """Ranks within a factor and the reference quantile they align to."""
    w = Window.partitionBy("gene_id")
    return A.expr(spark, sf).select("sample_id", "gene_id", "value", R(F.percent_rank().over(w.orderBy("value"))).alias("rank"), R(F.percentile("value", 0.5).over(w)).alias("reference"))
