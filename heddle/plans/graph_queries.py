"""Queries on graphs, neighbours and mechanisms."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.operators import communities as C
from heddle.operators import graph as G
from heddle.operators import matrix as M
from heddle.operators.neighbours import nearest_by_index
from heddle.plans import adapters as A
from heddle.plans.matrix_queries import CORR, STATS, n_samples
from heddle.plans.registry import query
from heddle.workspace import table

R = lambda c: F.round(c, 6)

_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
COS = f"""nv AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
  cos AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label AS la, b.label AS lb, {_DOT} / (a.n * b.n) AS score FROM nv a JOIN nv b ON a.vec_id <> b.vec_id),
  knn AS (SELECT * FROM cos QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) <= 5)"""
DIST = """d AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label AS la, b.label AS lb, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def knn(spark, sf, k=5, metric="cosine"):
    """By the index: exact up to eight cells of 2,048 rows, of measured recall beyond."""
    return nearest_by_index(vectors(spark, sf).select("id", "vector"), k, metric)


@query("knn_cosine_topk", f"WITH {COS} SELECT src, dst, round(score, 6) AS score FROM knn")
def knn_cosine_topk(spark, sf):
    return knn(spark, sf).select("src", "dst", R("score").alias("score"))


@query("knn_index_topk", f"WITH {COS} SELECT src, dst, round(score, 6) AS score FROM knn WHERE src % 50 = 0")
def knn_index_topk(spark, sf):
    """By the index, for the rows whose id is divisible by 50. Exact up to eight cells (16,384 rows),
    as in the SQL; tests measure the recall beyond."""
    v = vectors(spark, sf).select("id", "vector")
    return nearest_by_index(v, 5, queries=v.where("id % 50 = 0")).select("src", "dst", R("score").alias("score"))


@query("knn_graph", f"WITH {COS} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(score), 6) AS score FROM knn WHERE score > 0.1 GROUP BY 1, 2")
def knn_graph(spark, sf):
    """Undirected edges from either side's neighbours above a threshold."""
    return G.undirected(knn(spark, sf).where("score > 0.1")).withColumn("score", R("score"))


@query("nearest_distance", f"WITH {DIST} SELECT src, round(min(score), 5) AS rho FROM d GROUP BY src")
def nearest_distance(spark, sf):
    return knn(spark, sf, 1, "euclidean").select("src", F.round("score", 5).alias("rho"))


@query("knn_distance_curve", f"WITH {DIST}, m AS (SELECT src, min(score) AS s FROM d GROUP BY src) SELECT row_number() OVER (ORDER BY round(s, 9), src) AS i, round(s, 5) AS distance FROM m")
def knn_distance_curve(spark, sf):
    from heddle.operators.order import with_position

    n = knn(spark, sf, 1, "euclidean").select(F.struct(F.round("score", 9).alias("s"), "src").alias("k"), "score")
    return with_position(n, "k", "i").select(F.col("i").cast("long").alias("i"), F.round("score", 5).alias("distance"))


@query("balanced_neighbours", f"WITH {DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY src, lb ORDER BY round(score, 9), dst) AS rk FROM d) SELECT src, dst, lb::VARCHAR AS batch, round(score, 5) AS score FROM r WHERE rk <= 2")
def balanced_neighbours(spark, sf):
    """The two nearest rows of each batch."""
    return G.nearest(vectors(spark, sf), 2, "euclidean", batch="label").select("src", "dst", "batch", F.round("score", 5).alias("score"))


@query("graph_components", f"""WITH RECURSIVE {COS}, e AS (SELECT src, dst FROM knn WHERE score > 0.3 UNION SELECT dst, src FROM knn WHERE score > 0.3),
  reach(node, seen) AS (SELECT src, src FROM e UNION SELECT r.node, e.dst FROM reach r JOIN e ON r.seen = e.src) SELECT node, min(seen) AS component FROM reach GROUP BY node""")  # fmt: skip
def graph_components(spark, sf):
    return G.label_components(knn(spark, sf).where("score > 0.3").select("src", "dst"))


@query("modularity_of_labels", f"""WITH {COS}, e AS (SELECT least(src, dst) AS s, greatest(src, dst) AS d, max(score) AS w FROM knn WHERE score > 0.1 GROUP BY 1, 2),
  l AS (SELECT e.*, a.label AS ca, b.label AS cb FROM e JOIN embeddings a ON a.vec_id = s JOIN embeddings b ON b.vec_id = d), m AS (SELECT sum(w) AS m FROM e),
  i AS (SELECT ca AS c, sum(w) AS w FROM l WHERE ca = cb GROUP BY 1), k AS (SELECT c, sum(w) AS k FROM (SELECT ca AS c, w FROM l UNION ALL SELECT cb, w FROM l) GROUP BY 1)
  SELECT round(sum(coalesce(i.w, 0) / m - (k / (2 * m)) ** 2), 6) AS modularity FROM k LEFT JOIN i USING (c), m""")  # fmt: skip
def modularity_of_labels(spark, sf):
    e = G.undirected(knn(spark, sf).where("score > 0.1")).withColumnRenamed("score", "weight")
    m = vectors(spark, sf).select(F.col("id").alias("node"), F.col("label").alias("community"))
    return G.modularity(e, m).select(R("modularity").alias("modularity"))


@query("same_label_pairs", "SELECT a.label, count(*) AS pairs FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1")
def same_label_pairs(spark, sf):
    """Number of ordered pairs with one label, from the counts."""
    n = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.select("label", (F.col("n") * (F.col("n") - 1)).alias("pairs")).where("pairs > 0")


@query("class_subset", "SELECT vec_id FROM embeddings WHERE label IN (1, 7)")
def class_subset(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("label").isin(1, 7)).select("vec_id")


@query("dbscan_core", f"WITH {DIST}, n AS (SELECT src, count(*) FILTER (WHERE score <= 1.25) + 1 AS within FROM d GROUP BY src) SELECT src AS vec_id, within, within >= 5 AS core FROM n")
def dbscan_core(spark, sf):
    """Points within eps, itself included, and whether they make a core point."""
    from heddle.operators.clusters import within

    return within(vectors(spark, sf), 1.25).select(F.col("id").alias("vec_id"), "within", (F.col("within") >= 5).alias("core"))


#: Pairs of radius and least number of rows: fifteen radii by twelve numbers.
DENSITIES = [(round(1.1 + k / 100, 2), least) for k in range(15) for least in range(3, 15)]
DENSITY = (1.25, 5)


def _density_sql(grid) -> str:
    values = ", ".join(f"({eps}::DOUBLE, {least})" for eps, least in grid)
    return f"""{DIST}, grid(eps, least) AS (VALUES {values}), every AS (SELECT vec_id AS id, eps, least FROM embeddings, grid),
  near AS (SELECT eps, least, src, dst FROM d JOIN grid ON score <= eps),
  n AS (SELECT e.eps, e.least, e.id, count(dst) + 1 >= e.least AS core FROM every e LEFT JOIN near ON near.eps = e.eps AND near.least = e.least AND src = id GROUP BY 1, 2, 3),
  ce AS (SELECT near.* FROM near JOIN n a ON a.eps = near.eps AND a.least = near.least AND a.id = src AND a.core JOIN n b ON b.eps = near.eps AND b.least = near.least AND b.id = dst AND b.core),
  reach(eps, least, id, seen) AS (SELECT eps, least, id, id FROM n WHERE core UNION SELECT r.eps, r.least, r.id, ce.dst FROM reach r JOIN ce ON ce.eps = r.eps AND ce.least = r.least AND ce.src = r.seen),
  roots AS (SELECT eps, least, id, min(seen) AS root FROM reach GROUP BY 1, 2, 3),
  joined AS (SELECT near.eps, near.least, src AS id, min(root) AS root FROM near JOIN roots r ON r.eps = near.eps AND r.least = near.least AND r.id = dst GROUP BY 1, 2, 3),
  dense AS (SELECT n.eps, n.least, n.id, n.core, coalesce(r.root, j.root) AS cluster FROM n LEFT JOIN roots r ON r.eps = n.eps AND r.least = n.least AND r.id = n.id LEFT JOIN joined j ON j.eps = n.eps AND j.least = n.least AND j.id = n.id)"""


@query("dbscan_clusters", f"WITH RECURSIVE {_density_sql([DENSITY])} SELECT id AS vec_id, core, cluster FROM dense")
def dbscan_clusters(spark, sf):
    from heddle.operators.clusters import dbscan

    return dbscan(vectors(spark, sf), *DENSITY).withColumnRenamed("id", "vec_id")


@query("dbscan_grid", f"WITH RECURSIVE {_density_sql(DENSITIES)} SELECT eps, least, count(DISTINCT cluster) AS clusters, count(*) FILTER (WHERE core) AS cores, count(*) FILTER (WHERE cluster IS NULL) AS noise FROM dense GROUP BY 1, 2")
def dbscan_grid(spark, sf):
    """Clusters, core rows and noise for each pair of radius and least number."""
    from heddle.operators.clusters import dbscan_grid as search

    counts = [F.count_distinct("cluster").alias("clusters"), F.count_if("core").alias("cores"), F.count_if(F.col("cluster").isNull()).alias("noise")]
    return search(vectors(spark, sf), DENSITIES).groupBy("eps", "least").agg(*counts)


@query("umap_kernels", f"""WITH {DIST}, r AS (SELECT src, min(score) AS rho FROM d GROUP BY src), k AS (SELECT src, dst, score FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(score, 9), dst) <= 5),
  p AS (SELECT src, dst, score, exp(-greatest(0, score - rho) / 0.5) AS p, 1 / (1 + 1.577 * score ** (2 * 0.895)) AS q FROM k JOIN r USING (src))
  SELECT src, dst, round(p, 5) AS p, round(q, 5) AS q, round(-p * ln(q + 0.01) - (1 - p) * ln(1 - q + 0.01), 5) AS ce FROM p""")  # fmt: skip
def umap_kernels(spark, sf):
    near = knn(spark, sf, 5, "euclidean")
    rho = F.min("score").over(Window.partitionBy("src"))
    p = F.exp(-F.greatest(F.lit(0.0), F.col("score") - F.col("rho")) / 0.5)
    q = 1 / (1 + 1.577 * F.pow("score", F.lit(2 * 0.895)))
    k = near.withColumn("rho", rho).select("src", "dst", p.alias("p"), q.alias("q"))
    ce = -F.col("p") * F.log(F.col("q") + 0.01) - (1 - F.col("p")) * F.log(1 - F.col("q") + 0.01)
    return k.select("src", "dst", F.round("p", 5).alias("p"), F.round("q", 5).alias("q"), F.round(ce, 5).alias("ce"))


def correlations(spark, sf):
    return M.pair_correlations(A.expr(spark, sf), "sample_id", n_samples(spark, sf))


def variances(spark, sf):
    return M.gene_stats(A.expr(spark, sf), "gene_id", n_samples(spark, sf)).select("gene_id", "var_samp")


TOP = f"{STATS}, {CORR}, top AS (SELECT * FROM corr ORDER BY round(abs(corr), 9) DESC, g1, g2 LIMIT 100)"
CAUSAL = f"""{TOP}, causal AS (SELECT CASE WHEN round(a.var_samp, 9) >= round(b.var_samp, 9) THEN g1 ELSE g2 END AS src, CASE WHEN round(a.var_samp, 9) >= round(b.var_samp, 9) THEN g2 ELSE g1 END AS dst, abs(corr) AS weight
  FROM top JOIN stats a ON a.gene_id = g1 JOIN stats b ON b.gene_id = g2)"""


@query("ranked_edges", A.sql(f"WITH {CORR} SELECT g1, g2, round(corr, 6) AS corr FROM corr ORDER BY round(abs(corr), 9) DESC, g1, g2 LIMIT 100", "expr"))
def ranked_edges(spark, sf):
    return correlations(spark, sf).orderBy(F.round(F.abs("corr"), 9).desc(), "g1", "g2").limit(100).withColumn("corr", R("corr"))


@query("causal_edges", A.sql(f"WITH {CAUSAL} SELECT src, dst, round(weight, 6) AS weight FROM causal", "expr"))
def causal_edges(spark, sf):
    return G.causal_edges(correlations(spark, sf), variances(spark, sf), 100).withColumn("weight", R("weight"))


@query("degree_centrality", A.sql(f"WITH {CAUSAL}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM causal UNION ALL SELECT dst FROM causal) GROUP BY 1), c AS (SELECT *, degree / (count(*) OVER () - 1)::DOUBLE AS c FROM d) SELECT node, degree, round(c, 6) AS centrality, c > avg(c) OVER () AS hub FROM c", "expr"))
def degree_centrality(spark, sf):
    d = G.degrees(G.causal_edges(correlations(spark, sf), variances(spark, sf), 100))
    return M.one_row(d, d.agg(F.avg("centrality").alias("m"))).select("node", "degree", R("centrality").alias("centrality"), (F.col("centrality") > F.col("m")).alias("hub"))


DIFF = """sz AS (SELECT sum(y) AS n1, sum(1 - y) AS n0 FROM samples),
  diff AS (SELECT gene_id, coalesce(sum(value) FILTER (WHERE y = 1), 0) / n1 - coalesce(sum(value) FILTER (WHERE y = 0), 0) / n0 AS diff FROM expr JOIN samples USING (sample_id), sz GROUP BY gene_id, n1, n0)"""


def difference(spark, sf):
    return M.case_control(A.expr(spark, sf), A.samples(spark, sf), "sample_id").select("gene_id", "diff")


_HASHED = "SELECT a.gene_id AS src, b.gene_id AS dst, {w} AS weight, '{t}' AS type FROM diff a JOIN diff b ON a.gene_id < b.gene_id WHERE ('0x' || substr(md5('{t}:' || a.gene_id || ':' || b.gene_id), 1, 6))::BIGINT % 100 < {p}"
KG = f"""{CORR}, {DIFF}, kg0 AS (SELECT CASE WHEN round(abs(a.diff), 9) > round(abs(b.diff), 9) THEN g1 ELSE g2 END AS src, CASE WHEN round(abs(a.diff), 9) > round(abs(b.diff), 9) THEN g2 ELSE g1 END AS dst, abs(corr) AS weight, 'correlation' AS type, 0 AS k
    FROM corr JOIN diff a ON a.gene_id = g1 JOIN diff b ON b.gene_id = g2 WHERE abs(corr) > 0.05),
  kg1 AS (SELECT * FROM kg0 UNION ALL SELECT *, 1 FROM ({_HASHED.format(w=1.5, t="ppi", p=5)}) UNION ALL SELECT *, 2 FROM ({_HASHED.format(w=2.0, t="pathway", p=3)})),
  kg AS (SELECT arg_min(src, k) AS src, arg_min(dst, k) AS dst, sum(weight) AS weight, list_sort(list(DISTINCT type)) AS types FROM kg1 GROUP BY least(src, dst), greatest(src, dst))"""


def knowledge(spark, sf):
    """Correlation edges, from the larger |difference| to the smaller, with digest-drawn interaction
    and pathway edges."""
    d = difference(spark, sf)
    c = correlations(spark, sf).where(F.abs("corr") > 0.05)
    c = c.join(d.select(F.col("gene_id").alias("g1"), F.col("diff").alias("d1")), "g1").join(d.select(F.col("gene_id").alias("g2"), F.col("diff").alias("d2")), "g2")
    first = F.round(F.abs("d1"), 9) > F.round(F.abs("d2"), 9)
    corr = c.select(F.when(first, F.col("g1")).otherwise(F.col("g2")).alias("src"), F.when(first, F.col("g2")).otherwise(F.col("g1")).alias("dst"), F.abs("corr").alias("weight"), F.lit("correlation").alias("type"))
    genes = d.select("gene_id")
    pairs = genes.select(F.col("gene_id").alias("src")).join(genes.select(F.col("gene_id").alias("dst")), F.col("src") < F.col("dst"))

    def drawn(kind, share, weight):
        h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{kind}:"), F.col("src").cast("string"), F.lit(":"), F.col("dst").cast("string"))), 1, 6), 16, 10).cast("long")
        return pairs.where(h % 100 < share).select("src", "dst", F.lit(weight).alias("weight"), F.lit(kind).alias("type"))

    return G.merge_edges([corr, drawn("ppi", 5, 1.5), drawn("pathway", 3, 2.0)])


@query("knowledge_graph", A.sql(f"WITH {KG} SELECT src, dst, round(weight, 6) AS weight, array_to_string(types, '+') AS types FROM kg", "expr", "samples"))
def knowledge_graph(spark, sf):
    return knowledge(spark, sf).select("src", "dst", R("weight").alias("weight"), F.array_join("types", "+").alias("types"))


@query("edge_type_histogram", A.sql(f"WITH {KG} SELECT src % 10 AS module, array_to_string(types, '+') AS types, count(*) AS n FROM kg GROUP BY 1, 2", "expr", "samples"))
def edge_type_histogram(spark, sf):
    return knowledge(spark, sf).groupBy((F.col("src") % 10).alias("module"), F.array_join("types", "+").alias("types")).agg(F.count("*").alias("n"))


@query("module_hubs", A.sql(f"WITH {KG}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM kg UNION ALL SELECT dst FROM kg) GROUP BY 1), c AS (SELECT node, node % 10 AS module, degree / (count(*) OVER () - 1)::DOUBLE AS c FROM d) SELECT node, module, c > avg(c) OVER (PARTITION BY module) AS hub FROM c", "expr", "samples"))
def module_hubs(spark, sf):
    d = G.degrees(knowledge(spark, sf)).withColumn("module", F.col("node") % 10)
    return d.select("node", "module", (F.col("centrality") > F.avg("centrality").over(Window.partitionBy("module"))).alias("hub"))


@query("driver_split", A.sql(f"WITH {DIFF}, p AS (SELECT gene_id % 10 AS module, quantile_cont(abs(diff), 0.7) AS p FROM diff GROUP BY 1) SELECT gene_id, gene_id % 10 AS module, abs(diff) > p AS driver FROM diff JOIN p ON module = gene_id % 10", "expr", "samples"))
def driver_split(spark, sf):
    """Drivers have an effect above the 70th percentile of their module; the rest are redundant."""
    d = difference(spark, sf).withColumn("module", F.col("gene_id") % 10)
    p = d.groupBy("module").agg(F.percentile(F.abs("diff"), 0.7).alias("p"))
    return d.join(p, "module").select("gene_id", "module", (F.abs("diff") > F.col("p")).alias("driver"))


MODULE = """ms AS (SELECT sample_id, gene_id % 10 AS module, sum(value) AS s FROM expr GROUP BY 1, 2), grid AS (SELECT s.sample_id, s.y, m.module, coalesce(ms.s, 0) AS s FROM (SELECT DISTINCT sample_id, y FROM expr JOIN samples USING (sample_id)) s CROSS JOIN range(10) m(module) LEFT JOIN ms ON ms.sample_id = s.sample_id AND ms.module = m.module)"""


def module_sums(spark, sf):
    """sample_id, y, module, s: sums of each module of genes, zeros included."""
    e = A.expr(spark, sf)
    s = e.groupBy("sample_id", (F.col("gene_id") % 10).alias("module")).agg(F.sum("value").alias("s"))
    seen = e.select("sample_id").distinct().join(A.samples(spark, sf), "sample_id").withColumn("module", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return seen.join(s, ["sample_id", "module"], "left").na.fill(0.0, ["s"])


@query("module_activity", A.sql(f"WITH {MODULE}, p AS (SELECT module, quantile_cont(s, 0.75) AS p FROM grid GROUP BY 1) SELECT module, count(*) FILTER (WHERE s > p) AS active, round(coalesce(count(*) FILTER (WHERE s > p AND y = 1) / nullif(sum(y), 0)::DOUBLE, 0), 6) AS disease_ratio FROM grid JOIN p USING (module) GROUP BY module", "expr", "samples"))
def module_activity(spark, sf):
    g = module_sums(spark, sf)
    p = g.groupBy("module").agg(F.percentile("s", 0.75).alias("p"))
    on = F.col("s") > F.col("p")
    return g.join(p, "module").groupBy("module").agg(F.sum(on.cast("long")).alias("active"), R(M.ratio(F.sum((on & (F.col("y") == 1)).cast("int")), F.sum("y"))).alias("disease_ratio"))


@query("sample_assignment", A.sql(f"WITH {MODULE}, p AS (SELECT module, CASE WHEN module < 5 THEN quantile_cont(s / 20, 0.75) ELSE quantile_cont(s / 20, 0.6) END AS p FROM grid GROUP BY module) SELECT sample_id, module, (s / 20 > p)::INT AS active FROM grid JOIN p USING (module)", "expr", "samples"))
def sample_assignment(spark, sf):
    """Mean driver expression above the 75th percentile (disease modules) or the 60th (common)."""
    g = module_sums(spark, sf).withColumn("m", F.col("s") / 20)
    p = g.groupBy("module").agg(F.when(F.col("module") < 5, F.percentile("m", 0.75)).otherwise(F.percentile("m", 0.6)).alias("p"))
    return g.join(p, "module").select("sample_id", "module", (F.col("m") > F.col("p")).cast("int").alias("active"))


@query("assignment_to_label", A.sql(f"WITH {MODULE}, p AS (SELECT module, quantile_cont(s, 0.9) AS p FROM grid GROUP BY module) SELECT sample_id, array_to_string(list_sort(list(module) FILTER (WHERE s > p)), '-') AS pattern FROM grid JOIN p USING (module) GROUP BY sample_id HAVING count(*) FILTER (WHERE s > p) > 0", "expr", "samples"))
def assignment_to_label(spark, sf):
    """A 0/1 row as the list of its active modules."""
    g = module_sums(spark, sf)
    p = g.groupBy("module").agg(F.percentile("s", 0.9).alias("p"))
    active = g.join(p, "module").where("s > p")
    return active.groupBy("sample_id").agg(F.array_join(F.sort_array(F.collect_list("module")).cast("array<string>"), "-").alias("pattern"))


@query("community_disease_ratio", A.sql("SELECT c_nationkey AS community, count(*) AS size, round(avg(y), 6) AS ratio, CASE WHEN avg(y) > 0.6 THEN 'disease' ELSE 'common' END AS kind FROM customer JOIN samples ON c_custkey = sample_id GROUP BY 1", "samples"))
def community_disease_ratio(spark, sf):
    j = table(spark, sf, "customer").join(A.samples(spark, sf), F.col("c_custkey") == F.col("sample_id"))
    s = j.groupBy(F.col("c_nationkey").alias("community")).agg(F.count("*").alias("size"), F.avg("y").alias("r"))
    return s.select("community", "size", R("r").alias("ratio"), F.when(F.col("r") > 0.6, "disease").otherwise("common").alias("kind"))


@query("community_characterisation", A.sql("""WITH t AS (SELECT gene_id, sum(value) AS total FROM expr GROUP BY 1), n AS (SELECT count(DISTINCT sample_id) AS n FROM expr), cs AS (SELECT c_nationkey AS c, count(DISTINCT sample_id) AS k FROM expr JOIN customer ON c_custkey = sample_id GROUP BY 1 HAVING count(DISTINCT sample_id) >= 3),
  s AS (SELECT c_nationkey AS c, gene_id, sum(value) AS s FROM expr JOIN customer ON c_custkey = sample_id GROUP BY 1, 2),
  e AS (SELECT cs.c, t.gene_id, coalesce(s.s, 0) / k - (total - coalesce(s.s, 0)) / nullif(n - k, 0) AS effect FROM cs CROSS JOIN t LEFT JOIN s ON s.c = cs.c AND s.gene_id = t.gene_id, n),
  p AS (SELECT c, quantile_cont(abs(effect), 0.85) AS p FROM e GROUP BY c) SELECT c AS community, gene_id, round(effect, 6) AS effect FROM e JOIN p USING (c) WHERE abs(effect) > p""", "expr"))  # fmt: skip
def community_characterisation(spark, sf):
    """Genes whose mean in a community of three or more differs most from the mean outside it."""
    e = A.expr(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("community")), "sample_id")
    size = e.groupBy("community").agg(F.count_distinct("sample_id").alias("k")).where("k >= 3")
    total = M.one_row(e.groupBy("gene_id").agg(F.sum("value").alias("total")), e.agg(F.count_distinct("sample_id").alias("n")))
    inside = e.groupBy("community", "gene_id").agg(F.sum("value").alias("s"))
    grid = total.join(size, how="cross").join(inside, ["community", "gene_id"], "left").na.fill(0.0, ["s"])
    effect = F.col("s") / F.col("k") - F.try_divide(F.col("total") - F.col("s"), F.col("n") - F.col("k"))
    grid = grid.select("community", "gene_id", effect.alias("effect"))
    p = grid.groupBy("community").agg(F.percentile(F.abs("effect"), 0.85).alias("p"))
    return grid.join(p, "community").where(F.abs("effect") > F.col("p")).select("community", "gene_id", R("effect").alias("effect"))


@query("regulation_counts", A.sql(f"WITH {DIFF} SELECT gene_id % 10 AS module, count(*) FILTER (WHERE diff > 0) AS up, count(*) FILTER (WHERE diff < 0) AS down, CASE WHEN count(*) FILTER (WHERE diff > 0) > count(*) FILTER (WHERE diff < 0) THEN 'mostly up-regulated' ELSE 'mostly down-regulated' END AS summary FROM diff GROUP BY 1", "expr", "samples"))
def regulation_counts(spark, sf):
    d = difference(spark, sf).groupBy((F.col("gene_id") % 10).alias("module")).agg(F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down"))
    return d.withColumn("summary", F.when(F.col("up") > F.col("down"), "mostly up-regulated").otherwise("mostly down-regulated"))


@query("top_features", A.sql(f"WITH {DIFF} SELECT gene_id % 10 AS module, array_to_string(list(gene_id ORDER BY round(abs(diff), 9) DESC, gene_id)[1:5], ',') AS drivers FROM diff GROUP BY 1", "expr", "samples"))
def top_features(spark, sf):
    d = difference(spark, sf).withColumn("module", F.col("gene_id") % 10)
    r = d.withColumn("rk", F.row_number().over(Window.partitionBy("module").orderBy(F.round(F.abs("diff"), 9).desc(), "gene_id"))).where("rk <= 5")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rk", "gene_id"))), lambda x: x["gene_id"].cast("string"))
    return r.groupBy("module").agg(F.array_join(ordered, ",").alias("drivers"))


@query("triangular_threshold", A.sql(f"WITH {CORR}, grid AS (SELECT td / 10.0::DOUBLE AS td, tc / 10.0::DOUBLE AS tc FROM range(1, 10) a(td), range(1, 10) b(tc)), e AS (SELECT g1, g2, td, tc FROM corr JOIN grid ON (((corr > td)::INT - corr) > tc)) SELECT td, tc, count(DISTINCT g) AS nodes FROM (SELECT td, tc, g1 AS g FROM e UNION ALL SELECT td, tc, g2 FROM e) GROUP BY 1, 2", "expr"))
def triangular_threshold(spark, sf):
    """Nodes of the edges that survive a pair of thresholds, for a grid of pairs; the comparison is
    taken before the difference, as the formula's precedence has it."""
    steps = F.array(*[F.lit(i / 10.0) for i in range(1, 10)])
    e = correlations(spark, sf).withColumn("td", F.explode(steps)).withColumn("tc", F.explode(steps))
    e = e.where((F.col("corr") > F.col("td")).cast("int") - F.col("corr") > F.col("tc"))
    return e.select("td", "tc", F.explode(F.array("g1", "g2")).alias("g")).groupBy("td", "tc").agg(F.count_distinct("g").alias("nodes"))


@query("community_silhouette", f"""WITH {DIST}, g AS (SELECT src, la, lb, avg(score * score) AS m FROM d GROUP BY 1, 2, 3),
  s AS (SELECT src, max(m) FILTER (WHERE la = lb) AS a, min(m) FILTER (WHERE la <> lb) AS b FROM g GROUP BY 1)
  SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")  # fmt: skip
def community_silhouette(spark, sf):
    """Mean silhouette of the labels, from sums of squared distances to clusters."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    v = vectors(spark, sf).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"), F.col("label").cast("int").alias("prediction"))
    score = ClusteringEvaluator().evaluate(v)
    return spark.createDataFrame([(round(float(score), 6),)], "silhouette double")


@query("ica_top_components", "WITH r AS (SELECT vec_id, i - 1 AS component, row_number() OVER (PARTITION BY vec_id ORDER BY abs(embedding[i]) DESC, i) AS rk FROM embeddings, range(1, 65) r(i)) SELECT vec_id, component::INT AS component FROM r WHERE rk <= 2")
def ica_top_components(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("component", "v"))
    return e.withColumn("rk", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.abs("v").desc(), "component"))).where("rk <= 2").select("vec_id", "component")


@query("ica_characterisation", """WITH e AS (SELECT vec_id, i - 1 AS feature, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)),
  r AS (SELECT vec_id, feature AS component FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, feature) <= 2),
  a AS (SELECT c.component, e.feature, count(*) FILTER (WHERE r.vec_id IS NOT NULL) AS n1, count(*) FILTER (WHERE r.vec_id IS NULL) AS n0, avg(v) FILTER (WHERE r.vec_id IS NOT NULL) AS m1, avg(v) FILTER (WHERE r.vec_id IS NULL) AS m0,
    var_pop(v) FILTER (WHERE r.vec_id IS NOT NULL) AS v1, var_pop(v) FILTER (WHERE r.vec_id IS NULL) AS v0 FROM e CROSS JOIN (SELECT DISTINCT component FROM r) c LEFT JOIN r ON r.vec_id = e.vec_id AND r.component = c.component GROUP BY 1, 2),
  z AS (SELECT 1.959963984540054::DOUBLE AS z), t AS (SELECT a.*, m1 - m0 AS effect, sqrt((n1 * v1 + n0 * v0) / (n1 + n0 - 2) * (1 / n1::DOUBLE + 1 / n0::DOUBLE)) AS error, (n1 + n0 - 2)::DOUBLE AS df, z FROM a, z WHERE n1 >= 3 AND n0 > 1)
  SELECT component::INT AS component, feature::INT AS feature, round(effect, 6) AS effect, n1 AS n_rows FROM t WHERE abs(effect) > 0.1
    AND abs(effect) > error * (z + (z ** 3 + z) / 4 / df + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96 / df ** 2 + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384 / df ** 3 + (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160 / df ** 4)""")  # fmt: skip
def ica_characterisation(spark, sf):
    """Features whose means differ between the rows of a component and the others."""
    from heddle.operators.metrics import characterise

    active = ica_top_components(spark, sf).withColumnRenamed("vec_id", "id")
    return characterise(vectors(spark, sf).select("id", "vector"), active).withColumn("effect", R("effect"))


@query("shared_neighbours", f"""WITH {COS}, n AS (SELECT src, dst FROM knn UNION SELECT vec_id, vec_id FROM embeddings), s AS (SELECT src, count(*) AS k FROM n GROUP BY 1),
  e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM knn),
  m AS (SELECT e.src, e.dst, count(*) AS shared FROM e JOIN n a ON a.src = e.src JOIN n b ON b.src = e.dst AND b.dst = a.dst GROUP BY 1, 2)
  SELECT e.src, e.dst, coalesce(shared, 0)::INT AS shared, round(coalesce(shared, 0) / (x.k + y.k - coalesce(shared, 0))::DOUBLE, 6) AS weight FROM e LEFT JOIN m USING (src, dst) JOIN s x ON x.src = e.src JOIN s y ON y.src = e.dst""")  # fmt: skip
def shared_neighbours(spark, sf):
    """Links of the neighbour graph, weighed by the share of neighbours that both ends have."""
    return C.shared_neighbours(knn(spark, sf)).withColumn("weight", R("weight"))


@query("graph_communities")
def graph_communities(spark, sf):
    """Rows only: communities in levels of the neighbour graph with shared weights; tests hold modularity
    and connectedness."""
    return C.communities(C.shared_neighbours(knn(spark, sf)).where("weight > 0"))


@query("mutual_neighbours", f"""WITH {DIST}, r AS (SELECT src, dst, src % 3 AS a, dst % 3 AS b FROM d QUALIFY row_number() OVER (PARTITION BY src, dst % 3 ORDER BY round(score, 9), dst) <= 10)
  SELECT x.src, x.dst, x.a::VARCHAR AS src_batch, x.b::VARCHAR AS dst_batch FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src WHERE x.a < x.b""")  # fmt: skip
def mutual_neighbours(spark, sf):
    """Pairs of rows of two batches that are among each other's ten nearest."""
    from heddle.operators.mutual import mutual_pairs

    return mutual_pairs(vectors(spark, sf).select("id", "vector", (F.col("id") % 3).alias("batch")), 10)


@query("mutual_merge")
def mutual_merge(spark, sf):
    """Rows only: batches moved onto one another along mutual neighbours; tests hold the shifts."""
    from heddle.operators.mutual import merge_batches

    return merge_batches(vectors(spark, sf).select("id", "vector", (F.col("id") % 3).alias("batch")), 10)


#: Neighbours and halvings of the widths.
AROUND, HALVINGS = 15, 20


@query("neighbour_widths", f"""WITH RECURSIVE {DIST}, k AS (SELECT src, score FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(score, 9), dst) <= {AROUND}),
  o AS (SELECT src, min(score) AS rho, list(score) AS s FROM k GROUP BY 1), v AS (SELECT src, rho, list_transform(s, lambda x: greatest(0, x - rho)) AS o FROM o),
  b(src, step, low, high) AS (SELECT src, 0, 0.0::DOUBLE, 1000.0::DOUBLE FROM v UNION ALL
    SELECT b.src, step + 1, CASE WHEN w THEN low ELSE m END, CASE WHEN w THEN m ELSE high END FROM (SELECT b.*, (low + high) / 2 AS m, list_sum(list_transform(o, lambda x: exp(-x / greatest((low + high) / 2, 1e-9)))) > log2({AROUND}.0) AS w FROM b JOIN v USING (src) WHERE step < {HALVINGS}) b)
  SELECT src, round(rho, 5) AS rho, round((low + high) / 2, 5) AS sigma FROM b JOIN v USING (src) WHERE step = {HALVINGS}""")  # fmt: skip
def neighbour_widths(spark, sf):
    """The nearest distance of each row, and the width of its fuzzy memberships, by bisection."""
    from heddle.operators.layout import widths

    return widths(knn(spark, sf, AROUND, "euclidean"), AROUND, HALVINGS).select("src", F.round("rho", 5).alias("rho"), F.round("sigma", 5).alias("sigma"))


@query("label_enrichment", """WITH t AS (SELECT count(*)::DOUBLE AS a, count(*) FILTER (WHERE vec_id % 4 = 0)::DOUBLE AS m FROM embeddings), g AS (SELECT label, count(*)::DOUBLE AS n, count(*) FILTER (WHERE vec_id % 4 = 0)::DOUBLE AS k FROM embeddings GROUP BY 1),
  i AS (SELECT label, n, m, a, unnest(range(k::BIGINT, least(n, m)::BIGINT + 1))::DOUBLE AS i FROM g, t)
  SELECT label, round(sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(a - m + 1) - lgamma(n - i + 1) - lgamma(a - m - n + i + 1) - lgamma(a + 1) + lgamma(n + 1) + lgamma(a - n + 1))), 7) AS p FROM i WHERE a - m - n + i >= 0 GROUP BY label""")  # fmt: skip
def label_enrichment(spark, sf):
    """How surely each label has more of every fourth row than its share: hypergeometric tails."""
    from heddle.operators.doublets import enrichment

    rows = vectors(spark, sf).select(F.col("label").alias("community"), (F.col("id") % 4 == 0).alias("marked"))
    return enrichment(rows).select(F.col("community").alias("label"), F.round("p", 7).alias("p"))
