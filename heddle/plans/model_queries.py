"""Queries on sources, generators and models. Models and draws are checked by rows and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators.layout import layout
from heddle.operators import generators, ml, sweeps
from heddle.plans import adapters as A
from heddle.plans.graph_queries import knn, vectors
from heddle.plans.registry import query
from heddle.sources import readers, sinks
from heddle.workspace import materialise, scratch_path, table

R = lambda c: F.round(c, 6)


@query("matrix_market_scan", A.sql("SELECT 'cell' || cell_id AS cell_id, 'gene' || gene_id AS gene_id, value FROM counts", "counts"))
def matrix_market_scan(spark, sf):
    """Counts written as a coordinate file with sidecars, each a folder of parts, and read back."""
    c = A.counts(spark, sf, readers.tasks(table(spark, sf, "lineitem").count()))
    cells = c.select("cell_id").distinct()
    from heddle.operators.order import with_position

    cells = materialise(with_position(cells, "cell_id", "c"), "cells")
    at = scratch_path(spark, "mtx")
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general", 0), (f"{A.GENES} {cells.count()} {c.count()}", 1)], "value string, k int")
    lines = c.join(cells, "cell_id").select(F.concat_ws(" ", (F.col("gene_id") + 1).cast("string"), F.col("c").cast("string"), F.col("value").cast("string")).alias("value"))
    # The banner and the sizes are a part of two lines; entries are in any order.
    head.repartition(1).sortWithinPartitions("k").select("value").write.text(f"{at}/matrix")
    lines.write.mode("append").text(f"{at}/matrix")
    spark.range(A.GENES).repartition(1).sortWithinPartitions("id").select(F.concat(F.lit("gene"), F.col("id").cast("string"), F.lit("\tname"))).write.text(f"{at}/genes")
    cells.repartitionByRange("c").sortWithinPartitions("c").select(F.concat(F.lit("cell"), F.col("cell_id").cast("string"))).write.text(f"{at}/cells")
    return readers.matrix_market(spark, f"{at}/matrix", f"{at}/genes", f"{at}/cells")


@query("csv_scan", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def csv_scan(spark, sf):
    at = scratch_path(spark, "csv")
    sinks.write_text(table(spark, sf, "customer"), at, "csv", header="true")
    return readers.csv_columns(spark, at, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", ["c_custkey", "c_mktsegment", "c_acctbal"])


@query("bed_scan", A.sql("SELECT chrom, start, \"end\" AS stop, motif_id::VARCHAR AS name, strand FROM motifs", "motifs"))
def bed_scan(spark, sf):
    at = scratch_path(spark, "bed")
    a = A.intervals(spark, sf)[0]
    sinks.write_text(a.select("chrom", "start", "end", "motif_id", F.lit("0").alias("score"), "strand"), at, "csv", sep="\t")
    return readers.bed(spark, at).select("chrom", "start", F.col("end").alias("stop"), "name", "strand")


@query("fasta_scan", "SELECT 'part' || p_partkey AS name, upper(replace(p_name, ' ', '')) AS sequence FROM part")
def fasta_scan(spark, sf):
    at = scratch_path(spark, "fasta")
    text = F.concat(F.lit(">part"), F.col("p_partkey").cast("string"), F.lit(" description\n"), F.upper(F.replace("p_name", F.lit(" "), F.lit("\n"))))
    table(spark, sf, "part").select(text).write.text(at)
    return readers.fasta(spark, at)


@query("token_line_scan", "SELECT p_name AS line, len(string_split(p_name, ' '))::INT AS n FROM part")
def token_line_scan(spark, sf):
    at = scratch_path(spark, "lines")
    table(spark, sf, "part").select("p_name").write.text(at)
    return readers.token_lines(spark, at).select(F.array_join("tokens", " ").alias("line"), F.size("tokens").alias("n"))


@query("document_query", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type = 'click' AND value > 5")
def document_query(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("date"), F.col("event_type").alias("protocolId"), (F.col("value") > 5).alias("answered"))
    return readers.documents_query(d, F.lit("2024-01-20").cast("timestamp"), "click").select("event_id", "user_id")


@query("append_with_types", "SELECT event_id, value::INT AS value FROM (SELECT event_id, floor(value) AS value FROM events UNION ALL SELECT event_id, floor(value) FROM events)")
def append_with_types(spark, sf):
    at = scratch_path(spark, "appended")
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), F.floor("value").cast("string").alias("value"))
    for _ in range(2):
        sinks.append_table(e, at, {"event_id": "long", "value": "int"})
    return spark.read.parquet(at)


@query("sample_pivot", "SELECT p_brand, " + ", ".join(f"max(p_retailprice) FILTER (WHERE p_type = '{t}') AS {t}" for t in ("ECONOMY", "PROMO", "SMALL")) + " FROM part GROUP BY 1")
def sample_pivot(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("v"))
    return readers.pivot_samples(p, "p_brand", "p_type", "v", ["ECONOMY", "PROMO", "SMALL"])


@query("cell_dataset_bundle", A.sql("SELECT cell_id, gene_id, value, y FROM counts JOIN obs USING (cell_id)", "counts", "obs"))
def cell_dataset_bundle(spark, sf):
    at = scratch_path(spark, "bundle")
    genes = spark.range(A.GENES).select(F.col("id").alias("gene_id"), (F.col("id") % 20 == 0).alias("mt"))
    sinks.CellDataset(A.counts(spark, sf), A.obs(spark, sf), genes, uns={"origin": "lineitem"}).write(at)
    got = sinks.CellDataset.read(spark, at)
    # Compressed files of ascending ids look small enough to broadcast, whatever their rows.
    return got.counts.join(got.obs.select("cell_id", "y").hint("merge"), "cell_id").select("cell_id", "gene_id", "value", "y")


@query("array_file_scan", "SELECT * FROM (SELECT vec_id, unnest(range(len(embedding))) AS col, unnest(embedding)::DOUBLE AS value FROM embeddings WHERE embedding IS NOT NULL) WHERE value <> 0")
def array_file_scan(spark, sf):
    """Embeddings written as NPY files, one a partition, and read back by ranges of them."""
    from heddle.sources.partitioned import array_entries

    at = scratch_path(spark, "arrays")
    sinks.write_numpy(vectors(spark, sf).where("vector IS NOT NULL"), at)
    cells = array_entries(spark, at)
    ids = cells.where("col = 0").select("array", "row", F.col("value").cast("long").alias("vec_id"))
    # The entry of id 0 is a zero, which isn't stored.
    return cells.where("col > 0").join(ids, ["array", "row"], "left").select(F.coalesce("vec_id", F.lit(0).cast("long")).alias("vec_id"), (F.col("col") - 1).alias("col"), "value")


@query("archive_scan", A.sql("SELECT chrom, start, \"end\", 'cell' || motif_id AS barcode, (motif_id % 7)::INT AS count FROM motifs", "motifs"))
def archive_scan(spark, sf):
    """Fragments written as archives of compressed members, and read back."""
    at = scratch_path(spark, "archives")
    a = A.intervals(spark, sf)[0]
    fields = ["chrom", "start", "end", F.concat(F.lit("cell"), F.col("motif_id").cast("string")), F.col("motif_id") % 7]
    sinks.write_archives(a.select(F.concat_ws("\t", *fields).alias("line")), at)
    return readers.archived_fragments(spark, at).drop("member")


#: Cells of a compressed block.
COLUMNS = 64


@query("compressed_columns", A.sql(f"SELECT cell_id // {COLUMNS} AS block, (cell_id % {COLUMNS})::INT AS col, gene_id AS row, value FROM counts", "counts"))
def compressed_columns(spark, sf):
    """Counts packed as compressed columns, a triple for each block of cells, and expanded again."""
    entry = F.struct((F.col("cell_id") % COLUMNS).cast("int").alias("col"), F.col("gene_id").alias("row"), "value")
    packed = A.counts(spark, sf).groupBy(F.expr(f"cell_id div {COLUMNS}").alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    ends = F.transform(F.sequence(F.lit(0), F.lit(COLUMNS)), lambda c: F.size(F.filter("e", lambda x: x["col"] < c)).cast("long"))
    return readers.expand_columns(packed.select("block", F.col("e.value").alias("data"), F.col("e.row").alias("indices"), ends.alias("indptr")))


SPEC = [
    {"type": "disease", "drivers": [0, 1, 2], "effects": [2.0, 1.5, -0.8], "redundant": [3, 4]},
    {"type": "common", "drivers": [10, 11], "effects": [1.0, -0.5], "redundant": [12]},
]


def customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))


@query("synthetic_mechanisms")
def synthetic_mechanisms(spark, sf):
    """A drawn sample for each customer."""
    return generators.mechanisms(spark, customers(spark, sf), 50, SPEC)


@query("synthetic_families")
def synthetic_families(spark, sf):
    return generators.redundant_families(spark, customers(spark, sf))


@query("synthetic_classes")
def synthetic_classes(spark, sf):
    return generators.classification_set(spark, customers(spark, sf), 40)


def vector_rows(spark, sf):
    return ml.features(vectors(spark, sf), "vector")


@query("pca_scores")
def pca_scores(spark, sf):
    return ml.pca(vector_rows(spark, sf), 5)[0].select("id", "pca")


@query("kmeans_sweep")
def kmeans_sweep(spark, sf):
    """k = 2..49."""
    return spark.createDataFrame(sweeps.kmeans_sweep(vectors(spark, sf), range(2, 50)), "k int, inertia double, silhouette double")


@query("mixture_sweep")
def mixture_sweep(spark, sf):
    """Four kinds of covariance at k = 10, then full ones at k = 2..49, on three principal components."""
    scores = materialise(ml.pca(vector_rows(spark, sf), 3)[0].select("id", F.col("pca").alias("vector")), "scores")
    models = [(kind, 10) for kind in sweeps.KINDS] + [("full", k) for k in range(2, 50) if k != 10]
    return spark.createDataFrame(sweeps.mixture_sweep(scores, models), "covariance string, k int, aic double, bic double")


@query("classifier_scores")
def classifier_scores(spark, sf):
    """Held-out scores of the four classifiers on one class against the rest."""
    from heddle.operators.splits import unit_hash

    rows = vector_rows(spark, sf).withColumn("y", (F.col("label") == 1).cast("double")).withColumnRenamed("y", "target")
    rows = rows.withColumn("h", unit_hash(F.col("id"), 1)).withColumnRenamed("label", "digit").withColumnRenamed("target", "label")
    train, test = rows.where("h < 0.8"), rows.where("h >= 0.8")
    out = []
    for name, options in (("LR", {}), ("RF", {"numTrees": 10}), ("XG", {"maxIter": 5}), ("SVM", {"maxIter": 10})):
        got = ml.classifier(name, **options).fit(train).transform(test)
        out.append((name, float(got.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0])))
    return spark.createDataFrame(out, "model string, accuracy double")


@query("kernel_classifier_scores")
def kernel_classifier_scores(spark, sf):
    """Held-out scores over all classes of the radial machine; tests hold it against the exact kernel."""
    from heddle.operators import metrics
    from heddle.operators.kernel_machine import kernel_classifier
    from heddle.operators.splits import unit_hash

    rows = vectors(spark, sf).withColumn("h", unit_hash(F.col("id"), 1))
    test = rows.where("h >= 0.8")
    found = kernel_classifier(rows.where("h < 0.8"), test).join(test.select("id", "label"), "id")
    per = metrics.per_class(metrics.confusion(found, "label", "prediction"))
    return per.select("label", R("precision").alias("precision"), R("recall").alias("recall"), R("f1").alias("f1"))


@query("word_vectors")
def word_vectors(spark, sf):
    from heddle.functions.text import tokens

    return ml.word_vectors(table(spark, sf, "conversations").select(tokens(F.lower("text")).alias("t")), "t", 16)


@query("spectral_modules")
def spectral_modules(spark, sf):
    """Rows only: modules of the neighbour graph, as many as its spectrum has before its largest gap."""
    from heddle.operators.spectral import spectral_modules as modules

    return modules(knn(spark, sf).where("score > 0").select("src", "dst", F.col("score").alias("weight")))


@query("graph_spectrum")
def graph_spectrum(spark, sf):
    """Rows only: the leading eigenvalues of the neighbour graph, and the number of modules by either rule."""
    from heddle.operators import spectral

    links, nodes = spectral.normalised_links(knn(spark, sf).where("score > 0").select("src", "dst", F.col("score").alias("weight")))
    values, _ = spectral.top_eigen(links, nodes, 6, tolerance=1e-5)
    n = nodes.count()
    rows = [(i, round(float(v), 6), ml.eigengap(1 - values, n), spectral.module_count(values, n)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "place int, eigenvalue double, modules_by_gap int, modules_by_drop int")


@query("ica_components")
def ica_components(spark, sf):
    return ml.fast_ica(vectors(spark, sf), 5)


@query("umap_embedding")
def umap_embedding(spark, sf):
    """Rows only: a plane layout of all rows, drawn to their labels; tests hold its trustworthiness."""
    return layout(vectors(spark, sf), supervised=True)


@query("umap_in_batches")
def umap_in_batches(spark, sf):
    """The second variant: from the graph's eigenvectors, by random batches of rows, without labels."""
    return layout(vectors(spark, sf), spectral=True, batch=100)


@query("shared_factors")
def shared_factors(spark, sf):
    positive = vectors(spark, sf).select("id", F.transform("vector", lambda x: F.abs(x)).alias("vector"), F.pmod("id", F.lit(2)).cast("int").alias("block"))
    return ml.shared_factors(positive, 2, 4)


@query("batch_correction")
def batch_correction(spark, sf):
    return ml.correct_batches(vectors(spark, sf).select("id", "vector", F.pmod("id", F.lit(3)).cast("int").alias("batch")), 3)


@query("doublet_scores")
def doublet_scores(spark, sf):
    return ml.doublet_scores(vectors(spark, sf).select("id", F.transform("vector", lambda x: 10 * F.abs(x)).alias("vector")))


@query("doublet_calls")
def doublet_calls(spark, sf):
    """Rows only: scores and calls above the valley of the simulated sums' scores; tests plant doublets."""
    from heddle.operators.doublets import doublet_calls as calls

    return calls(vectors(spark, sf).select("id", F.transform("vector", lambda x: 10 * F.abs(x)).alias("vector")))


#: Rows of a smoothing window; the weights of all its cuts are in the SQL.
WINDOW = 11
_STENCIL = ", ".join(f"({b}, {a}, {o}, {x!r}::DOUBLE)" for b, a, o, x in ml.stencil(WINDOW))


@query("smoothed_curve", f"""WITH v AS (SELECT user_id, avg(value) AS v FROM events GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY user_id) AS at, count(*) OVER () AS n FROM v),
  w(before, after, o, weight) AS (VALUES {_STENCIL})
  SELECT p.user_id, round(sum(q.v * weight), 6) AS smooth FROM p JOIN w ON w.before = least({WINDOW // 2}, p.at - 1) AND w.after = least({WINDOW // 2}, p.n - p.at) JOIN p q ON q.at = p.at + o GROUP BY 1""")  # fmt: skip
def smoothed_curve(spark, sf):
    """By the weights of local polynomials."""
    return ml.smooth(table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("v")), "user_id", "v", WINDOW).select("user_id", R("smooth").alias("smooth"))


@query("grid_search_forest")
def grid_search_forest(spark, sf):
    """The best parameters of a forest by cross-validation, one class against the rest."""
    rows = vector_rows(spark, sf).select("features", (F.col("label") == 1).cast("double").alias("label"))
    best = ml.grid_search(rows, ml.classifier("RF"), {"numTrees": [5, 10], "maxDepth": [2, 4]}, folds=3)
    tried = [({p.name: int(v) for p, v in m.items()}, float(x)) for m, x in zip(best.getEstimatorParamMaps(), best.avgMetrics, strict=True)]
    return spark.createDataFrame([(m["numTrees"], m["maxDepth"], x) for m, x in tried], "trees int, depth int, auc double")


@query("classifier_on_mcc")
def classifier_on_mcc(spark, sf):
    """Rows only: forests and boosted trees over all classes, chosen on MCC of validation rows, with MCC of
    test rows; tests hold the trees against brute force."""
    from heddle.operators import trees
    from heddle.operators.splits import unit_hash

    def forest(n, depth):
        def model(train, rows):
            fitted = ml.classifier("RF", numTrees=n, maxDepth=depth).fit(ml.features(train, "vector"))
            return fitted.transform(ml.features(rows, "vector")).select("id", F.col("prediction").cast("int").alias("prediction"))

        return model

    boosted = lambda train, rows: trees.predict_boosted(trees.fit_boosted(train, rounds=4, depth=2, bins=16), rows)
    models = {f"forest_{n}_{d}": forest(n, d) for n, d in ((10, 3), (20, 5))} | {"boosted": boosted}
    rows = vectors(spark, sf).where("label IS NOT NULL").withColumn("h", unit_hash(F.col("id"), 1))
    found = trees.chosen_on_mcc(models, rows.where("h < 0.6"), rows.where("h >= 0.6 AND h < 0.8"), rows.where("h >= 0.8"))
    return spark.createDataFrame(found, "model string, validation_mcc double, test_mcc double, chosen boolean")


@query("shuffled_chunks")
def shuffled_chunks(spark, sf):
    from heddle.operators.sequences import shuffled_chunks as shuffle

    return shuffle(table(spark, sf, "documents"), "doc_id", "text", 8, 4)


@query("random_training_windows")
def random_training_windows(spark, sf):
    from heddle.operators.sequences import random_windows

    return random_windows(table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("tokens")), "doc_id", "tokens")


@query("model_answers", "SELECT c_custkey, 'Outcome: ' || length(c_mktsegment) % 2 AS answer FROM customer")
def model_answers(spark, sf):
    """The inference loop with a stand-in model."""
    from heddle.operators.sequences import predict

    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return predict(c, "c_custkey", "c_mktsegment", lambda texts: [f"Outcome: {len(t) % 2}" for t in texts]).select("c_custkey", "answer")


@query("text_embeddings")
def text_embeddings(spark, sf):
    from heddle.operators.sequences import embed

    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return embed(c, "id", "text")
