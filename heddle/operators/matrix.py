"""Count-matrix operators on long sparse frames; absent entries are zeros and count as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def one_row(frame: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a frame of exactly one row."""
    return frame.join(F.broadcast(scalars), how="cross")


def gene_stats(matrix: DataFrame, key: str, n_rows: DataFrame) -> DataFrame:
    """key, n (non-zero), total, mean, var_pop, var_samp over all rows, zeros included.

    ``n_rows`` has one row and the column ``rows``, the number of cells or samples.
    """
    sums = matrix.groupBy(key).agg(
        F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares")
    )
    with_n = one_row(sums, n_rows)
    mean = F.col("total") / F.col("rows")
    pop = F.greatest(F.lit(0.0), F.col("squares") / F.col("rows") - mean * mean)
    return with_n.select(key, "n", "total", mean.alias("mean"), pop.alias("var_pop"), ratio(pop * F.col("rows"), F.col("rows") - 1).alias("var_samp"), "rows")


def cell_qc(matrix: DataFrame, flags: DataFrame, top: int = 50) -> DataFrame:
    """Per cell: genes, counts, share of the ``top`` largest genes, and of each flagged set.

    ``flags`` has gene_id and boolean columns; one row per gene.
    """
    names = [c for c in flags.columns if c != "gene_id"]
    ranked = matrix.withColumn("_rank", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("value"), "gene_id")))
    of = lambda c: F.sum(F.when(c, F.col("value")).otherwise(0.0))
    joined = ranked.join(flags, "gene_id", "left")
    sums = joined.groupBy("cell_id").agg(
        F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("n_genes_by_counts"), F.sum("value").alias("total_counts"), of(F.col("_rank") <= top).alias("_top"),
        *[of(F.col(n)).alias(f"total_counts_{n}") for n in names],
    )
    share = lambda c: 100.0 * ratio(F.col(c), F.col("total_counts"))
    return sums.select(
        "cell_id", "n_genes_by_counts", "total_counts", F.log1p("n_genes_by_counts").alias("log1p_n_genes_by_counts"), F.log1p("total_counts").alias("log1p_total_counts"),
        share("_top").alias(f"pct_counts_in_top_{top}_genes"), *[f"total_counts_{n}" for n in names], *[share(f"total_counts_{n}").alias(f"pct_counts_{n}") for n in names],
    )


def filter_cells(matrix: DataFrame, qc: DataFrame, min_genes: int, min_counts: float, max_pct_mt: float) -> DataFrame:
    good = qc.where((F.col("n_genes_by_counts") >= min_genes) & (F.col("total_counts") >= min_counts) & (F.col("pct_counts_mt") < max_pct_mt))
    return matrix.join(good.select("cell_id"), "cell_id", "left_semi")


def normalise(matrix: DataFrame, target: float = 1e4) -> DataFrame:
    """Scale each cell to ``target`` counts, then log1p."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    return matrix.withColumn("value", F.log1p(F.col("value") * target / total))


def case_control(matrix: DataFrame, labels: DataFrame, row: str) -> DataFrame:
    """gene_id, mean_case, mean_control, diff, over all rows of each class, zeros included."""
    sizes = labels.agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    sums = matrix.join(labels, row).groupBy("gene_id").agg(
        F.sum(F.when(F.col("y") == 1, F.col("value")).otherwise(0.0)).alias("s1"), F.sum(F.when(F.col("y") == 0, F.col("value")).otherwise(0.0)).alias("s0")
    )
    means = one_row(sums, sizes).select("gene_id", ratio(F.col("s1"), F.col("n1")).alias("mean_case"), ratio(F.col("s0"), F.col("n0")).alias("mean_control"))
    return means.withColumn("diff", F.col("mean_case") - F.col("mean_control"))


def pair_correlations(matrix: DataFrame, row: str, n_rows: DataFrame) -> DataFrame:
    """g1 < g2, corr of all gene pairs; constant genes have 0.

    Sums of products come from a self-join on the row, so a row costs the square of its genes, not
    of all genes; zeros enter through the sums and the number of rows. Pairs that no row has
    together are told from the genes alone.
    """
    stats = one_row(matrix.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")), n_rows)
    a, b = matrix.select(row, F.col("gene_id").alias("g1"), F.col("value").alias("x")), matrix.select(row, F.col("gene_id").alias("g2"), F.col("value").alias("z"))
    products = a.join(b, row).where("g1 < g2").groupBy("g1", "g2").agg(F.sum(F.col("x") * F.col("z")).alias("p"))
    left = stats.select(F.col("gene_id").alias("g1"), F.col("s").alias("s1"), F.col("q").alias("q1"), "rows")
    right = stats.select(F.col("gene_id").alias("g2"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    full = left.join(right, F.col("g1") < F.col("g2")).join(products, ["g1", "g2"], "left")
    n, p = F.col("rows"), F.coalesce("p", F.lit(0.0))
    cov = n * p - F.col("s1") * F.col("s2")
    spread = (n * F.col("q1") - F.col("s1") * F.col("s1")) * (n * F.col("q2") - F.col("s2") * F.col("s2"))
    return full.select("g1", "g2", F.when(spread > 0, cov / F.sqrt(spread)).otherwise(0.0).alias("corr"))


def variable_genes(matrix: DataFrame, n_rows: DataFrame, bins: int = 20) -> DataFrame:
    """Per gene of a log1p matrix: mean, dispersion, and dispersion normalised within mean bins.

    The common flavour: statistics of expm1 values, dispersion = variance / mean, both logged,
    equal-width bins of means, z-score of dispersions in a bin. In a bin of one gene the deviation is
    the mean and the mean 0.
    """
    raw = matrix.withColumn("value", F.expm1("value"))
    stats = gene_stats(raw, "gene_id", n_rows)
    mean = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    disp = F.col("var_samp") / mean
    rows = stats.select("gene_id", F.log1p(mean).alias("mean"), F.log(F.when(disp > 0, disp)).alias("disp"))
    limits = rows.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = one_row(rows, limits).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("mean") - F.col("lo"), width), F.lit(0.0)))).cast("int"))
    w = Window.partitionBy("bin")
    m, s, k = F.avg("disp").over(w), F.stddev_samp("disp").over(w), F.count("disp").over(w)
    m0, s0 = F.when(k > 1, m).otherwise(0.0), F.when(k > 1, s).otherwise(m)
    return placed.select("gene_id", "mean", "disp", "bin", F.try_divide(F.col("disp") - m0, s0).alias("disp_norm"))


def standardise(matrix: DataFrame, n_rows: DataFrame, key: str = "gene_id", ddof: int = 1, limit: float | None = None) -> DataFrame:
    """Non-zero entries as z-scores over all rows; a constant column's scale is 1.

    The z-score of a zero entry is -mean/sd of its column, the same for all, and stays implicit.
    """
    stats = gene_stats(matrix, key, n_rows)
    sd = F.sqrt(F.col("var_samp" if ddof else "var_pop"))
    scale = F.when(sd > 0, sd).otherwise(1.0)
    z = (F.col("value") - F.col("mean")) / scale
    if limit is not None:
        z = F.least(F.lit(limit), F.greatest(F.lit(-limit), z))
    return matrix.join(stats.select(key, "mean", "var_samp", "var_pop"), key).withColumn("z", z).drop("mean", "var_samp", "var_pop")


def average_ranks(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """``rank`` of ``value`` within ``group``; ties share the mean of their ranks."""
    w = Window.partitionBy(*group)
    ties = F.count("*").over(Window.partitionBy(*group, value))
    return rows.withColumn("rank", F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0)
