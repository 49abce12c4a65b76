"""Evaluation of predictions and of discovered sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.special import t_two_sided
from heddle.operators.matrix import one_row, ratio
from heddle.workspace import materialise


def confusion(p: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return p.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))


def per_class(c: DataFrame) -> DataFrame:
    """From a confusion table: label, tp, support, predicted, precision, recall, f1 of each class."""
    both = c.select(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp"))
    both = both.union(c.select(F.col("yhat").alias("label"), F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long")))
    s = both.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return s.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def averages(c: DataFrame) -> DataFrame:
    """One row: accuracy and macro, weighted and micro averages."""
    s = per_class(c)
    macro = [F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")]
    weighted = [ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")]
    return s.agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), ratio(F.sum("tp"), F.sum("predicted")).alias("precision_micro"), *macro, *weighted)


def matthews(c: DataFrame) -> DataFrame:
    """Multiclass MCC in closed form: (c s - sum p t) / sqrt((s^2 - sum p^2)(s^2 - sum t^2))."""
    a = per_class(c).agg(
        F.sum("tp").cast("double").alias("c"), F.sum("support").cast("double").alias("s"), F.sum(F.col("predicted").cast("double") * F.col("support")).alias("pt"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("pp"), F.sum(F.col("support").cast("double") * F.col("support")).alias("tt"),
    )
    return a.select(ratio(F.col("c") * F.col("s") - F.col("pt"), F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))).alias("mcc"))


def score_steps(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and distinct score, in descending order: positives and negatives at or above it.

    Scores are counted first, so a window runs over distinct scores, not rows.
    """
    counts = scores.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return counts.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("n").over(w), "pos": F.sum("p").over(whole), "neg": F.sum("n").over(whole)})


def auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve per key: positives over negatives, ties half; null without both."""
    s = score_steps(scores, keys)
    area = F.sum(F.col("p") * (F.col("neg") - F.col("fp") + F.col("n") / 2.0))
    return s.groupBy(*keys, "pos", "neg").agg(F.try_divide(area, F.col("pos") * F.col("neg")).alias("auc"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    two = lambda n: n * (n - 1) / 2.0
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    index = cells.agg(F.sum(two(F.col("n"))).alias("index"), F.sum("n").alias("total"))
    row = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("rows"))
    col = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("cols"))
    one = one_row(one_row(index, row), col)
    expected = ratio(F.col("rows") * F.col("cols"), two(F.col("total")))
    top = (F.col("rows") + F.col("cols")) / 2.0
    return one.select(F.when(top == expected, 1.0).otherwise((F.col("index") - expected) / (top - expected)).alias("ari"))


def set_scores(truth: Column, found: Column) -> dict[str, Column]:
    """Jaccard, precision, recall and F1 of two arrays taken as sets."""
    common, union = F.size(F.array_intersect(truth, found)), F.size(F.array_union(truth, found))
    j, p, r = ratio(common, union), ratio(common, F.size(F.array_distinct(found))), ratio(common, F.size(F.array_distinct(truth)))
    return {"jaccard": j, "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def efficiency(seconds: Column, megabytes: Column) -> Column:
    """Mean of a time score (300 s cost 50 points) and a memory score (1000 MB cost 30)."""
    time = F.greatest(F.lit(0.0), 100 - seconds / 300 * 50)
    memory = F.greatest(F.lit(0.0), 100 - megabytes / 1000 * 30)
    return F.when(megabytes.isNull(), time).otherwise((time + memory) / 2)


def global_score(discovery: Column, assignment: Column, eff: Column) -> Column:
    """Weights .4, .2, .2, .2; the last two parts are 70 and 70 + (efficiency - 50) / 10."""
    last = 70 + (eff - 50) * 0.1
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 0.4 * discovery + 0.2 * assignment + 0.2 * F.lit(70.0) + 0.2 * last))


def greedy_match(similar: DataFrame, least: float = 0.1) -> DataFrame:
    """gt, disc, score: truths in ascending order each take the best discovery that is still free (ties: the
    lesser one), if its score is above ``least``. ``similar``: gt, disc, score, a row a pair.

    In rounds: each truth asks for its best discovery that no lesser truth holds, and each discovery is held
    by the least truth that asks. Holders only become less, and when none changes, no truth could have done
    better: the matching in order. Rounds are as many as the longest chain of refusals, never one group.
    """
    pairs = materialise(similar.where(F.col("score") > least).select("gt", "disc", "score"), "pairs")
    held = materialise(pairs.limit(0), "held")
    while True:
        free = pairs.join(held.select("disc", F.col("gt").alias("_holder")), "disc", "left").where("_holder IS NULL OR _holder >= gt")
        asked = free.groupBy("gt").agg(F.min_by(F.struct("disc", "score"), F.struct(-F.col("score"), "disc")).alias("b")).select("gt", "b.*")
        new = asked.groupBy("disc").agg(F.min(F.struct("gt", "score")).alias("b"))
        new = materialise(new.select("b.gt", "disc", "b.score"), "held")
        if new.join(held, ["gt", "disc"], "left_anti").isEmpty():
            return new
        held = new


def characterise(rows: DataFrame, active: DataFrame, least_rows: int = 3, effect: float = 0.1) -> DataFrame:
    """component, feature, effect, n_rows: features of rows (id, vector) whose means differ between the
    rows active in a component (id, component) and the others, by Student's test at 5 % and by more
    than ``effect``. Components of fewer than ``least_rows`` rows, or that leave fewer than two, have none.
    """
    moments = lambda tail: [F.count("v").alias(f"n{tail}"), F.sum("v").alias(f"s{tail}"), F.sum(F.col("v") * F.col("v")).alias(f"q{tail}")]
    spread = F.posexplode(F.transform("vector", lambda x: x.cast("double"))).alias("feature", "v")
    every = rows.select(spread).groupBy("feature").agg(*moments(""))
    inside = rows.join(active.select("id", "component"), "id").select("component", spread).groupBy("component", "feature").agg(*moments("1"))
    both = inside.join(every, "feature").withColumns({"n0": F.col("n") - F.col("n1"), "s0": F.col("s") - F.col("s1"), "q0": F.col("q") - F.col("q1")})
    both = both.where((F.col("n1") >= least_rows) & (F.col("n0") > 1))
    rest = lambda i: F.greatest(F.lit(0.0), F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col(f"n{i}"))
    gap = F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")
    error = F.sqrt((rest(1) + rest(0)) / (F.col("n") - 2) * (1 / F.col("n1") + 1 / F.col("n0")))
    found = both.select("component", "feature", gap.alias("effect"), t_two_sided(F.try_divide(gap, error), (F.col("n") - 2).cast("double")).alias("_p"), F.col("n1").alias("n_rows"))
    # Without any spread, means that differ do so surely.
    return found.where((F.abs("effect") > effect) & (F.coalesce("_p", F.lit(0.0)) < 0.05)).drop("_p")
