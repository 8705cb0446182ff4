"""Scores of class predictions; everything after the first count is a small table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.scale import add_slice, pin_small, running_before, slice_bounds


def pair_counts(df: DataFrame, actual: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, actual: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """Counts for every pair of the fixed label list, zeros included."""
    listed = F.array(*[F.lit(v) for v in labels])
    grid = df.sparkSession.range(1).select(F.explode(listed).alias("actual"))
    grid = grid.select("actual", F.explode(listed).alias("pred"))
    counts = pair_counts(df, actual, pred)
    return grid.join(counts, ["actual", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_pct(matrix: DataFrame) -> DataFrame:
    """Share of each row of the matrix; null for classes without rows."""
    row = F.sum("n").over(Window.partitionBy("actual"))
    return matrix.select("actual", "pred", F.try_divide(F.col("n"), row).alias("pct"))


def per_class_accuracy(matrix: DataFrame) -> DataFrame:
    """(true positives + true negatives) / all rows, per class."""
    rows = matrix.groupBy(F.col("actual").alias("label")).agg(
        F.sum("n").alias("_row"), F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n"))).alias("_hit")
    )
    cols = matrix.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("_col"))
    total = matrix.agg(F.sum("n")).scalar()
    return rows.join(cols, "label").select(
        "label", ((total - F.col("_row") - F.col("_col") + 2 * F.col("_hit")) / total).alias("accuracy")
    )


def _sides(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per label: rows with it, predictions of it, hits.  All labels of either side."""
    both = pairs.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("n").alias("row"), F.lit(0).alias("col")),
                F.struct(F.col("pred").alias("label"), F.lit(0).alias("row"), F.col("n").alias("col")),
            )
        ).alias("_s"),
        F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0).alias("_hit"),
    )
    return both.groupBy(*by, F.col("_s.label").alias("label")).agg(
        F.sum("_s.row").alias("row"),
        F.sum("_s.col").alias("col"),
        # a hit is listed once as a row and once as a column
        (F.sum("_hit") / 2).alias("hit"),
    )


def fold_scores(df: DataFrame, actual: str, pred: str, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Accuracy, balanced accuracy, kappa, F1, macro recall and precision, MCC and AUC per fold."""
    by = list(by)
    sides = _sides(pair_counts(df, actual, pred, by), by)
    # labels x folds from here on
    sides = sides.withColumn("_rows", F.sum("row").over(Window.partitionBy(*by)))
    recall = F.try_divide(F.col("hit"), F.col("row"))
    precision = F.try_divide(F.col("hit"), F.col("col"))
    true_negative_rate = 1 - F.try_divide(F.col("col") - F.col("hit"), F.col("_rows") - F.col("row"))
    sums = sides.groupBy(*by).agg(
        F.sum("row").cast("double").alias("_n"),
        F.sum("hit").cast("double").alias("_hits"),
        F.sum(F.col("row").cast("double") * F.col("col")).alias("_cross"),
        F.sum(F.col("row").cast("double") * F.col("row")).alias("_rows2"),
        F.sum(F.col("col").cast("double") * F.col("col")).alias("_cols2"),
        F.avg(recall).alias("balanced_accuracy"),
        F.avg((recall + true_negative_rate) / 2).alias("roc_auc"),
        F.avg(F.coalesce(recall, F.lit(0.0))).alias("recall_macro"),
        F.avg(F.coalesce(precision, F.lit(0.0))).alias("precision_macro"),
    )
    n, hits, cross = F.col("_n"), F.col("_hits"), F.col("_cross")
    accuracy = hits / n
    chance = cross / (n * n)
    spread = F.sqrt((n * n - F.col("_cols2")) * (n * n - F.col("_rows2")))
    return sums.select(
        *by,
        accuracy.alias("accuracy"),
        "balanced_accuracy",
        F.try_divide(accuracy - chance, 1 - chance).alias("kappa"),
        accuracy.alias("f1_micro"),
        "recall_macro",
        "precision_macro",
        F.coalesce(F.try_divide(hits * n - cross, spread), F.lit(0.0)).alias("mcc"),
        # one class against the rest on hard labels, averaged over the classes present
        "roc_auc",
    )


SCORES = ["accuracy", "balanced_accuracy", "kappa", "f1_micro", "recall_macro", "precision_macro", "mcc", "roc_auc"]


def mean_scores(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over folds; undefined folds are left out."""
    return per_fold.groupBy(*by).agg(*[F.avg(s).alias(s) for s in SCORES])


def auc_rank(df: DataFrame, positive: str | Column, score: str) -> DataFrame:
    """Area under the curve by rank sums, ties counted half.

    Equal scores are counted first; the running number of negatives is taken
    slice by slice, so no task sees the whole ordering.
    """
    hit = F.col(positive) if isinstance(positive, str) else positive
    rows = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("_s"), hit.alias("_p"))
    counts = (
        add_slice(rows, "_s", slice_bounds(rows, "_s"))
        .groupBy("_slice", "_s")
        .agg(F.count_if("_p").alias("pos"), F.count_if(~F.col("_p")).alias("neg"))
    )
    ordered = running_before(counts, [], ["_slice"], [F.col("_s")], {"below": F.col("neg")})
    won = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ordered.agg(F.try_divide(won, pairs).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def histogram(
    df: DataFrame, value: str, bins: int, by: Sequence[str] = (), limits: tuple[float, float] | None = None
) -> DataFrame:
    """Equal-width bins between the limits; the last bin is closed.  Empty bins are left out."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    if limits:
        low, high = F.lit(float(limits[0])), F.lit(float(limits[1]))
        placed = rows
    elif by:
        ends = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        placed, low, high = rows.join(pin_small(ends)[0], by), F.col("_lo"), F.col("_hi")
    else:
        ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        low, high = ends.select("_lo").scalar(), ends.select("_hi").scalar()
        placed = rows
    width = (high - low) / bins
    at = F.when(high == low, 0).otherwise(
        F.least(F.floor(F.try_divide(F.col(value) - low, width)), F.lit(bins - 1))
    )
    return placed.groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def label_uncertainty(rounds: DataFrame, key: str = "id", pred: str = "pred", actual: str = "actual") -> DataFrame:
    """Most frequent prediction and percentage of matching predictions per row.

    Votes are counted per (row, label) first; ties go to the smallest label.
    """
    votes = (
        rounds.where(F.col(pred).isNotNull())
        .groupBy(key, pred)
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(pred) == F.col(actual)).alias("_match"))
    )
    return votes.groupBy(key).agg(
        F.min_by(pred, F.struct(-F.col("_n"), F.col(pred))).alias("modal_pred"),
        (F.sum("_match") / F.sum("_n") * 100).alias("matching_percentage"),
    )


def cluster_coassign(rows: DataFrame, label: str, cluster: str, seed: str) -> DataFrame:
    """How often, over the seeds, two classes have the same most frequent cluster."""
    counts = rows.groupBy(seed, label, cluster).agg(F.count(F.lit(1)).alias("_n"))
    modal = counts.groupBy(seed, label).agg(
        F.min_by(cluster, F.struct(-F.col("_n"), F.col(cluster))).alias("_c")
    )
    # one row per class and seed from here on
    a = modal.select(seed, "_c", F.col(label).alias("key_class"))
    b = modal.select(seed, "_c", F.col(label).alias("with_class"))
    return a.join(b, [seed, "_c"]).groupBy("key_class", "with_class").agg(F.count(F.lit(1)).alias("n"))


def attribution_reduce(
    tensor: DataFrame,
    hows: Sequence[str] = ("mean", "max"),
    row: str = "row",
    label: str = "class",
    feature: str = "feature",
    value: str = "shap",
) -> DataFrame:
    """Mean or max of |value| over runs, mean over classes, sum over rows, per feature.

    Both reductions come from one pass; columns are named ``<how>_importance``.
    """
    over_runs = {"mean": F.avg, "max": F.max}
    cells = tensor.groupBy(row, feature, label).agg(*[over_runs[h](F.abs(value)).alias(h) for h in hows])
    rows = cells.groupBy(row, feature).agg(*[F.avg(h).alias(h) for h in hows])
    return rows.groupBy(feature).agg(*[F.sum(h).alias(f"{h}_importance") for h in hows])


# Scores by name, each read from ``fold_scores``.
SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    name: (lambda per_fold, column=column: per_fold.agg(F.avg(column).alias("value")))
    for name, column in {
        "balanced_accuracy": "balanced_accuracy",
        "balanced": "balanced_accuracy",
        "kappa": "kappa",
        "roc_auc": "roc_auc",
        "matthews_corrcoef": "mcc",
    }.items()
}
