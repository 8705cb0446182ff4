"""Classifiers by name, out-of-sample scoring, search and per-pixel prediction."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.ml.boosting import Settings, SoftmaxBoosting
from fieldloom.ml.forests import ForestSettings, RandomForest, held_rounds
from fieldloom.ml.kernels import KernelMachine
from fieldloom.ml.prep import assemble, impute_mean, label_table, standardize
from fieldloom.operators.metrics import SCORERS, cluster_coassign, fold_scores, label_uncertainty, mean_scores
from fieldloom.operators.sampling import fold_rounds, group_folds
from fieldloom.operators.tables import CLASSIFIER_PREFIX, best_trial, trial_params
from fieldloom.session import reliable

MAX_TREE_DEPTH = 30  # the search ranges end here
#: Boosting parameters and their kinds.
_BOOSTING = {
    "n_estimators": int, "learning_rate": float, "num_leaves": int, "max_depth": int, "min_data_in_leaf": int,
    "reg_lambda": float, "bagging_fraction": float, "bagging_freq": int, "patience": int,
}


def classifier(
    name: str, params: Mapping, seed: int = 42, weight: str | None = None, rows: float | None = None, **columns
) -> Estimator:
    """An estimator from the workflow's parameter names.

    Boosting is softmax over all classes with best-first trees of any depth; the machine runs one class against
    the rest, on random features for the kernels rbf and poly. Its loss is averaged over the training rows, so its C
    needs their number (or sum of weights) ``rows``. Forests deeper than the library grows are refused.
    """
    common = {"featuresCol": columns.get("features", "features"), "labelCol": columns.get("label", "lc")}
    p = dict(params)
    if name == "RandomForest":
        depth = int(float(p.get("max_depth", 5)))
        if depth > MAX_TREE_DEPTH:
            raise ValueError(f"max_depth {depth} is above the library's limit of {MAX_TREE_DEPTH}")
        impurity = {"log_loss": "entropy"}.get(p.get("criterion", "gini"), p.get("criterion", "gini"))
        subset = str(p.get("max_features", "auto"))
        settings = ForestSettings(int(p.get("n_estimators", 100)), depth, int(p.get("min_samples_leaf", 1)), subset, impurity == "entropy", seed)
        return RandomForest(settings, weight, common["featuresCol"], common["labelCol"])
    if name == "LGBM":
        settings = Settings(
            **{k: kind(float(p[k])) for k, kind in _BOOSTING.items() if k in p}, **({"metrics": tuple(p["metrics"])} if "metrics" in p else {}), seed=seed
        )
        return SoftmaxBoosting(settings, common["featuresCol"], common["labelCol"], weight)
    if name == "SVC":
        if not rows:
            raise ValueError("the machine needs the number of its training rows")
        return KernelMachine(
            rows, float(p.get("C", 1.0)), p.get("kernel", "linear"), int(p.get("degree", 3)), p.get("gamma", "scale"), max_iter=int(p.get("max_iter", 20)),
            weight=weight, features=common["featuresCol"], label=common["labelCol"], seed=seed,
        )
    raise ValueError(f"unknown classifier {name}")


def training_table(
    df: DataFrame, key: str, label: str, columns: Sequence[str], extra: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(key, label, code, features, extra) and the table of codes."""
    from fieldloom.operators.scale import pin_small

    codes, _ = pin_small(label_table(df, label))
    coded = df.join(codes, label)
    rows = assemble(coded, columns).select(key, label, F.col("lc").cast("double").alias("lc"), "features", *extra)
    return rows, codes


def in_threads(jobs: Sequence[Callable], parallelism: int = 8) -> list:
    """Submit Spark jobs from a few driver threads; the work runs in tasks."""
    if len(jobs) == 1 or parallelism == 1:
        return [job() for job in jobs]
    inherit = inheritable_thread_target(SparkSession.getActiveSession())
    pool = ThreadPool(min(parallelism, len(jobs)))
    try:
        return pool.map(lambda run: run(), [inherit(j) for j in jobs])
    finally:
        pool.close()


def training_rows(rows: DataFrame, weight: str | None) -> float:
    """Number of training rows, or the sum of their weights."""
    return float(rows.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 0)


def held_out(rows: DataFrame, make: Callable[..., Estimator], folds: int, fold: str, keep: Sequence[str], parallelism: int = 8) -> DataFrame:
    """Predictions of each fold by a model fitted on the others; ``make`` gets the training rows."""

    def one(i: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            others = rows.where(F.col(fold) != i)
            model = make(others).fit(others)
            return model.transform(rows.where(F.col(fold) == i)).select(*keep, fold, "lc", "prediction")

        return run

    return reduce(DataFrame.unionByName, in_threads([one(i) for i in range(folds)], parallelism))


def oos_predictions(
    rows: DataFrame, make: Callable[[], Estimator], key: str, label: str, group: str, folds: int = 3, seed: int = 42
) -> DataFrame:
    """Held-out predictions over group-stratified folds."""
    folded = reliable(group_folds(rows, group, label, folds, seed))
    return held_out(folded, lambda _: make(), folds, "fold", [key])


def oos_scores(rows: DataFrame, make: Callable[[], Estimator], key: str, label: str, group: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """Scores averaged over the folds."""
    return mean_scores(fold_scores(oos_predictions(rows, make, key, label, group, folds, seed), "lc", "prediction"))


def uncertainty_rounds(
    rows: DataFrame, make: Callable[[], Estimator], key: str, label: str, rounds: int = 10, folds: int = 5, parallelism: int = 8
) -> DataFrame:
    """Each row predicted once per round, by one kind of model and other folds; modal prediction and share of matches."""
    return label_uncertainty(round_predictions(rows, make, key, label, rounds, folds, parallelism), key, "prediction", "lc")


def round_predictions(
    rows: DataFrame, make: Callable[[], Estimator], key: str, label: str, rounds: int = 10, folds: int = 5, parallelism: int = 8
) -> DataFrame:
    """(key, round, fold, prediction, lc) of every row and round.

    Forests of a table that a task can hold are grown and used a task each; other models, and larger tables, take a fit
    and a transform for each round and fold.
    """
    folded = reliable(fold_rounds(rows, label, key, folds, rounds))
    forest = make()
    if isinstance(forest, RandomForest) and forest.label == "lc":
        found = held_rounds(folded, forest, "folds", rounds, folds, [key, "lc"])
        if found is not None:
            return reliable(found.select(key, "round", "fold", "prediction", "lc"))

    def one(r: int, i: int) -> Callable[[], DataFrame]:
        fold = F.get("folds", F.lit(r))

        def run() -> DataFrame:
            model = make().fit(folded.where(fold != i))
            held = model.transform(folded.where(fold == i))
            return held.select(key, F.lit(r).alias("round"), F.lit(i).alias("fold"), "prediction", "lc")

        return run

    jobs = [one(r, i) for r in range(rounds) for i in range(folds)]
    return reliable(reduce(DataFrame.unionByName, in_threads(jobs, parallelism)))


def kmeans_coassign(
    df: DataFrame, label: str, columns: Sequence[str], seeds: Iterable[int] = range(30), parallelism: int = 8
) -> DataFrame:
    """Classes sharing their most frequent cluster, counted over the seeds."""
    scaled = standardize(impute_mean(df, columns), columns)
    rows = reliable(assemble(scaled, columns).select(label, "features"))
    k = df.select(label).distinct().count()

    def one(seed: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
            return model.transform(rows).select(label, "cluster", F.lit(seed).alias("seed"))

        return run

    assigned = reduce(DataFrame.unionByName, in_threads([one(s) for s in seeds], parallelism))
    return cluster_coassign(assigned, label, "cluster", "seed")


# --- search -------------------------------------------------------------------

# Search ranges of the workflow; fixed values.  The forest's depth ends at the library's limit,
# and its rows to split, which the library cannot use, are left out.
SEARCH_SPACE = {
    "RandomForest": {
        "max_depth": range(2, MAX_TREE_DEPTH + 1),
        "n_estimators": range(100, 1001, 100),
        "min_samples_leaf": range(1, 11),
        "max_features": ["auto", "sqrt"],
        "criterion": ["gini", "entropy", "log_loss"],
    },
    "LGBM": {
        "max_depth": range(10, 101),
        "learning_rate": (0.01, 0.1),
        "bagging_fraction": (0.1, 1.0),
        "bagging_freq": range(0, 11),
        "num_leaves": range(10, 101),
        "min_data_in_leaf": range(10, 201),
    },
    "SVC": {
        "c": ("log", 1e-10, 1e10),
        "kernel": ["linear", "rbf", "poly"],
        "degree": range(1, 6),
        "gamma": ["scale", "auto"],
    },
}


def draw_params(space: Mapping, rng: random.Random) -> dict:
    """One value per parameter: from a list, a uniform or a log-uniform range."""
    out = {}
    for name, choice in space.items():
        if isinstance(choice, tuple) and choice[0] == "log":
            out[name] = choice[1] * (choice[2] / choice[1]) ** rng.random()
        elif isinstance(choice, tuple):
            out[name] = rng.uniform(*choice)
        else:
            out[name] = rng.choice(list(choice))
    return out


def random_search(
    rows: DataFrame,
    key: str,
    label: str,
    group: str,
    n_trials: int = 100,
    classifiers: Sequence[str] = ("SVC", "RandomForest", "LGBM"),
    space: Mapping | None = None,
    scoring: str = "kappa",
    folds: int = 3,
    seed: int = 42,
    weight: str | None = None,
    parallelism: int = 8,
) -> DataFrame:
    """Trials (number, value, classifier, params); the value is the mean fold score."""
    space = space or SEARCH_SPACE
    rng = random.Random(seed)
    drawn = []
    for _ in range(n_trials):
        name = rng.choice(list(classifiers))
        drawn.append((name, draw_params(space[name], rng)))
    return run_trials(rows, key, label, group, drawn, scoring, folds, seed, weight, parallelism)


def grid_search(rows: DataFrame, key: str, label: str, group: str, name: str, grid: Mapping[str, Sequence], **options) -> DataFrame:
    """Trials for every combination of the listed values."""
    drawn = [(name, dict(zip(grid, values))) for values in itertools.product(*grid.values())]
    return run_trials(rows, key, label, group, drawn, **options)


def run_trials(
    rows: DataFrame,
    key: str,
    label: str,
    group: str,
    drawn: Sequence[tuple[str, Mapping]],
    scoring: str = "kappa",
    folds: int = 3,
    seed: int = 42,
    weight: str | None = None,
    parallelism: int = 8,
) -> DataFrame:
    """Mean fold score of each (classifier, parameters)."""
    if scoring not in SCORERS:
        raise ValueError(f"scoring must be one of {sorted(SCORERS)}")
    folded = reliable(group_folds(rows, group, label, folds, seed))

    def one(number: int, name: str, params: Mapping) -> Callable[[], tuple]:
        def run() -> tuple:
            named = {("C" if k == "c" else k): v for k, v in params.items()}
            out = held_out(folded, lambda others: classifier(name, named, seed, weight, training_rows(others, weight) if name == "SVC" else None), folds, "fold", [key], parallelism=1)
            value = SCORERS[scoring](fold_scores(out, "lc", "prediction")).first()[0]
            return number, value, name, {f"{CLASSIFIER_PREFIX[name]}_{k}": str(v) for k, v in params.items()}

        return run

    results = in_threads([one(i, *d) for i, d in enumerate(drawn)], parallelism)
    return rows.sparkSession.createDataFrame(
        results, "number int, value double, classifier string, params map<string,string>"
    )


def save_trials(trials: DataFrame, path: str, study: str) -> None:
    """Append a study's trials."""
    trials.withColumn("study", F.lit(study)).write.mode("append").partitionBy("study").parquet(path)


def load_trials(spark: SparkSession, path: str, study: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("study") == study).drop("study")


def best_classifier(
    trials: DataFrame, wanted: str | None = None, seed: int = 42, weight: str | None = None, rows: float | None = None
) -> Estimator:
    """The estimator of the best trial, overall or of one classifier."""
    pool = trials if wanted is None else trials.where(F.col("classifier") == wanted)
    row = trial_params(best_trial(pool, "value", "number")).first()
    return classifier(row["classifier"], row["params"], seed, weight, rows)


# --- maps ---------------------------------------------------------------------


def predict_pixels(model: Model, pixels: DataFrame, cell: Sequence[str], columns: Sequence[str], codes: DataFrame, label: str) -> DataFrame:
    """Class of every pixel; cells with a missing feature get no class."""
    whole = pixels.na.drop(subset=list(columns))
    predicted = model.transform(assemble(whole, columns)).select(*cell, F.col("prediction").cast("int").alias("lc"))
    return predicted.join(codes, "lc", "left").select(*cell, "lc", label)


def apply_blocks(df: DataFrame, function: Callable[..., pd.DataFrame], schema: str, *args) -> DataFrame:
    """Run a block function over pixel rows, batch by batch."""

    def run(frames):
        for frame in frames:
            if len(frame):
                yield function(frame, *args)

    return df.mapInPandas(run, schema)
