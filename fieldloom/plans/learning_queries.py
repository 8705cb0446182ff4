"""Preparation, models, scoring, search and attribution over the feature vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.series import DEFAULT_FEATURES, feature_name
from fieldloom.ml import attribution as A
from fieldloom.ml import models as L
from fieldloom.ml import outliers as O
from fieldloom.ml import prep as P
from fieldloom.ml.boosting import Job, Settings, fit_models, margins
from fieldloom.operators import series as S
from fieldloom.operators.sampling import group_folds
from fieldloom.plans import views as V
from fieldloom.plans.registry import Tables, cte, half_up_sql, query
from fieldloom.session import new_folder, reliable

COLUMNS = V.FEATURES
cte(
    "v_wide",
    "SELECT id, lc_name, field_id, Field_size, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(COLUMNS))
    + " FROM v_feat",
)


@query(
    "standardize",
    "SELECT id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in COLUMNS) + " FROM v_wide",
)
def standardize(t: Tables) -> DataFrame:
    return P.standardize(V.features(t, wide=True), COLUMNS).select("id", *COLUMNS)


_SPREAD = [f"{c} * {5 + i % 7}" for i, c in enumerate(COLUMNS)]


@query(
    "variance_select",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature FROM v_wide HAVING var_pop({s}) > 0.5" for c, s in zip(COLUMNS, _SPREAD)
    ),
)
def variance_select(t: Tables) -> DataFrame:
    wide = V.features(t, wide=True).select(
        *[(F.col(c) * (5 + i % 7)).alias(c) for i, c in enumerate(COLUMNS)]
    )
    return t.spark.createDataFrame([(c,) for c in P.variance_select(wide, COLUMNS)], "feature string")


_GAPS = {c: f"CASE WHEN id % {i + 2} <> 0 THEN {c} END" for i, c in enumerate(COLUMNS)}


@query(
    "impute_mean",
    "SELECT id, " + ", ".join(f"round(coalesce({g}, avg({g}) OVER ()), 6) AS {c}" for c, g in _GAPS.items()) + " FROM v_wide",
)
def impute_mean(t: Tables) -> DataFrame:
    wide = V.features(t, wide=True).select(
        "id", *[F.when(F.col("id") % (i + 2) != 0, F.col(c)).alias(c) for i, c in enumerate(COLUMNS)]
    )
    return P.impute_mean(wide, COLUMNS)


@query(
    "label_encode",
    "SELECT id, lc_name, CAST(dense_rank() OVER (ORDER BY lc_name) - 1 AS INTEGER) AS lc FROM v_feat",
)
def label_encode(t: Tables) -> DataFrame:
    return P.label_encode(V.features(t).select("id", "lc_name"), "lc_name")


@query(
    "label_names",
    "SELECT DISTINCT lc_name, CAST(dense_rank() OVER (ORDER BY lc_name) - 1 AS INTEGER) AS lc FROM v_feat",
)
def label_names(t: Tables) -> DataFrame:
    return P.label_table(V.features(t), "lc_name")


@query(
    "correlation_pairs",
    """SELECT 'f' || lpad(CAST(p.i AS VARCHAR), 2, '0') AS a, 'f' || lpad(CAST(q.i AS VARCHAR), 2, '0') AS b,
         round(corr(p.v, q.v), 6) AS corr
       FROM (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) p
       JOIN (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) q
         ON p.vec_id = q.vec_id AND p.i < q.i GROUP BY p.i, q.i""",
)
def correlation_pairs(t: Tables) -> DataFrame:
    return P.correlation_pairs(V.features(t, wide=True), COLUMNS)


_LIMIT = 0.05


@query(
    "collinear_columns",
    f"""SELECT DISTINCT 'f' || lpad(CAST(q.i AS VARCHAR), 2, '0') AS dropped
        FROM (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) p
        JOIN (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) q
          ON p.vec_id = q.vec_id AND p.i < q.i GROUP BY p.i, q.i HAVING abs(corr(p.v, q.v)) >= {_LIMIT}""",
)
def collinear_columns(t: Tables) -> DataFrame:
    pairs = P.correlation_pairs(V.features(t, wide=True), COLUMNS)
    return t.spark.createDataFrame([(c,) for c in P.collinear_columns(pairs, COLUMNS, _LIMIT)], "dropped string")


@query("pca_project")
def pca_project(t: Tables) -> DataFrame:
    return P.pca_project(V.features(t, wide=True), COLUMNS).select("id", "lc_name", "pc1", "pc2")


_LANGS, _MARKS = ["de", "en", "es", "fr"], ["D", "L", "OK", "missing"]


@query(
    "mixed_table",
    "SELECT id, CAST(coalesce(nullif(n_chars, 100), avg(nullif(n_chars, 100)) OVER ()) AS DOUBLE) AS n_chars, "
    + ", ".join(f"CASE WHEN primar = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS primar_{v}" for v in _LANGS)
    + ", "
    + ", ".join(f"CASE WHEN coalesce(Quality, 'missing') = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS quality_{v}" for v in _MARKS)
    + " FROM v_obs",
)
def mixed_table(t: Tables) -> DataFrame:
    rows = V.observations(t).withColumn("n_chars", F.nullif(F.col("n_chars"), F.lit(100)).cast("double"))
    parts = vector_to_array("features")
    out = P.mixed_table(rows, ["n_chars"], ["primar", "Quality"]).select("id", parts.alias("v"))
    # a last, empty place of each category is kept for values unseen in the fit
    names = ["n_chars", *[f"primar_{v}" for v in _LANGS], None, *[f"quality_{v}" for v in _MARKS]]
    return out.select("id", *[F.col("v")[i].alias(n) for i, n in enumerate(names) if n])


# --- models -------------------------------------------------------------------

TREES = {"n_estimators": 100, "max_depth": L.MAX_TREE_DEPTH}


def _rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    return L.training_table(V.features(t, wide=True), "id", "lc_name", COLUMNS, ["field_id", "Field_size"])


def _forest(weight: str | None = "Field_size"):
    return L.classifier("RandomForest", TREES, 42, weight)


def _fit_predict(t: Tables, name: str, params: dict) -> DataFrame:
    rows, codes = _rows(t)
    model = L.classifier(name, params, weight="Field_size", rows=L.training_rows(rows, "Field_size")).fit(rows)
    predicted = model.transform(rows).select("id", "lc_name", F.col("prediction").cast("int").alias("lc"))
    return predicted.join(codes.withColumnRenamed("lc_name", "pred"), "lc", "left").select("id", "lc_name", "pred")


@query("rf_predict")
def rf_predict(t: Tables) -> DataFrame:
    return _fit_predict(t, "RandomForest", TREES)


@query("gbt_predict")
def gbt_predict(t: Tables) -> DataFrame:
    return _fit_predict(t, "LGBM", {})


@query("svc_predict")
def svc_predict(t: Tables) -> DataFrame:
    return _fit_predict(t, "SVC", {"C": 1.0})


@query("kernel_predict")
def kernel_predict(t: Tables) -> DataFrame:
    return _fit_predict(t, "SVC", {"C": 1.0, "kernel": "rbf"})


@query("oos_scores")
def oos_scores(t: Tables) -> DataFrame:
    rows, _ = _rows(t)
    return L.oos_scores(rows, _forest, "id", "lc_name", "field_id")


@query("kmeans_coassign")
def kmeans_coassign(t: Tables) -> DataFrame:
    return L.kmeans_coassign(V.features(t, wide=True), "lc_name", COLUMNS)


@query("uncertainty_rounds")
def uncertainty_rounds(t: Tables) -> DataFrame:
    """Modal class by name and share of matches of every row, at its point."""
    rows, codes = _rows(t)
    votes = L.uncertainty_rounds(rows, lambda: _forest(None), "id", "lc_name")
    named = votes.withColumn("lc", F.col("modal_pred").cast("int")).join(codes.withColumnRenamed("lc_name", "pred"), "lc", "left")
    places = V.points(t).select("id", "x", "y")
    return named.select("id", F.col("pred").alias("modal_pred"), "matching_percentage").join(places, "id", "left")


@query("uncertainty_votes", "SELECT id, 10 AS rounds, 10 AS votes FROM v_feat")
def uncertainty_votes(t: Tables) -> DataFrame:
    """Every row is predicted once in each of the ten rounds."""
    rows, _ = _rows(t)
    small = lambda: L.classifier("RandomForest", {"n_estimators": 5})  # noqa: E731 - the counts do not depend on the model
    votes = L.round_predictions(rows, small, "id", "lc_name")
    return votes.groupBy("id").agg(F.countDistinct("round").cast("int").alias("rounds"), F.count("prediction").cast("int").alias("votes"))


@query("oos_rows", "SELECT id, 1 AS folds, 1 AS predictions FROM v_feat")
def oos_rows(t: Tables) -> DataFrame:
    """Every row is predicted by the one model that did not see its group."""
    rows, _ = _rows(t)
    held = L.oos_predictions(rows, lambda: L.classifier("RandomForest", {"n_estimators": 5}), "id", "lc_name", "field_id")
    return held.groupBy("id").agg(F.countDistinct("fold").cast("int").alias("folds"), F.count("prediction").cast("int").alias("predictions"))


@query("isolation_outliers")
def isolation_outliers(t: Tables) -> DataFrame:
    rows = V.features(t).select("id", "lc_name", F.col("embedding").cast("array<double>").alias("features"))
    return O.isolation_outliers(rows, "id", "lc_name")


@query("outlier_stage")
def outlier_stage(t: Tables) -> DataFrame:
    """The stage learns on the even ids, is saved and loaded, and judges all rows."""
    rows = V.features(t).select("id", "lc_name", F.col("embedding").cast("array<double>").alias("features"))
    folder = new_folder(rows.sparkSession, "outlier-stage")
    O.OutlierRemover("id", "lc_name").fit(rows.where("id % 2 = 0")).save(folder)
    return O.OutlierRemoverModel.load(folder).flagged(rows)


SPACE = {
    "RandomForest": {"max_depth": range(2, 8), "n_estimators": range(5, 21, 5), "criterion": ["gini", "entropy"]},
    "LGBM": {"max_depth": range(2, 4), "learning_rate": (0.01, 0.1), "n_estimators": [2]},
    "SVC": {"c": ("log", 1e-2, 1e2), "max_iter": [3]},
}


@query("random_search")
def random_search(t: Tables) -> DataFrame:
    rows, _ = _rows(t)
    trials = L.random_search(rows, "id", "lc_name", "field_id", n_trials=4, space=SPACE, weight="Field_size")
    return trials.select("number", "value", "classifier", F.to_json("params").alias("params"))


GRID = {"max_depth": [4, 8], "n_estimators": [10, 20], "criterion": ["gini"]}


@query("grid_search")
def grid_search(t: Tables) -> DataFrame:
    """All combinations of the grid, over group-stratified folds."""
    rows, _ = _rows(t)
    trials = L.grid_search(rows, "id", "lc_name", "field_id", "RandomForest", GRID, weight="Field_size")
    return trials.select("number", "value", "classifier", F.to_json("params").alias("params"))


@query("best_estimator")
def best_estimator(t: Tables) -> DataFrame:
    """Trials saved and read back; the best one's classifier fitted on all rows, its prediction of each."""
    rows, _ = _rows(t)
    folder = new_folder(rows.sparkSession, "trials")
    grid = {"max_depth": [4, 8], "n_estimators": [10]}
    L.save_trials(L.grid_search(rows, "id", "lc_name", "field_id", "RandomForest", grid, weight="Field_size"), folder, "forest")
    best = L.best_classifier(L.load_trials(rows.sparkSession, folder, "forest"), "RandomForest", weight="Field_size")
    return best.fit(rows).transform(rows).select("id", "lc", F.col("prediction").cast("int").alias("prediction"))


@query("tree_attribution")
def tree_attribution(t: Tables) -> DataFrame:
    rows, _ = _rows(t)
    folded = reliable(group_folds(rows, "field_id", "lc_name", 3))
    models = [_forest().fit(folded.where(F.col("fold") != i)) for i in range(3)]
    return A.attribution_importance(models, rows, COLUMNS)


#: The workflow's: rounds at most, rounds without a better held-out metric, both metrics.
EARLY = {"n_estimators": 10_000, "patience": 200, "metrics": ("multi_error", "multi_logloss")}


@query("margin_attribution")
def margin_attribution(t: Tables) -> DataFrame:
    """Importance of the features for the margins of boosted models: three folds, two metrics that end them."""
    rows, _ = _rows(t)
    folded = reliable(group_folds(rows, "field_id", "lc_name", 3))
    models = A.boosted_folds(folded, 3, "fold", Settings(**EARLY), features="features", draw=F.col("id"))
    return A.margin_importance(models, folded, COLUMNS)


@query("margin_parts", "SELECT id, 10 AS classes, true AS adds_up FROM v_feat")
def margin_parts(t: Tables) -> DataFrame:
    """The parts of every row and class add up to the model's margin."""
    rows, _ = _rows(t)
    rows = reliable(rows.select("id", "lc", "features"))
    model = fit_models(rows, [Job(Settings(n_estimators=3))], "features", draw=F.col("id"))[0]
    summed = A.margin_attribution([model], rows, "id").groupBy("id", "class").agg(F.sum("shap").alias("total"))
    known = rows.select("id", F.posexplode(margins(t.spark, model, vector_to_array("features"))).alias("class", "margin"))
    both = known.join(summed, ["id", "class"], "left")
    close = F.coalesce(F.abs(F.col("total") - F.col("margin")) < 1e-9, F.lit(False))
    return both.groupBy("id").agg(F.count("*").cast("int").alias("classes"), F.min(close).alias("adds_up"))


@query("predict_pixels")
def predict_pixels(t: Tables) -> DataFrame:
    names = [feature_name(f, p) for f, p in DEFAULT_FEATURES]
    stats = S.series_features(V.full(t), V.SERIES, "slot", "value")
    # the feature table is written once; the fit and the prediction both read it
    wide = reliable(S.band_pivot(stats, V.CELL, "band", V.BANDS, names))
    columns = [f"{b}_{n}" for b in V.BANDS for n in names]
    labels = V.points(t).select(F.col("id").alias("cell"), "lc_name")
    whole = wide.na.drop(subset=columns)
    rows, codes = L.training_table(whole.join(labels, "cell"), "cell", "lc_name", columns)
    model = L.classifier("RandomForest", TREES).fit(rows)
    return L.predict_pixels(model, wide, V.CELL, columns, codes, "lc_name")


@query("block_function", f'SELECT "row", col, {half_up_sql("value * 10")} AS value FROM v_px', slack=True)
def block_function(t: Tables) -> DataFrame:
    def times(frame, factor):
        return frame.assign(value=frame["value"] * factor)

    return L.apply_blocks(V.pixels(t), times, "row int, col int, value double", 10.0)
