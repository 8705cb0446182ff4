"""Folds, outliers, attribution and search by their invariants."""

import itertools

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fieldloom.ml import attribution as A
from fieldloom.ml import forests, kernels
from fieldloom.ml import models as L
from fieldloom.ml import outliers as O
from fieldloom.ml import prep
from fieldloom.operators import metrics as M
from fieldloom.operators import sampling as P
from fieldloom.operators import tables as T


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(360):
        c = ["a", "b", "c"][0 if i % 2 else 1 + (i // 2) % 2]
        shift = {"a": 0.0, "b": 2.0, "c": -2.0}[c]
        data.append((i, c, i % 36, float(5 + i % 3), *[float(v) for v in rng.normal(shift, 1.0, 4)]))
    return spark.createDataFrame(data, "id bigint, lc_name string, grp bigint, w double, f0 double, f1 double, f2 double, f3 double").cache()


COLUMNS = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def training(rows):
    return L.training_table(rows, "id", "lc_name", COLUMNS, ["grp", "w"])


def test_stratified_folds(rows):
    out = P.stratified_folds(rows, "lc_name", "id", 5, seed=2)
    counts = out.groupBy("lc_name", "fold").count().collect()
    for c in "abc":
        sizes = [r["count"] for r in counts if r["lc_name"] == c]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert out.count() == rows.count()


def test_group_folds(rows):
    out = P.group_folds(rows, "grp", "lc_name", 3)
    assert out.count() == rows.count()
    assert out.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    shares = out.groupBy("fold").agg(F.avg((F.col("lc_name") == "a").cast("int")).alias("s")).collect()
    assert all(abs(r["s"] - 0.5) < 0.2 for r in shares) and len(shares) == 3


def test_scores_and_rounds(training):
    table, codes = training
    make = lambda: L.classifier("RandomForest", {"n_estimators": 5, "max_depth": 3}, weight="w")
    one = L.oos_scores(table, make, "id", "lc_name", "grp").first()
    assert one["kappa"] > 0.8 and one["accuracy"] == one["f1_micro"]
    out = L.uncertainty_rounds(
        table, lambda: L.classifier("RandomForest", {"n_estimators": 3, "max_depth": 3}), "id", "lc_name", rounds=2, folds=3
    )
    assert out.count() == 360
    assert {r[0] for r in out.select("matching_percentage").distinct().collect()} <= {0.0, 50.0, 100.0}


@pytest.mark.parametrize("few", [16_384, 40])
@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_forest_grows_to_the_end(training, monkeypatch, few, criterion):
    """Nodes that are summed and nodes that are grown from their rows give trees of the same kind, whole and consistent."""
    table, _ = training
    monkeypatch.setattr(forests, "FEW", few)
    model = L.classifier("RandomForest", {"n_estimators": 6, "max_depth": 30, "criterion": criterion}, weight="w").fit(table)
    out = model.transform(table).select("id", "lc", "prediction", vector_to_array("probability").alias("p")).collect()
    assert len(out) == 360 and sum(r.lc == r.prediction for r in out) > 340
    assert all(sum(r.p) == pytest.approx(1) and r.p[int(r.prediction)] == max(r.p) for r in out)
    trees = {}
    for r in model.node_table().collect():
        assert r.id not in trees.setdefault(r.tree, {})
        trees[r.tree][r.id] = r
    assert len(trees) == 6 and any(t.feature[0] >= 0 for t in model.tops) == (few == 40)
    for nodes in trees.values():
        below = {0}
        ends = [sum(v > 0 for v in r.stats) for r in nodes.values() if r.left < 0]
        assert ends.count(1) > 0.7 * len(ends)
        for r in nodes.values():
            if r.left >= 0:
                below |= {r.left, r.right}
                assert [a + b for a, b in zip(nodes[r.left].stats, nodes[r.right].stats)] == pytest.approx(r.stats)
        assert below == set(nodes)


@pytest.mark.parametrize("least", (1, 3))
def test_cuts_by_cells_and_by_sorted_rows_are_the_same(monkeypatch, least):
    """Sums of cells, running sums of sorted rows and columns of classes find the same cuts; broken weights take the last."""
    rng = np.random.default_rng(2)
    bins, label = rng.integers(0, 20, (700, 6)).astype(np.uint8), rng.integers(0, 4, 700)
    count, s = rng.integers(1, 4, 700).astype(np.uint8), forests.ForestSettings(depth=30, least=least)
    found = []
    for cells, weight in ((0, 4.0), (8, 4.0), (1 << 20, 4.0), (8, 4.0 / 3)):
        monkeypatch.setattr(forests, "CELLS", cells)
        found.append(forests.grow(bins, label, count, np.full(700, weight), 4, s, 0, (0, 0)))
    for tree in found[1:3]:
        assert all(np.array_equal(getattr(tree, k), getattr(found[0], k)) for k in ("feature", "bin", "left", "right", "stats"))
    assert found[3].feature[0] == found[0].feature[0] and found[3].bin[0] == found[0].bin[0]
    assert len(found[0].feature) > 100


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_forests_of_folds_meet_the_table_without_a_shuffle(spark, training, monkeypatch, criterion):
    """A fit and a transform a fold stored and shuffled every tree; a product with the table gives the same predictions."""
    table, _ = training
    odd = table.withColumn("w", F.when(F.col("id") % 7 > 0, F.col("w"))).withColumn("lc", F.when(F.col("id") % 11 > 0, F.col("lc")))
    make = lambda: L.classifier("RandomForest", {"n_estimators": 4, "max_depth": 30, "criterion": criterion}, weight="w")
    made = []
    monkeypatch.setattr(L, "held_rounds", lambda *a: made.append(forests.held_rounds(*a)) or made[-1])
    few = L.round_predictions(odd, make, "id", "lc_name", 2, 3).collect()
    assert made[0] is not None
    monkeypatch.setattr(forests, "WHOLE", 0)
    each = L.round_predictions(odd, make, "id", "lc_name", 2, 3).collect()
    assert made[1] is None and len(few) == 720 and set(map(tuple, few)) == set(map(tuple, each))


def test_grown_root_split_is_the_best():
    rng = np.random.default_rng(1)
    bins, label = rng.integers(0, 9, (200, 3)).astype(np.uint8), rng.integers(0, 3, 200)
    count, weight = rng.integers(1, 3, 200).astype(np.uint8), rng.random(200)
    s = forests.ForestSettings(depth=1, least=4, subset="all")
    tree = forests.grow(bins, label, count, weight, 3, s, 0, (0, 0))

    def impurity(rows):
        mass = np.bincount(label[rows], (count * weight)[rows], 3)
        return mass.sum() - (mass**2).sum() / mass.sum()

    sides = [(bins[:, f] <= b, f, b) for f in range(3) for b in range(8)]
    fits = [(impurity(m) + impurity(~m), f, b) for m, f, b in sides if min(count[m].sum(), count[~m].sum()) >= 4]
    assert (tree.feature[0], tree.bin[0]) == min(fits)[1:] and len(tree.feature) == 3


def test_kernel_features_are_made_in_slices(spark, monkeypatch):
    """A task never holds the mapped rows of a whole batch; the features are those of one pass."""
    made = kernels.fourier_features(np.arange(30.0).reshape(10, 3) / 10, 0.5, 16, 1)
    monkeypatch.setattr(kernels, "SLICE", 4)
    parts = list(kernels.mapped_slices(np.arange(30.0).reshape(10, 3) / 10, "rbf", 0.5, 2, 16, 1))
    assert [len(p) for p in parts] == [4, 4, 2] and np.allclose(np.concatenate(parts), made)
    rows = spark.createDataFrame([(i, [float(i), 1.0, 0.5]) for i in range(50)], "id int, x array<double>").coalesce(1)
    out = rows.select("id", kernels.kernel_features(F.col("x"), "rbf", 0.5, 2, 16, 1).alias("k")).orderBy("id").collect()
    assert np.allclose([r.k for r in out], kernels.fourier_features(np.array([[i, 1.0, 0.5] for i in range(50)]), 0.5, 16, 1))


def test_uncertain_rows_predicted_once_per_round(training):
    table, _ = training
    folded = P.stratified_folds(table, "lc_name", "id", 3, seed=1)
    held = L.held_out(folded, lambda _: L.classifier("RandomForest", {"n_estimators": 2}), 3, "fold", ["id"])
    assert held.count() == held.select("id").distinct().count() == 360


@pytest.mark.parametrize("trees,sample", [(10, 256), (4, 16)])
def test_outlier_share(rows, trees, sample):
    """One sampling rule for classes that are small or large against the trees' samples."""
    df = rows.select("id", "lc_name", F.array(*COLUMNS).alias("features"))
    out = O.isolation_outliers(df, "id", "lc_name", trees=trees, sample=sample)
    assert out.count() == 360
    for r in out.groupBy("lc_name").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("k")).collect():
        # few small trees give tied scores, and only rows above the cut are flagged
        assert r["k"] <= 0.05 * r["n"] + 1.0
        if trees * sample > r["n"]:
            assert r["k"] >= 0.05 * r["n"] - 1.0
    sizes = O.bounded_samples(df, "id", "lc_name", trees, sample, 0).groupBy("lc_name", "tree").count().collect()
    assert max(r["count"] for r in sizes) <= sample


def test_outlier_scores_find_a_far_row(spark):
    rng = np.random.default_rng(0)
    data = [(i, "a", [float(v) for v in rng.normal(0, 1, 3)]) for i in range(200)] + [(999, "a", [30.0, 30.0, 30.0])]
    df = spark.createDataFrame(data, "id bigint, lc_name string, features array<double>")
    top = O.isolation_outliers(df, "id", "lc_name", trees=30).orderBy(F.desc("score")).first()
    assert top["id"] == 999 and top["is_outlier"]
    left = O.OutlierRemover("id", "lc_name", trees=30).fit(df).transform(df)
    assert left.where("id = 999").count() == 0
    assert 189 <= left.count() <= 192


def test_outlier_stage_is_saved(rows, tmp_path, monkeypatch):
    """Saved and loaded, alone and in a pipeline, the stage judges new rows the same; more blocks change no score."""
    df = rows.select("id", "lc_name", F.array(*COLUMNS).alias("features"))
    stage = O.OutlierRemover("id", "lc_name", trees=12)
    stage.write().overwrite().save(str(tmp_path / "stage"))
    assert O.OutlierRemover.load(str(tmp_path / "stage")).settings == stage.settings
    made = Pipeline(stages=[stage]).fit(df)
    made.write().overwrite().save(str(tmp_path / "made"))
    model, read = made.stages[0], PipelineModel.load(str(tmp_path / "made")).stages[0]
    far = df.sparkSession.createDataFrame([(1000, "a", [40.0] * 4), (1001, "zz", [40.0] * 4), (1002, None, [0.0] * 4)], df.schema)
    new = df.union(far)
    want = {r["id"]: r for r in model.flagged(new).collect()}
    monkeypatch.setattr(O, "BLOCK_ROWS", 50)
    got = {r["id"]: r for r in read.flagged(new).collect()}
    assert got == want and len(got) == 363
    assert got[1000]["is_outlier"] and got[1001]["score"] is None and not got[1001]["is_outlier"] and not got[1002]["is_outlier"]
    whole = {r["id"]: (r["score"], r["is_outlier"]) for r in O.isolation_outliers(df, "id", "lc_name", trees=12).collect()}
    assert {k: (r["score"], r["is_outlier"]) for k, r in got.items() if k < 1000} == whole
    kept = {r["id"] for r in read.transform(new).collect()}
    assert kept == {k for k, r in got.items() if not r["is_outlier"]}


def test_many_classes_in_one_job(spark):
    """Classes beyond any pass size: one plan, the features scanned once."""
    df = spark.range(400).selectExpr("id", "concat('c', id % 80) as lc_name", "array(double(id % 7), double(id % 11)) as features")
    out = O.isolation_outliers(df, "id", "lc_name", trees=3, sample=8)
    assert out.where("score is not null").select("lc_name").distinct().count() == 80


@pytest.mark.parametrize("shares", [[0.4], [0.3, 0.6, 0.9], [0.01, 0.5, 0.99, 0.2, 0.7, 0.1]])
def test_factors_against_all_orders(shares):
    d = len(shares)
    patterns = np.array(list(itertools.product([False, True], repeat=d)))
    factors = A.pattern_factors(np.array(shares), patterns)
    orders = list(itertools.permutations(range(d)))
    for met, got in list(zip(patterns, factors))[:: max(1, len(patterns) // 8)]:

        def worth(held):
            out = 1.0
            for k in range(d):
                out *= met[k] if k in held else shares[k]
            return out

        for j in range(d):
            want = np.mean([worth(set(o[: o.index(j) + 1])) - worth(set(o[: o.index(j)])) for o in orders])
            assert got[j] == pytest.approx(want)


def test_attribution_adds_up(training):
    table, _ = training
    model = L.classifier("RandomForest", {"n_estimators": 4, "max_depth": 4}).fit(table)
    long = A.tree_attribution([model], table, "id")
    total = long.groupBy("id", "class").agg(F.sum("shap").alias("s"))
    prob = model.transform(table).select("id", F.posexplode(vector_to_array("probability")).alias("class", "p"))
    gap = total.join(prob, ["id", "class"]).withColumn("base", F.col("p") - F.col("s"))
    for r in gap.groupBy("class").agg(F.min("base").alias("a"), F.max("base").alias("b")).collect():
        assert r["a"] == pytest.approx(r["b"], abs=1e-9)


def test_importance_equals_the_long_reduction(training):
    table, _ = training
    folded = P.group_folds(table, "grp", "lc_name", 2).cache()
    models = [L.classifier("RandomForest", {"n_estimators": 3, "max_depth": 3}).fit(folded.where(F.col("fold") != i)) for i in range(2)]
    short = {r["feature"]: r for r in A.attribution_importance(models, table, COLUMNS).collect()}
    long = A.tree_attribution(models, table, "id").cache()
    for r in M.attribution_reduce(long, row="id").collect():
        for how in ("mean_importance", "max_importance"):
            assert short[COLUMNS[r["feature"]]][how] == pytest.approx(r[how])


@pytest.mark.parametrize("few", [16_384, 40])
def test_importance_without_a_shuffle_of_parts(training, monkeypatch, few):
    """The parts of every group of trees and block of rows went to disk; where they are many, a task now sums them up."""
    table, _ = training
    monkeypatch.setattr(forests, "FEW", few)  # 40: nodes of many rows stand above the subtrees
    models = [L.classifier("RandomForest", {"n_estimators": 4, "max_depth": 30, "max_features": "all"}, seed, "w").fit(table) for seed in (1, 2)]
    known = {r["feature"]: r for r in A.attribution_importance(models, table, COLUMNS).collect()}
    monkeypatch.setattr(A, "PARTS_BYTES", 0)
    monkeypatch.setattr(A, "BLOCK", 37)
    monkeypatch.setattr(A, "_cells", None)  # nothing is shuffled by it
    found = A.attribution_importance(models, table.union(table.limit(0)), COLUMNS).collect()
    assert {r["feature"] for r in found} == set(COLUMNS)
    for r in found:
        for how in ("mean_importance", "max_importance"):
            assert r[how] == pytest.approx(known[r["feature"]][how], rel=1e-9)


def test_attribution_of_more_nodes_than_a_task_holds(training, monkeypatch):
    table, _ = training
    models = [L.classifier("RandomForest", {"n_estimators": 5, "max_depth": d}).fit(table) for d in (6, 3)]
    whole = {(r["run"], r["id"], r["class"], r["feature"]): r["shap"] for r in A.tree_attribution(models, table, "id").collect()}
    monkeypatch.setattr(A, "MAX_NODES", 20, raising=False)
    monkeypatch.setattr(A, "GROUP_NODES", 20, raising=False)
    monkeypatch.setattr(A, "BLOCK", 64, raising=False)
    parts = {(r["run"], r["id"], r["class"], r["feature"]): r["shap"] for r in A.tree_attribution(models, table, "id").collect()}
    assert len(whole) == 2 * 360 * 3 * 4 and set(parts) == set(whole)
    assert all(parts[k] == pytest.approx(v, abs=1e-9) for k, v in whole.items())


def test_factors_of_long_paths():
    """A path of 18 features against the product that leaves out one feature at a time."""
    rng = np.random.default_rng(4)
    shares, met = rng.uniform(0.01, 0.99, 18), rng.random((18, 50)) < 0.5
    at, weight = A.quadrature(17)
    terms = at[:, None, None] * met + (1 - at)[:, None, None] * shares[:, None]
    want = np.stack([np.einsum("q,qn->n", weight, np.delete(terms, j, 1).prod(1)) * (met[j] - shares[j]) for j in range(18)])
    assert np.abs(A.path_factors(shares, met) / want - 1).max() < 1e-9


def test_parts_of_a_forest_are_summed_as_arrays(training, monkeypatch):
    """Rows are told apart by class and feature only after the parts of all groups of trees were added up."""
    table, _ = training
    monkeypatch.setattr(A, "GROUP_NODES", 20)
    monkeypatch.setattr(A, "SLICE", 16)
    model = L.classifier("RandomForest", {"n_estimators": 4, "max_depth": 4}).fit(table)
    out = A.tree_attribution([model], table, "id")
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == out.select("id", "class", "feature").distinct().count() == 360 * 3 * 4


def test_search_and_best(training, tmp_path, spark):
    table, _ = training
    space = {"RandomForest": {"max_depth": range(2, 5), "n_estimators": [3], "criterion": ["gini"]}}
    trials = L.random_search(table, "id", "lc_name", "grp", 2, ["RandomForest"], space, parallelism=2)
    L.save_trials(trials, str(tmp_path / "t"), "first")
    L.save_trials(trials, str(tmp_path / "t"), "second")
    back = L.load_trials(spark, str(tmp_path / "t"), "first")
    assert back.count() == 2
    best = L.best_classifier(back)
    top = max(trials.collect(), key=lambda r: (r["value"], -r["number"]))
    assert best.getMaxDepth() == int(top["params"]["rf_max_depth"])
    grid = L.grid_search(table, "id", "lc_name", "grp", "RandomForest", {"max_depth": [2, 3], "n_estimators": [2]})
    assert grid.count() == 2
    with pytest.raises(ValueError):
        L.run_trials(table, "id", "lc_name", "grp", [], scoring="nonsense")


def test_other_classifiers(training):
    table, codes = training
    for name, params in (("LGBM", {"n_estimators": 20, "max_depth": 2}), ("SVC", {"C": 1.0, "max_iter": 3})):
        model = L.classifier(name, params, weight="w", rows=L.training_rows(table, "w")).fit(table)
        hits = model.transform(table).where(F.col("prediction") == F.col("lc")).count()
        assert hits > 250, name
    with pytest.raises(ValueError):
        L.classifier("other", {})
    with pytest.raises(ValueError):
        L.classifier("RandomForest", {"max_depth": L.MAX_TREE_DEPTH + 1})


def test_kmeans_counts(rows):
    out = L.kmeans_coassign(rows, "lc_name", COLUMNS, seeds=range(2))
    own = {r["key_class"]: r["n"] for r in out.collect() if r["key_class"] == r["with_class"]}
    assert own == {"a": 2, "b": 2, "c": 2}


def test_prep(spark, rows):
    scaled = prep.standardize(rows.withColumn("f3", F.lit(4.0)), COLUMNS)
    r = scaled.agg(F.avg("f0"), F.stddev_pop("f0"), F.max("f3")).first()
    assert r[0] == pytest.approx(0, abs=1e-9) and r[1] == pytest.approx(1) and r[2] == 0.0
    assert prep.variance_select(scaled, COLUMNS) == ["f0", "f1", "f2"]
    pairs = prep.correlation_pairs(rows.withColumn("f4", F.col("f0") * 2), [*COLUMNS, "f4"])
    assert prep.collinear_columns(pairs, [*COLUMNS, "f4"], 0.999) == ["f4"]
    encoded = prep.label_encode(rows, "lc_name")
    assert {(r["lc_name"], r["lc"]) for r in encoded.select("lc_name", "lc").distinct().collect()} == {("a", 0), ("b", 1), ("c", 2)}
    decoded = prep.label_decode(encoded.drop("lc_name"), "lc", prep.label_table(rows, "lc_name"))
    assert decoded.where("lc_name = 'b'").count() == rows.where("lc_name = 'b'").count()


def test_collinear_greedy(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("b", "c", -0.99), ("a", "c", 0.5)], "a string, b string, corr double")
    assert prep.collinear_columns(pairs, ["a", "b", "c"], 0.9) == ["b", "c"]
    assert prep.collinear_columns(pairs, ["a", "b", "c"], 0.9, greedy=True) == ["b"]


def test_pca_against_numpy(rows):
    out = prep.pca_project(rows, COLUMNS).select("id", "pc1").toPandas().set_index("id")["pc1"]
    x = rows.select("id", *COLUMNS).toPandas().set_index("id").loc[out.index].to_numpy()
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = x @ vt[0]
    assert np.allclose(np.abs(out.to_numpy()), np.abs(want), atol=1e-6)


def test_trial_params(spark):
    df = spark.createDataFrame(
        [(1, 0.5, "RandomForest", {"rf_max_depth": "7.0", "lgbm_max_depth": "9"}), (2, 0.5, "SVC", {"svc_c": "2.5"})],
        "number int, value double, classifier string, params map<string,string>",
    )
    out = {r["number"]: r["params"] for r in T.trial_params(df).collect()}
    assert out == {1: {"max_depth": "7"}, 2: {"C": "2.5"}}
    assert T.best_trial(df, "value", "number").first()["number"] == 1
