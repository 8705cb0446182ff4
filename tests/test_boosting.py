"""Softmax boosting, its attribution, and kernel machines."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from fieldloom.ml import attribution as A
from fieldloom.ml import boosting as B
from fieldloom.ml import kernels as K
from fieldloom.ml import models as L

ROWS, CLASSES = 600, 3


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(ROWS, 4)).round(3)
    score = np.stack([x[:, 0] + x[:, 1] ** 2, 1.5 - x[:, 0] * x[:, 1], np.sin(3 * x[:, 2]) + 1], 1)
    return x, (score + rng.normal(scale=0.2, size=score.shape)).argmax(1)


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(i, int(y), i % 3, 1.0 + i % 2, [float(v) for v in x]) for i, (x, y) in enumerate(zip(*data))]
    return spark.createDataFrame(rows, "id long, lc int, fold int, w double, x array<double>").repartition(3).cache()


def fit(table, held=None, fold=None, weight=None, **settings):
    return B.fit_models(table, [B.Job(B.Settings(**settings), held)], fold=fold, weight=weight, draw=F.col("id"))[0]


def splits(model):
    return [[(t.feature.tolist(), t.bin.tolist(), t.value.round(9).tolist(), t.cover.tolist()) for t in trees] for trees in model.rounds]


def test_first_round_against_a_plain_loop(table, data, monkeypatch):
    """Best-first growth over all splits of raw sums; every way to the leaves gives the same trees."""
    x, y = data
    s = B.Settings(n_estimators=2, num_leaves=6, min_data_in_leaf=15, reg_lambda=0.5)
    model = fit(table, n_estimators=2, num_leaves=6, min_data_in_leaf=15, reg_lambda=0.5)
    start = np.log(np.bincount(y) / len(y))
    p = np.tile(np.exp(start), (ROWS, 1))
    for k, tree in enumerate(model.rounds[0]):
        g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k]) * CLASSES / (CLASSES - 1)

        def gain(rows, part):
            return sum(g[r].sum() ** 2 / (h[r].sum() + 0.5) for r in (rows[part], rows[~part])) - g[rows].sum() ** 2 / (h[rows].sum() + 0.5)

        def best(rows):
            found = (0.0,)
            for f in range(4):
                for cut in np.unique(np.concatenate([t.cut[t.feature == f] for trees in model.rounds for t in trees])):
                    part = x[rows, f] <= cut
                    if min(part.sum(), (~part).sum()) >= 15:
                        found = max(found, (gain(rows, part), f, cut))
            return found

        inner = np.flatnonzero(tree.feature >= 0)
        assert len(inner) == 5
        leaf = tree.walk(x, tree.cut)
        for n in np.flatnonzero(tree.feature < 0):
            rows = leaf == n
            assert tree.cover[n] == rows.sum() >= 15 and tree.value[n] == pytest.approx(-0.1 * g[rows].sum() / (h[rows].sum() + 0.5))
        root = best(np.arange(ROWS))
        assert (tree.feature[0], tree.cut[0]) == root[1:]
        # no leaf that is left could be split at more gain than the last split that was taken
        taken = [gain(np.flatnonzero(np.isin(leaf, below(tree, n))), x[np.isin(leaf, below(tree, n)), tree.feature[n]] <= tree.cut[n]) for n in inner]
        assert max(best(np.flatnonzero(leaf == n))[0] for n in np.unique(leaf)) <= min(taken) + 1e-9 or min(taken) > 0
    for few, room in ((0, 1 << 27), (0, 1), (100, 1 << 27)):
        monkeypatch.setattr(B, "FEW", few)
        monkeypatch.setattr(B, "HIST_BYTES", room)
        assert splits(B.fit_models(table, [B.Job(s)], draw=F.col("id"))[0]) == splits(model), (few, room)


def test_rounds_of_few_rows_come_from_few_jobs(table, monkeypatch):
    """A table of few rows asks for many rounds at once; the models are those of a job for each round."""
    jobs = [B.Job(B.Settings(n_estimators=9, num_leaves=5, bagging_fraction=0.7, bagging_freq=2, max_depth=3), 0), B.Job(B.Settings(n_estimators=30, learning_rate=0.9, patience=3, metrics=B.METRICS), 1)]
    asked = []
    ask = B.ask
    monkeypatch.setattr(B, "ask", lambda *a: asked.append(a) or ask(*a))
    monkeypatch.setattr(B, "ROUNDS", 4)
    monkeypatch.setattr(B, "KEEP", 2)
    few = B.fit_models(table, jobs, fold="fold", weight="w", draw=F.col("id"))
    assert not asked
    monkeypatch.setattr(B, "WHOLE", 0)
    each = B.fit_models(table, jobs, fold="fold", weight="w", draw=F.col("id"))
    assert len(asked) >= 9
    for a, b in zip(few, each):
        assert splits(a) == splits(b) and len(a.history) == len(b.history) == len(a.rounds)
        assert [h["multi_logloss"] for h in a.history] == pytest.approx([h["multi_logloss"] for h in b.history])


def test_many_rounds_of_middling_tables_come_from_few_jobs(table, monkeypatch):
    """Above WHOLE rows each of up to 10,000 rounds took a job; many rounds now come in jobs of ROUNDS, with the same trees."""
    jobs = [B.Job(B.Settings(n_estimators=B.MANY, learning_rate=0.9, num_leaves=6, patience=3, metrics=B.METRICS), i) for i in (0, 1)]
    asked = []
    ask = B.ask
    monkeypatch.setattr(B, "ask", lambda *a: asked.append(a) or ask(*a))
    monkeypatch.setattr(B, "WHOLE", 0)
    few = B.fit_models(table, jobs, fold="fold", draw=F.col("id"), bins=8)
    assert not asked
    monkeypatch.setattr(B, "PAIRED", 1)  # 128 rows at 8 bins
    paired = B.fit_models(table, jobs, fold="fold", draw=F.col("id"), bins=8)
    monkeypatch.setattr(B, "MANY", B.MANY + 1)
    each = B.fit_models(table, jobs, fold="fold", draw=F.col("id"), bins=8)
    assert len(asked) > 3
    for a, b, c in zip(few, each, paired):
        assert len(a.rounds) > 3 and splits(a) == splits(b) == splits(c)


@pytest.mark.parametrize("features", (1, 4, 5))
def test_sums_of_feature_pairs(features):
    rng = np.random.default_rng(7)
    bins, g, rows = rng.integers(0, 16, (500, features)).astype(np.uint8), rng.normal(size=500), np.arange(0, 500, 2)
    sums = B.pair_sums(B.pairs_of(bins, 16), (g, None), rows, features, 16)
    for f in range(features):
        assert sums[0, f] == pytest.approx(np.bincount(bins[rows, f], g[rows], 16)) and (sums[1, f] == np.bincount(bins[rows, f], minlength=16)).all()


def test_a_tree_of_middling_rows_is_one_job(spark, monkeypatch):
    """Above 65,536 rows a round took a job for each level of its trees; up to FEW rows it is one."""
    df = spark.range(70_000).select("id", (F.xxhash64("id") % 2 + F.col("id") % 2 > 0).cast("int").alias("lc"), F.array((F.col("id") % 97).cast("double"), (F.col("id") % 2).cast("double")).alias("x"))
    asked = []
    ask = B.ask
    monkeypatch.setattr(B, "ask", lambda *a: asked.append(a) or ask(*a))
    model = fit(df, n_estimators=2, num_leaves=8)
    assert len(model.rounds) == 2 and len(asked) == 3  # one a round, and one for the last round's held-out rows


def below(tree, n):
    if tree.feature[n] < 0:
        return [n]
    return below(tree, tree.left[n]) + below(tree, tree.right[n])


@pytest.mark.parametrize("bits", (2, 10))
def test_parts_by_tables_of_outcomes(table, data, bits, monkeypatch):
    """Tables of the splits' outcomes give what a product for each leaf gives; models that grew on share their rounds."""
    monkeypatch.setattr(A, "BITS", bits)
    whole = fit(table, n_estimators=6, num_leaves=9)
    other = fit(table, held=0, fold="fold", n_estimators=3, num_leaves=9)
    models = [whole, whole.until(2), other]
    assert A.model_chains(models) == [[1, 0], [2]]
    columns = np.ascontiguousarray(data[0].T)
    for k in range(CLASSES):
        for m, parts in zip(models, A.class_parts(columns, models, k)):
            assert np.abs(parts.T - A.margin_parts(data[0], A.class_leaves(m))[:, k]).max() < 1e-12
    tree = whole.rounds[0][0]
    assert (tree.places(np.searchsorted(np.arange(8), data[0]).T.astype(np.uint8)) == tree.walk(np.searchsorted(np.arange(8), data[0]), tree.bin)).all()
    known = {r["feature"]: r for r in A.margin_importance(models, table, ["a", "b", "c", "d"], "x").collect()}
    monkeypatch.setattr(A, "LOOKED_UP", 1)
    for r in A.margin_importance(models, table, ["a", "b", "c", "d"], "x").collect():
        assert r["mean_importance"] == pytest.approx(known[r["feature"]]["mean_importance"]) and r["max_importance"] == pytest.approx(known[r["feature"]]["max_importance"])


def test_models_share_passes_and_layout_does_not_matter(table, monkeypatch):
    monkeypatch.setattr(B, "KEEP", 3)
    jobs = [B.Job(B.Settings(n_estimators=7, num_leaves=5), 0), B.Job(B.Settings(n_estimators=4, bagging_fraction=0.6, bagging_freq=2, max_depth=2), 2)]
    both = B.fit_models(table, jobs, fold="fold", draw=F.col("id"))
    monkeypatch.setattr(B, "KEEP", 100)
    monkeypatch.setattr(B, "BLOCK", 64)
    alone = [B.fit_models(table.repartition(5), [j], fold="fold", draw=F.col("id"))[0] for j in jobs]
    for a, b in zip(both, alone):
        assert [[t.feature.tolist() for t in r] for r in a.rounds] == [[t.feature.tolist() for t in r] for r in b.rounds]
        assert a.history[-1]["multi_logloss"] == pytest.approx(b.history[-1]["multi_logloss"])
    assert [len(m.rounds) for m in both] == [7, 4] and all(len(m.history) == len(m.rounds) for m in both)


@pytest.fixture(scope="module")
def plain(table):
    return splits(fit(table, n_estimators=2))


@pytest.mark.parametrize(
    "change",
    [{"learning_rate": 0.3}, {"num_leaves": 3}, {"max_depth": 2}, {"min_data_in_leaf": 80}, {"bagging_fraction": 0.5, "bagging_freq": 1}, {"reg_lambda": 5.0}, {"weight": "w"}],
)
def test_every_parameter_has_effect(table, plain, change):
    assert splits(fit(table, n_estimators=2, **change)) != plain


def test_early_stopping(table):
    model = fit(table, held=0, fold="fold", n_estimators=60, learning_rate=0.8, patience=4, metrics=B.METRICS)
    best = max(model.best_round(m) for m in B.METRICS)
    assert len(model.rounds) == min(60, best + 4) and len(model.rounds) < 60
    losses = [h["multi_logloss"] for h in model.history]
    assert losses[model.best_round("multi_logloss") - 1] == min(losses)
    held = table.where("fold = 0").select("lc", "x").collect()
    m = model.until(5).margins(np.array([r.x for r in held]))
    p = B.softmax(m)[np.arange(len(held)), [r.lc for r in held]]
    assert -np.log(p).mean() == pytest.approx(losses[4])


def test_beats_one_against_the_rest(table):
    rows = table.withColumn("features", array_to_vector("x")).withColumn("lc", F.col("lc").cast("double"))
    hits = {"softmax": 0, "rest": 0}
    for i in range(3):
        train, test = rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)
        made = {"softmax": L.classifier("LGBM", {"n_estimators": 20, "learning_rate": 0.2}), "rest": OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=5, seed=1), labelCol="lc")}
        for name, estimator in made.items():
            hits[name] += estimator.fit(train).transform(test).where(F.col("prediction") == F.col("lc")).count()
    assert hits["softmax"] >= hits["rest"] and hits["softmax"] > 0.75 * ROWS


def test_awkward_rows(spark):
    rows = [(i, i % 2, [float(i % 2) if i % 3 else None, 1.0, float("nan")]) for i in range(80)] + [(99, None, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, lc int, x array<double>")
    model = fit(df, n_estimators=3, min_data_in_leaf=5)
    assert all(set(t.feature) <= {-1, 0} for trees in model.rounds for t in trees)
    got = B.SoftmaxModel(model, "x").transform(df).where("lc IS NOT NULL AND id % 3 <> 0")
    assert got.where(F.col("prediction") != F.col("lc")).count() == 0
    with pytest.raises(ValueError):
        fit(df.limit(0))
    with pytest.raises(ValueError):
        B.Settings(num_leaves=1)


def test_saved_and_read_back(spark, table, data, tmp_path):
    model = fit(table, n_estimators=3)
    model.nodes(spark).write.parquet(str(tmp_path / "m"))
    back = B.load_nodes(spark.read.parquet(str(tmp_path / "m")))
    assert np.array_equal(back.margins(data[0]), model.margins(data[0]))


def test_margin_parts_add_up(spark, table, data):
    x = data[0].copy()
    x[::7, 0] = np.nan
    holes = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>").repartition(4)
    models = [fit(table, n_estimators=4), fit(table, n_estimators=2, num_leaves=8)]
    for run, model in enumerate(models):
        long = A.margin_attribution(models, holes, "id", "x").where(F.col("run") == run)
        total = {(r["id"], r["class"]): r["s"] for r in long.groupBy("id", "class").agg(F.sum("shap").alias("s")).collect()}
        want = model.margins(x)
        assert all(total[i, k] == pytest.approx(want[i, k], abs=1e-9) for i in range(ROWS) for k in range(CLASSES))
    parts = np.abs(np.stack([A.margin_parts(x, A.class_leaves(m)) for m in models]))
    names = ["a", "b", "c", "d"]
    for r in A.margin_importance(models, holes, names, "x").collect():
        f = names.index(r["feature"])
        assert r["mean_importance"] == pytest.approx(parts.mean(0).mean(1).sum(0)[f]) and r["max_importance"] == pytest.approx(parts.max(0).mean(1).sum(0)[f])
    plan = A.margin_attribution(models, holes, "id", "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # the fixture's own repartition


def test_a_table_in_one_file_is_explained_by_all_cores(spark, table, tmp_path):
    model = fit(table, n_estimators=2)
    table.select("x").coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    out = A.margin_importance([model], one, ["a", "b", "c", "d"], "x")
    assert f"RoundRobinPartitioning({spark.sparkContext.defaultParallelism})" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["feature"] for r in out.collect()} == {"a", "b", "c", "d"}


def test_base_is_the_mean_margin(table, data):
    model = fit(table, n_estimators=5)
    assert A.margin_base(model) == pytest.approx(model.margins(data[0]).mean(0))


# --- kernels --------------------------------------------------------------------


def test_random_features_come_near_the_kernel():
    x = np.random.default_rng(0).normal(size=(40, 6))
    z = K.fourier_features(x, 0.2, 4096, 1)
    want = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.08
    z = np.mean([(lambda s: s @ s.T)(K.polynomial_sketch(x, 0.2, 3, 2048, seed)) for seed in range(8)], axis=0)
    want = (0.2 * x @ x.T) ** 3
    assert np.abs(z - want).max() < 0.15 * np.abs(want).max()


def test_rings_and_products(spark):
    rng = np.random.default_rng(3)
    angle, ring = rng.uniform(0, 2 * np.pi, 500), np.arange(500) % 2
    r = 1 + ring + rng.normal(scale=0.1, size=500)
    rings = [(float(c), [float(a * np.cos(t)), float(a * np.sin(t))]) for c, a, t in zip(ring, r, angle)]
    x = rng.normal(size=(500, 2))
    products = [(float(a * b > 0), [float(a), float(b)]) for a, b in x]
    share = {}
    for name, rows, kernel, degree in (("rings", rings, "rbf", 3), ("rings", rings, "linear", 3), ("products", products, "poly", 2)):
        df = spark.createDataFrame(rows, "lc double, x array<double>").withColumn("features", array_to_vector("x")).cache()
        model = L.classifier("SVC", {"C": 10.0, "kernel": kernel, "degree": degree, "max_iter": 60}, rows=500).fit(df)
        share[name, kernel] = model.transform(df).where("prediction = lc").count() / 500
    assert share["rings", "rbf"] > 0.97 and share["products", "poly"] > 0.93 and share["rings", "linear"] < 0.7
    with pytest.raises(ValueError):
        L.classifier("SVC", {"kernel": "other"}, rows=5)


def test_gamma_of_the_data(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "x array<double>").select(array_to_vector("x").alias("features"))
    machine = K.KernelMachine(2, kernel="rbf")
    assert machine._width(df) == pytest.approx(1 / (2 * np.var([1, 2, 3, 6])))
    assert K.KernelMachine(2, kernel="rbf", gamma="auto")._width(df) == 0.5
    assert df.select(vector_to_array("features").alias("x")).count() == 2
