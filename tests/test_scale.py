"""Hot keys, layouts and plans."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.operators import sampling as P
from fieldloom.operators import grid as R
from fieldloom.operators import tables as T
from fieldloom.operators.scale import add_slice, group_median, group_quantiles, join_side, number_rows, pin_small, slice_bounds
from fieldloom.plans import views as V
from fieldloom.plans.registry import Tables
from fieldloom.plans.series_queries import ts_feature_table
from fieldloom.operators import series as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        value = 7.0 if rng.random() < 0.3 else rng.gauss(0, 100)
        rows.append((i, key, None if i % 50 == 0 else value))
    return spark.createDataFrame(rows, "id bigint, key string, value double").repartition(6).cache()


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_quantiles_any_slicing(skewed, slices):
    qs = {"q05": 0.05, "med": 0.5, "q99": 0.99, "least": 0.0, "most": 1.0}
    got = {r["key"]: r for r in group_quantiles(skewed, ["key"], "value", qs, slices).collect()}
    want = skewed.groupBy("key").agg(*[F.percentile("value", F.lit(q)).alias(n) for n, q in qs.items()])
    for r in want.collect():
        for n in qs:
            assert got[r["key"]][n] == pytest.approx(r[n]), (r["key"], n)


@pytest.mark.parametrize("hot", [10, 1500, 10**9])
def test_median_hot_path(skewed, hot):
    got = {r["key"]: r["m"] for r in group_median(skewed, ["key"], "value", "m", hot, slices=9).collect()}
    want = {r[0]: r[1] for r in skewed.groupBy("key").agg(F.median("value")).collect()}
    assert got == pytest.approx(want)


def test_numbering_equals_window(skewed):
    df = skewed.where("key is not null")
    sliced = add_slice(df, "id", slice_bounds(df, "id", 13))
    got = number_rows(sliced, ["key"], ["_slice"], [F.col("id")], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    assert {(r["id"], r["rn"]) for r in got.collect()} == {(r["id"], r["rn"]) for r in want.collect()}
    assert max(r[0] for r in sliced.groupBy("_slice").count().select("count").collect()) < 600


def test_row_index_and_halves(skewed):
    got = T.row_index(skewed, "id").select("id", "row_index").collect()
    assert all(r["id"] == r["row_index"] for r in got)
    parts = {r["part"]: r["count"] for r in T.split_halves(skewed.where("id < 3999"), "id").groupBy("part").count().collect()}
    assert parts == {1: 1999, 2: 2000}


def test_layout_does_not_change_draws(spark, skewed):
    def folds(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            rows = P.stratified_folds(skewed.repartition(int(partitions)), "key", "id", 5, seed=9)
            return {(r["id"], r["fold"]) for r in rows.select("id", "fold").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    assert folds("1") == folds("7")


def test_rounds_equal_single_folds(skewed):
    rows = skewed.where("key is not null").select("id", "key")
    many = {r["id"]: r["folds"] for r in P.fold_rounds(rows, "key", "id", 5, 3).collect()}
    for seed in range(3):
        for r in P.stratified_folds(rows, "key", "id", 5, seed=seed).collect():
            assert many[r["id"]][seed] == r["fold"]


def test_pin_small(spark):
    small, pinned = pin_small(spark.range(5), 5)
    large, kept = pin_small(spark.range(6), 5)
    assert pinned and not kept and small.count() == 5 and large.count() == 6


def test_sample_above_window_limit(spark):
    df = spark.range(5000).withColumn("c", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    out = P.sample_per_class(df, "c", "id", 2000)
    assert {r["c"]: r["count"] for r in out.groupBy("c").count().collect()} == {"a": 1667, "b": 2000}
    drawn = P.sample_per_class(df, "c", "id", 100).select("id").collect()
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        salted = P.sample_per_class(df, "c", "id", 100).select("id").collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert {r[0] for r in drawn} == {r[0] for r in salted}


def test_hot_cells_give_the_same_series(spark, folder):
    t = Tables(spark, folder)
    # two thirds of all rows move to one cell
    rows = V.raw(t).withColumn("cell", F.when(F.col("cell") % 3 > 0, 1).otherwise(F.col("cell")))

    def series(hot_rows):
        out = S.filled_series(rows, V.CELL, "band", "slot", "value", hot_rows=hot_rows)
        return {(r["cell"], r["band"], r["pos"]): round(r["value"], 9) for r in out.collect()}

    assert series(2) == series(10**9)


def test_series_tasks_follow_the_calendar():
    year = (dt.date(2023, 1, 1), dt.date(2023, 12, 31))
    assert S.series_tasks(50, *year, "day", 8) == 8 and S.series_tasks(0, None, None, "day", 8) == 1
    assert S.series_tasks(10**7, *year, "day", 8) == 1825 and S.series_tasks(10**7, *year, "month", 8) == 60
    series = 10**12 // 365  # 10^12 values
    assert 10**5 < S.series_tasks(series, *year, "day", 8) < 10**6


def test_lineage_needs_a_shared_folder(spark, monkeypatch):
    from fieldloom import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(Session())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_shuffles_twice(spark, folder):
    t = Tables(spark, folder)
    wide = S.band_pivot(
        S.series_features(V.full(t), V.SERIES, "slot", "value"), V.CELL, "band", V.BANDS, ["mean", "median"]
    )
    text = plan(wide)
    assert text.count("Exchange hashpartitioning") == 2
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text


def test_class_sample_is_cut_before_the_shuffle(spark, folder):
    text = plan(P.sample_per_class(V.points(Tables(spark, folder)), "lc_name", "id", 12))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_no_nested_loops(spark, folder):
    from __spark_entry__ import queries

    for name in ("substring_join", "disc_pixel_join", "point_pixel_join", "outer_merge_repeated", "class_share"):
        text = plan(queries()[name](spark, folder))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_written_out_rows_are_not_broadcast(spark, folder):
    """Cells of discs and polygons and pieces of paths come from few rows and are many: the other side goes out."""
    from __spark_entry__ import queries

    for name in ("disc_pixel_join", "polygon_pixel_join", "substring_join", "substring_join_ranked"):
        text = plan(queries()[name](spark, folder))
        assert "BuildLeft" not in text and "BuildRight" in text, name


def test_join_side_of_any_size(spark):
    many = spark.range(4).select(F.explode(F.sequence(F.lit(0), F.col("id"))).alias("k"))
    few = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c"), (None, "d")], "k long, v string")
    for most in (100, 3):
        joined = many.join(join_side(few, most), "k")
        assert sorted((r.k, r.v) for r in joined.collect()) == [(0, "a")] * 4 + [(0, "b")] * 4 + [(3, "c")]
        assert ("Broadcast" in plan(joined)) == (most == 100)


def test_flagship_has_no_python(spark, folder):
    text = plan(ts_feature_table(Tables(spark, folder)))
    assert "Python" not in text and "Pandas" not in text


def test_merge_refuses_repeats(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0)], "id int, a double")
    b = spark.createDataFrame([(None, 3.0), (1, 4.0)], "id int, b double")
    with pytest.raises(Exception, match="repeats"):
        T.merge_bands([a, b], ["id"]).collect()
    rows = T.merge_bands([a, b], ["id"], unique=False).collect()
    assert sorted((r["id"] or 0, r["a"] or 0, r["b"]) for r in rows) == [(0, 0, 3.0), (1, 1.0, 4.0), (1, 2.0, 4.0)]


def test_three_way_repeats(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "id int, a double")
    b = spark.createDataFrame([(None, 3.0), (1, 4.0)], "id int, b double")
    c = spark.createDataFrame([(None, 8.0), (3, 9.0)], "id int, c double")
    rows = T.merge_bands([a, b, c], ["id"], unique=False).collect()
    frames = [d.toPandas() for d in (a, b, c)]
    merged = frames[0].merge(frames[1], on="id", how="outer").merge(frames[2], on="id", how="outer")
    want = sorted(repr(tuple(None if v != v else float(v) for v in row)) for row in merged.itertuples(index=False))
    got = sorted(repr(tuple(None if v is None else float(v) for v in row)) for row in rows)
    assert got == want


def test_quantile_of_numpy(spark):
    x = np.random.default_rng(0).normal(size=999)
    df = spark.createDataFrame([(float(v), 1) for v in x], "v double, k int")
    got = group_quantiles(df, ["k"], "v", {"q": 0.37}, 50).first()["q"]
    assert got == pytest.approx(np.quantile(x, 0.37))


def test_point_lookup_leaves_pixels_in_place(spark, tmp_path):
    rows = [(1, 15.0, 985.0), (2, 15.0, 985.0), (3, 20_000.0, 5.0)]
    spark.createDataFrame(rows, "id int, x double, y double").write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))  # of a size that Spark knows
    pixels = spark.range(1_000_000).selectExpr("CAST(id DIV 1000 AS INT) AS row", "CAST(id % 1000 AS INT) AS col", "id * 1.0 AS value")
    looked = R.point_pixel_join(points, pixels, 0.0, 1000.0, 10.0)
    text = plan(looked)
    semi = next(line for line in text.splitlines() if "LeftSemi" in line)
    assert "BroadcastHashJoin" in semi
    below = text[text.index(semi) :]
    assert "Exchange hashpartitioning" not in below[: below.index("Range")]
    assert {r["id"]: r["value"] for r in looked.collect()} == {1: 1001.0, 2: 1001.0, 3: None}
