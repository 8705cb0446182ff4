"""Files in and out."""

import datetime as dt
import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import expressions as E
from fieldloom.operators import grid as R
from fieldloom.operators import sampling as P
from fieldloom.sources import features as features_of
from fieldloom.sources import files, names, scenes


@pytest.fixture()
def points(spark):
    return spark.createDataFrame([(1, "maize", 1.5, -2.25), (2, "rice", 0.0, 1e-9)], "id bigint, lc string, x double, y double")


def test_csv(spark, tmp_path, points):
    files.write_csv(points, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), points.schema)
    assert sorted(back.collect()) == sorted(points.collect())


def test_parquet_glob_and_tiles(spark, tmp_path, points):
    tiled = points.withColumn("band", F.lit("B2")).withColumn("tile", F.col("id").cast("string"))
    files.write_tiles(tiled, str(tmp_path / "t"))
    files.write_tiles(tiled.where("id = 1").withColumn("lc", F.lit("water")), str(tmp_path / "t"))
    back = {r["id"]: r["lc"] for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert back == {1: "water", 2: "rice"}
    points.coalesce(1).write.parquet(str(tmp_path / "g"))
    assert files.read_parquet(spark, str(tmp_path / "g"), "*.snappy.parquet").count() == 2


def test_geojson(spark, tmp_path, points):
    files.write_geojson(points, str(tmp_path / "j"))
    back = files.read_geojson(spark, str(tmp_path / "j"), "struct<id bigint, lc string>", collection=False)
    assert sorted(back.collect()) == sorted(points.collect())
    features = [json.loads(r[0]) for r in files.feature_lines(points).collect()]
    (tmp_path / "one.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    whole = files.read_geojson(spark, str(tmp_path / "one.geojson"), "struct<id bigint, lc string>")
    assert sorted(whole.collect()) == sorted(points.collect())


@pytest.mark.parametrize("size", ["90b", "1k", "128m"])
def test_collection_in_byte_ranges(spark, tmp_path, size):
    names_ = ["plain", 'br}ace "quoted" {', "back\\slash\\", '[{"type":"Feature"}]', "çé😀}", "", "\\\"}", "x" * 700 + "}{" * 90]
    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [i / 2, -i]}, "properties": {"id": i, "lc": names_[i % len(names_)], "more": [{"a": [{}]}, "}"]}}
        for i in range(9 if size == "90b" else 40)
    ]
    crs = {"type": "name", "properties": {"name": 'urn "[{" }'}}
    whole = {"type": "FeatureCollection", "bbox": [1, 2], "crs": crs, "features": features, "links": [{"type": "Link", "to": {}}, {"b": 1}]}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text(json.dumps(whole, indent=1))
    (tmp_path / "c" / "b.json").write_text(json.dumps(whole, ensure_ascii=False) + "\n")
    (tmp_path / "c" / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    (tmp_path / "c" / "d.json").write_text("")
    (tmp_path / "c" / "e.json").write_text(json.dumps({"features": features[:1], "type": "FeatureCollection"}))
    for key, value in (("maxPartitionBytes", size), ("openCostInBytes", "0"), ("minPartitionNum", "1")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        tasks = features_of.json_pieces(spark, str(tmp_path / "c")).rdd.getNumPartitions()
        got = files.read_geojson(spark, str(tmp_path / "c"), "struct<id bigint, lc string>").collect()
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")
    rows = [(f["properties"]["id"], f["properties"]["lc"], f["geometry"]["coordinates"][0], float(f["geometry"]["coordinates"][1])) for f in features]
    assert sorted(tuple(r) for r in got) == sorted(rows * 2 + rows[:1])
    assert tasks == 1 if size == "128m" else tasks > 4


def test_collections_written_whole(spark, tmp_path, points):
    features_of.write_collections(files.feature_lines(points.repartition(3)), str(tmp_path / "w"))
    parts = [json.loads(p.read_text()) for p in (tmp_path / "w").glob("part-*")]
    assert all(p["type"] == "FeatureCollection" for p in parts) and sum(len(p["features"]) for p in parts) == points.count()
    back = files.read_geojson(spark, str(tmp_path / "w"), "struct<id bigint, lc string>")
    assert sorted(back.collect()) == sorted(points.collect())


def test_point_hex(spark, points):
    stored = files.save_points(points)
    want = {r["id"]: "0101000000" + struct.pack("<dd", r["x"], r["y"]).hex().upper() for r in points.collect()}
    assert {r["id"]: r["geometry"] for r in stored.collect()} == want
    bad = stored.union(spark.createDataFrame([(3, "x", "zz"), (4, "x", None)], stored.schema))
    rows = {r["id"]: r for r in files.load_points(bad).collect()}
    assert rows[3]["bad_point"] and rows[4]["bad_point"] and rows[1]["x"] == 1.5 and not rows[2]["bad_point"]


def test_clean_columns_coalesces(spark):
    a, b = "B2_mean_0000000000-0000000001", "B2_mean_0000000000-0000000002-part1"
    df = spark.createDataFrame([(1, 5.0, None), (2, None, 6.0)], f"id int, `{a}` double, `{b}` double")
    out = names.clean_columns(df)
    assert out.columns == ["id", "B2_mean"]
    assert [r["B2_mean"] for r in out.orderBy("id").collect()] == [5.0, 6.0]
    assert names.clean_name("_0000000000-0000000001") == "_0000000000-0000000001"


def test_scene_end_day(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2023, 1, 31, 9), 10.0, 0.0, 0.0, 1.0, 1.0)],
        "ts timestamp_ntz, cloud_pct double, min_x double, min_y double, max_x double, max_y double",
    )
    box, first, last = (0.0, 0.0, 5.0, 5.0), dt.date(2023, 1, 1), dt.date(2023, 1, 31)
    assert scenes.scene_filter(df, box, first, last).count() == 1
    assert scenes.scene_filter(df, box, first, last, literal=True).count() == 0


def test_utm_known_point_and_back(spark):
    df = spark.createDataFrame([(33.0, 0.0), (36.7, -3.4)], "lon double, lat double")
    x, y = G.to_utm(F.col("lon"), F.col("lat"))
    there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    first = there.first()
    assert first["x"] == pytest.approx(500000.0) and first["y"] == pytest.approx(10000000.0)
    lon, lat = G.from_utm(F.col("x"), F.col("y"))
    for r in there.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r["a"] == pytest.approx(r["lon"], abs=1e-8) and r["b"] == pytest.approx(r["lat"], abs=1e-8)


def test_hex_holds_nearest_centre(spark):
    side = 10.0
    df = spark.range(500).select(
        (F.rand(1) * 200 - 100).alias("x"), (F.rand(2) * 200 - 100).alias("y")
    )
    col, row = G.hex_of(F.col("x"), F.col("y"), 0.0, 0.0, side)
    cx, cy = G.hex_centre(F.col("c"), F.col("r"), 0.0, 0.0, side)
    placed = df.select("x", "y", col.alias("c"), row.alias("r")).select("*", cx.alias("cx"), cy.alias("cy"))
    for p in placed.collect():
        own = math.hypot(p["x"] - p["cx"], p["y"] - p["cy"])
        assert own <= side + 1e-9
        for k in range(6):
            a = math.radians(30 + 60 * k)
            nx, ny = p["cx"] + math.sqrt(3) * side * math.cos(a), p["cy"] + math.sqrt(3) * side * math.sin(a)
            assert own <= math.hypot(p["x"] - nx, p["y"] - ny) + 1e-9


def test_square_grid_covers(spark):
    bounds = spark.createDataFrame([(0.0, 0.0, 100.0, 50.0)], G.BOUNDS)
    cells = G.square_grid(bounds, 30.0).collect()
    assert min(c["x"] for c in cells) <= -20 and max(c["x"] for c in cells) + 30 >= 120
    assert min(c["y"] for c in cells) <= -20 and max(c["y"] for c in cells) + 30 >= 70


def test_disc_samples_stay_inside(spark, points):
    sized = points.withColumn("r", F.lit(20.0))
    out = P.disc_sample(sized, "id", "r", original_group="own")
    near = out.join(points.select("id", F.col("x").alias("px"), F.col("y").alias("py")), "id")
    assert out.count() == 2 * 5
    assert near.where(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) > 20).count() == 0
    assert {(r["id"], r["sample_id"]) for r in out.collect()} == {(1, 1), (2, 2)}


def test_expressions(spark):
    df = spark.createDataFrame([("Small",), ("25",), (None,), ("odd",)], "s string")
    assert [r[0] for r in df.select(E.field_size_metres("s")).collect()] == [5.0, 25.0, 10.0, None]
    red = spark.createDataFrame([(1000.0, 0.0, 0.0), (5.0, 5.0, 5.0), (0.0, 0.0, 9.0)], "r double, g double, b double")
    hues = [r[0] for r in red.select(E.hue("r", "g", "b")).collect()]
    assert hues[:2] == [0.0, 0.0] and hues[2] == pytest.approx(2 / 3)
    zero = spark.createDataFrame([(0.0, 0.0, 10000 / 7.5)], "n double, r double, b double")
    assert zero.select(E.evi("n", "r", "b")).first()[0] is None
    kept = E.keep_drop_other(
        spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), "k", ["a"], ["b"], drop_other=True
    )
    assert [r[0] for r in kept.collect()] == ["a"]


def test_mask_against_brute_force(spark):
    import random

    rng = random.Random(4)
    cells = {(r, c): rng.random() < 0.7 for r in range(14) for c in range(17)}
    df = spark.createDataFrame([(1, r, c, f) for (r, c), f in cells.items()], "tile int, row int, col int, flag boolean")

    def near(at, wanted, radius):
        return any(
            cells.get((at[0] + i, at[1] + j)) == wanted
            for i in range(-radius, radius + 1)
            for j in range(-radius, radius + 1)
            if i * i + j * j <= radius * radius
        )

    got = {(r["row"], r["col"]): r["e"] for r in R.erode(df, ["tile"], "flag", 2, "e").collect()}
    assert got == {k: f and not near(k, False, 2) for k, f in cells.items()}
    got = {(r["row"], r["col"]): r["d"] for r in R.dilate(df, ["tile"], "flag", 3, "d").collect()}
    assert got == {k: near(k, True, 3) for k, f in cells.items()}


def test_window_filter_and_tiles(spark):
    df = spark.createDataFrame([(0, 0), (5, 9), (12, 3)], "row int, col int")
    assert R.window_filter(df, (0, 5), (0, 9)).count() == 2
    assert {(r["tile_row"], r["tile_col"]) for r in R.with_tile(df, 10).collect()} == {(0, 0), (1, 0)}
