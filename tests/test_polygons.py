"""Polygons on the pixel grid against every cell tried by hand."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import polygons as Y

X0, Y0, SIZE, SIDE = -3.0, 50.0, 2.0, 30


def star(rng, x, y, reach, n):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = reach * rng.uniform(0.3, 1, n)
    ring = np.stack([x + r * np.cos(angle), y + r * np.sin(angle)], 1)
    return np.vstack([ring, ring[:1]])


def crosses(a, b, left, bottom, right, top):
    """Whether a segment meets a rectangle, by clipping it to each side."""
    begin, end = 0.0, 1.0
    for p, q, low, high in ((a[0], b[0], left, right), (a[1], b[1], bottom, top)):
        if p == q:
            if not low <= p <= high:
                return False
            continue
        s, t = sorted(((low - p) / (q - p), (high - p) / (q - p)))
        begin, end = max(begin, s), min(end, t)
    return begin <= end


def cells(parts):
    out = set()
    lines = [(r[i], r[i + 1]) for rings in parts for r in rings for i in range(len(r) - 1)]
    for row in range(SIDE):
        for col in range(SIDE):
            left, top = X0 + col * SIZE, Y0 - row * SIZE
            x, y = left + SIZE / 2, top - SIZE / 2
            inside = sum((a[1] <= y) != (b[1] <= y) and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) < x for a, b in lines) % 2
            if inside or any(crosses(a, b, left, top - SIZE, left + SIZE, top) for a, b in lines):
                out.add((row, col))
    return out


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(8)
    out = {}
    for i in range(12):
        x, y = rng.uniform(8, 45), rng.uniform(5, 40)
        rings = [star(rng, x, y, rng.uniform(1, 14), 9)]
        if i % 2:
            rings.append(star(rng, x, y, 0.25 * np.abs(rings[0] - [x, y]).max(), 5))
        out[i] = [rings] + ([[star(rng, rng.uniform(8, 45), rng.uniform(5, 40), 0.4, 4)]] if i % 3 == 0 else [])
    return out


@pytest.mark.parametrize("fan", [4096, 3])
def test_against_every_cell(spark, shapes, monkeypatch, fan):
    monkeypatch.setattr(Y, "FAN", fan)
    rows = [(i, bytearray(Y.wkb_of(parts))) for i, parts in shapes.items()] + [(50, None), (51, bytearray(struct.pack("<BII", 1, 3, 0))), (52, bytearray(struct.pack("<BII", 1, 6, 0)))]
    df = spark.createDataFrame(rows, "id long, geometry binary").withColumn("row", F.lit("clash")).repartition(3)
    got = Y.polygon_pixels(df, "id", "geometry", X0, Y0, SIZE).where("row BETWEEN 0 AND 29 AND col BETWEEN 0 AND 29").collect()
    assert len(got) == len(set(got))
    for i, parts in shapes.items():
        assert {(r["row"], r["col"]) for r in got if r["id"] == i} == cells(parts), i
    assert {r["id"] for r in got} <= set(shapes)


def test_binary_forms(spark):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]
    plain = Y.wkb_of([[ring]])
    big = struct.pack(">BIII", 0, 3, 1, 4) + np.array(ring, ">f8").tobytes()
    high = struct.pack("<BIIII", 1, 3 | 0x80000000 | 0x20000000, 32736, 1, 4) + np.array([[*p, 9.0] for p in ring], "<f8").tobytes()
    iso = struct.pack("<BIII", 1, 1003, 1, 4) + np.array([[*p, 9.0] for p in ring], "<f8").tobytes()
    for raw in (plain, big, high, iso):
        assert np.array_equal(Y.rings_of(raw)[0], np.array(ring))
    for raw in (plain[:20], struct.pack("<BI", 1, 1) + b"\0" * 16, b""):
        with pytest.raises(ValueError):
            Y.rings_of(raw)
    made = spark.createDataFrame([([[ring]],), (None,)], "p array<array<array<array<double>>>>").select(Y.polygon_wkb("p").alias("g")).collect()
    assert [r.g for r in made] == [bytearray(plain), None]


def test_pixels_are_joined_by_cell(spark, shapes):
    df = spark.createDataFrame([(i, bytearray(Y.wkb_of(p))) for i, p in shapes.items()], "id long, geometry binary")
    pixels = spark.range(SIDE * SIDE).select(F.floor(F.col("id") / SIDE).cast("int").alias("row"), (F.col("id") % SIDE).cast("int").alias("col"))
    joined = Y.polygon_pixel_join(df, pixels, "id", "geometry", X0, Y0, SIZE)
    assert joined.count() == sum(len(cells(p)) for p in shapes.values())
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
