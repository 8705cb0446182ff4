"""Polygons to the pixels they touch: an edge table from binary rings, worked row by row of the grid."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from fieldloom.operators.grid import joined_runs
from fieldloom.operators.scale import join_side

POLYGON, MULTI = 3, 6
#: Pixel rows that one edge, and columns that one run, are written out by at a time.
FAN = 4096


def rings_of(raw: bytes) -> list[np.ndarray]:
    """The rings (n x 2) of a WKB polygon or multi-polygon, of either byte order, with or without z, m and srid.

    Other kinds and broken bytes are refused.
    """
    rings: list[np.ndarray] = []

    def read(at: int) -> int:
        order = "<" if raw[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", raw, at + 1)
        at += 9 if kind & 0x20000000 else 5
        flat = kind & 0x0FFFFFFF
        width = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[flat // 1000 % 4]
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        for _ in range(n):
            if flat % 1000 == MULTI:
                at = read(at)
            else:
                (size,) = struct.unpack_from(order + "I", raw, at)
                rings.append(np.frombuffer(raw, order + "f8", size * width, at + 4).reshape(size, width)[:, :2].astype(np.float64))
                at += 4 + 8 * size * width
        if flat % 1000 not in (POLYGON, MULTI):
            raise ValueError(f"a polygon is expected, found kind {kind}")
        return at

    try:
        read(0)
    except (IndexError, struct.error) as broken:
        raise ValueError("broken geometry") from broken
    return rings


def wkb_of(parts: Sequence[Sequence[Sequence[Sequence[float]]]]) -> bytes:
    """WKB of polygons given as lists of closed rings: one is a polygon, several are a multi-polygon."""
    each = [
        struct.pack("<BII", 1, POLYGON, len(rings)) + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in rings) for rings in parts
    ]
    return each[0] if len(each) == 1 else struct.pack("<BII", 1, MULTI, len(each)) + b"".join(each)


@F.arrow_udf(BinaryType())
def polygon_wkb(parts: pa.Array) -> pa.Array:
    """Column of WKB from array<array<array<array<double>>>>: polygons, rings, points, x and y. Null stays null."""
    return pa.array([None if v is None else wkb_of(v) for v in parts.to_pylist()], pa.binary())


def edges(polygons: DataFrame, key: str, geometry: str) -> DataFrame:
    """(key, x1, y1, x2, y2) of every edge of every ring; null and empty geometries have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column("_g")):
                raw = value.as_py()
                for ring in rings_of(raw) if raw else []:
                    if len(ring) > 1:
                        ends = [pa.array(ring[:-1, 0]), pa.array(ring[:-1, 1]), pa.array(ring[1:, 0]), pa.array(ring[1:, 1])]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(ring) - 1, i))), *ends], [key, "x1", "y1", "x2", "y2"])

    rows = polygons.where(F.col(geometry).isNotNull()).select(key, F.col(geometry).cast("binary").alias("_g"))
    kind = polygons.schema[key].dataType.simpleString()
    return rows.mapInArrow(cut, f"`{key}` {kind}, x1 double, y1 double, x2 double, y2 double")


def _along(first: Column, last: Column) -> Column:
    """Starts of slices of FAN whole numbers, so that no array is long."""
    return F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(FAN).cast("long")))


def polygon_pixels(polygons: DataFrame, key: str, geometry: str, x0: float, y0: float, size: float) -> DataFrame:
    """Every cell that a polygon's area or outline reaches into: (key, row, col), each once.

    Inside is by the even-odd rule over all rings, so holes and the parts of a multi-polygon need no care. A cell
    that no edge crosses lies inside or outside as a whole, which its centre tells:

    1. Each edge goes to the pixel rows that it crosses; there it touches the columns between its two ends in the row.
    2. The crossings of a row's middle line, in order, open and close runs of cells whose centres are inside.
    3. Runs of both kinds are joined by polygon and row and written out as cells.

    An edge along a cell border counts for the cell below or right of it. A row of one polygon is one group: it holds
    as many runs as edges cross it.
    """
    lines = edges(polygons, key, geometry).select(
        key, ((F.col("x1") - x0) / size).alias("x1"), ((F.lit(y0) - F.col("y1")) / size).alias("y1"),
        ((F.col("x2") - x0) / size).alias("x2"), ((F.lit(y0) - F.col("y2")) / size).alias("y2"),
    )
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    tall = lines.withColumn("_s", _along(F.floor(low), F.floor(high))).withColumn("row", F.explode(F.sequence("_s", F.least(F.col("_s") + FAN - 1, F.floor(high)))))
    slope = F.when(F.col("y1") != F.col("y2"), (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))

    def x_at(y: Column) -> Column:
        return F.col("x1") + (y - F.col("y1")) * slope

    top, bottom = F.greatest(low, F.col("row").cast("double")), F.least(high, (F.col("row") + 1).cast("double"))
    level = F.col("y1") == F.col("y2")
    ends = [F.when(level, F.col(a)).otherwise(x_at(b)) for a, b in (("x1", top), ("x2", bottom))]
    middle = F.col("row") + 0.5
    crosses = (F.least("y1", "y2") <= middle) & (middle < F.greatest("y1", "y2"))
    rows = tall.select(
        key, F.col("row").cast("int").alias("row"), F.floor(F.least(*ends)).alias("first"), F.floor(F.greatest(*ends)).alias("last"), F.when(crosses, x_at(middle)).alias("_x")
    )
    touched = rows.select(key, "row", "first", "last")
    lined = rows.where("_x IS NOT NULL").groupBy(key, "row").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("_xs") - 2, F.lit(2)), lambda i: F.struct(F.ceil(F.get("_xs", i) - 0.5).alias("first"), (F.ceil(F.get("_xs", i + 1) - 0.5) - 1).alias("last")))
    inside = lined.where(F.size("_xs") > 1).select(key, "row", F.explode(pairs).alias("_p")).select(key, "row", "_p.*").where("first <= last")
    runs = joined_runs(touched.union(inside), [key])
    wide = runs.withColumn("_s", _along(F.col("first"), F.col("last"))).withColumn("col", F.explode(F.sequence("_s", F.least(F.col("_s") + FAN - 1, F.col("last")))))
    return wide.select(key, "row", F.col("col").cast("int").alias("col"))


def polygon_pixel_join(polygons: DataFrame, pixels: DataFrame, key: str, geometry: str, x0: float, y0: float, size: float) -> DataFrame:
    """The pixels under each polygon: an equality join on the cell; the cells of the polygons are never broadcast."""
    return polygon_pixels(polygons, key, geometry, x0, y0, size).join(join_side(pixels), ["row", "col"])
