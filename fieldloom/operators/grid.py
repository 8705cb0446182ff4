"""Pixel tables: lookups, masks, mosaics, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.geometry import pixel_of
from fieldloom.operators.scale import join_side
from fieldloom.session import reliable

SHADOW_STEPS = 20
CLEAN_RADIUS = 2
GROW_RADIUS = 18


def point_pixel_join(
    points: DataFrame, pixels: DataFrame, x0: float, y0: float, size: float, how: str = "left"
) -> DataFrame:
    """Value of the pixel under each point.

    Pixels are first cut to the cells that have points: a semi join from the pixels,
    whose other side Spark broadcasts when it measures small, so that pixels are not
    shuffled.  The few that are left meet the points.
    """
    row, col = pixel_of(F.col("x"), F.col("y"), x0, y0, size)
    placed = points.select("*", row.alias("row"), col.alias("col"))
    hit = pixels.join(placed.select("row", "col"), ["row", "col"], "left_semi")
    return placed.join(hit, ["row", "col"], how)


def disc_pixels(points: DataFrame, key: str, radius: str, x0: float, y0: float, size: float) -> DataFrame:
    """Every cell a point's disc reaches into, as rows (key, row, col)."""
    r = F.col(radius)
    first_row, first_col = pixel_of(F.col("x") - r, F.col("y") + r, x0, y0, size)
    last_row, last_col = pixel_of(F.col("x") + r, F.col("y") - r, x0, y0, size)
    rows = points.select(
        key, "x", "y", r.alias("_r"), first_col.alias("_c0"), last_col.alias("_c1"),
        F.explode(F.sequence(first_row, last_row)).alias("row"),
    )
    # the nearest height of the row band leaves a half width of columns
    top, bottom = F.lit(y0) - F.col("row") * size, F.lit(y0) - (F.col("row") + 1) * size
    near_y = F.least(F.greatest(F.col("y"), bottom), top)
    cells = rows.withColumn("_dy", near_y - F.col("y")).select(
        key, "x", "_r", "_dy", "row", F.explode(F.sequence("_c0", "_c1")).alias("col")
    )
    left = F.lit(x0) + F.col("col") * size
    near_x = F.least(F.greatest(F.col("x"), left), left + size)
    dx = near_x - F.col("x")
    return cells.where(dx * dx + F.col("_dy") * F.col("_dy") < F.col("_r") * F.col("_r")).select(key, "row", "col")


def disc_pixel_join(
    points: DataFrame, pixels: DataFrame, key: str, radius: str, x0: float, y0: float, size: float
) -> DataFrame:
    """The pixels in each disc; the cells of the discs are never broadcast."""
    return disc_pixels(points, key, radius, x0, y0, size).join(join_side(pixels), ["row", "col"])


def bbox_filter(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    left, bottom, right, top = box
    return points.where(F.col("x").between(left, right) & F.col("y").between(bottom, top))


def window_filter(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return pixels.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def with_tile(df: DataFrame, tile_px: int, row: str = "row", col: str = "col") -> DataFrame:
    return df.withColumn("tile_row", F.floor(F.col(row) / tile_px).cast("int")).withColumn(
        "tile_col", F.floor(F.col(col) / tile_px).cast("int")
    )


def tiles_with_points(tiles: DataFrame, points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tiles that hold at least one point; point tiles are made distinct first."""
    return tiles.join(points.select(*by).distinct(), list(by), "left_semi")


def tile_halves(tiles: DataFrame, x: str, left: str, right: str, wide: str | None = None) -> DataFrame:
    """Part label of a pixel in a tile cut at its middle; 0 where the tile stays whole."""
    part = F.when(F.col(x) < (F.col(left) + F.col(right)) / 2, 1).otherwise(2)
    return tiles.withColumn("part", part if wide is None else F.when(F.col(wide), part).otherwise(0))


def mosaic_max(layers: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Largest value where tiles overlap; combined before the shuffle."""
    stacked = layers[0]
    for layer in layers[1:]:
        stacked = stacked.unionByName(layer)
    return stacked.groupBy(*keys).agg(F.max(value).alias(value))


def resample_nearest(pixels: DataFrame, factor: int = 2) -> DataFrame:
    """Each coarse cell to factor x factor fine cells."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    tall = pixels.withColumn("_i", F.explode(steps))
    wide = tall.withColumn("_j", F.explode(steps))
    return (
        wide.withColumn("row", F.col("row") * factor + F.col("_i"))
        .withColumn("col", F.col("col") * factor + F.col("_j"))
        .drop("_i", "_j")
    )


def cloud_shadow(
    pixels: DataFrame, by: Sequence[str], cloud: str, dark: str, azimuth: str, steps: int = SHADOW_STEPS
) -> DataFrame:
    """Flag dark pixels on the line cast from a cloud pixel away from the sun.

    The direction is 90 degrees minus the sun's azimuth, in grid steps; ``by``
    names the scene.  Every cloud pixel gives at most ``steps`` cells.
    """
    turn = F.radians(F.lit(90.0) - F.col(azimuth))
    casts = pixels.where(F.col(cloud)).select(
        *by, "row", "col", turn.alias("_turn"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_d")
    )
    shade = casts.select(
        *by,
        (F.col("row") - F.round(F.sin("_turn") * F.col("_d"))).cast("int").alias("row"),
        (F.col("col") + F.round(F.cos("_turn") * F.col("_d"))).cast("int").alias("col"),
    ).distinct()
    hit = shade.withColumn("_cast", F.lit(True))
    joined = pixels.join(hit, [*by, "row", "col"], "left")
    return joined.withColumn("shadow", F.coalesce("_cast", F.lit(False)) & F.col(dark)).drop("_cast")


# --- mask shapes ------------------------------------------------------------------


def _runs(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unbroken column runs per row: (by, row, first, last)."""
    line = Window.partitionBy(*by, "row").orderBy("col")
    marked = cells.select(*by, "row", "col", (F.col("col") - F.row_number().over(line)).alias("_run"))
    return marked.groupBy(*by, "row", "_run").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("_run")


def _grown(cells: DataFrame, by: Sequence[str], radius: int) -> DataFrame:
    """Cells within ``radius`` of the given ones, as distinct rows.

    Works on runs: each run gives 2r+1 longer runs, overlapping runs of a row are
    joined, and only the result is written out as cells.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = _runs(cells, by).select("*", F.explode(steps).alias("_dy"))
    half = F.floor(F.sqrt(F.lit(radius * radius) - F.col("_dy") * F.col("_dy"))).cast("int")
    runs = spread.select(
        *by,
        (F.col("row") + F.col("_dy")).alias("row"),
        (F.col("first") - half).alias("first"),
        (F.col("last") + half).alias("last"),
    )
    return joined_runs(runs, by).select(*by, "row", F.explode(F.sequence("first", "last")).alias("col"))


def joined_runs(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs (by, row, first, last) of columns; those of a row that overlap or meet become one."""
    line = Window.partitionBy(*by, "row").orderBy("first", "last")
    reach = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("_new", F.when(F.col("first") > F.coalesce(reach + 1, F.col("first") - 1), 1).otherwise(0))
    islands = opened.withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "row", "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")


def dilate(pixels: DataFrame, by: Sequence[str], flag: str, radius: int, out: str) -> DataFrame:
    """Flag every pixel of the table within ``radius`` of a flagged one."""
    grown = _grown(pixels.where(F.col(flag)), by, radius).withColumn("_near", F.lit(True))
    joined = pixels.join(grown, [*by, "row", "col"], "left")
    return joined.withColumn(out, F.coalesce("_near", F.lit(False))).drop("_near")


def erode(pixels: DataFrame, by: Sequence[str], flag: str, radius: int, out: str) -> DataFrame:
    """Keep flags with no unflagged pixel within ``radius``; cells outside the table do not count."""
    away = _grown(pixels.where(~F.col(flag)), by, radius).withColumn("_near", F.lit(True))
    joined = pixels.join(away, [*by, "row", "col"], "left")
    return joined.withColumn(out, F.col(flag) & F.col("_near").isNull()).drop("_near")


def clean_mask(
    pixels: DataFrame, by: Sequence[str], flag: str, shrink: int = CLEAN_RADIUS, grow: int = GROW_RADIUS
) -> DataFrame:
    """Remove small patches, then widen what is left.

    The shrunk mask is read twice, so it is written once; else the input would be made four times.
    """
    small = reliable(erode(pixels, by, flag, shrink, "_eroded"), "eroded")
    return dilate(small, by, "_eroded", grow, "cloudmask").drop("_eroded")


