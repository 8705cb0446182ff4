"""From scenes to cloud-free composites by time slot, as one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.expressions import apply_mask
from fieldloom.operators.grid import CLEAN_RADIUS, GROW_RADIUS, SHADOW_STEPS, clean_mask
from fieldloom.operators.series import encode_band
from fieldloom.session import reliable

COARSE = 10  # fine pixels to a side of a shadow cell: 10 m and 100 m


def coarse_shadow(
    pixels: DataFrame, by: Sequence[str], cloud: str, dark: str, azimuth: str, steps: int = SHADOW_STEPS, coarse: int = COARSE
) -> DataFrame:
    """Adds ``shadow``: dark pixels in a coarse cell on the line cast from a cloudy one away from the sun.

    Clouds are made distinct by coarse cell before they are cast; only dark pixels are looked up.
    """
    placed = pixels.withColumn("_r", F.floor(F.col("row") / coarse).cast("int")).withColumn("_c", F.floor(F.col("col") / coarse).cast("int"))
    turn = F.radians(F.lit(90.0) - F.col(azimuth))
    clouds = placed.where(F.col(cloud)).select(*by, "_r", "_c", turn.alias("_turn")).distinct()
    casts = clouds.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_d")).select(
        *by,
        (F.col("_r") - F.round(F.sin("_turn") * F.col("_d"))).cast("int").alias("_r"),
        (F.col("_c") + F.round(F.cos("_turn") * F.col("_d"))).cast("int").alias("_c"),
        F.lit(True).alias("shadow"),
    )
    looked = placed.where(F.col(dark)).join(casts.distinct(), [*by, "_r", "_c"], "left").withColumn("shadow", F.coalesce("shadow", F.lit(False)))
    clear = placed.where(~F.col(dark)).withColumn("shadow", F.lit(False))
    return clear.unionByName(looked).drop("_r", "_c")


def cloud_free_composite(
    pixels: DataFrame,
    scene: Sequence[str],
    cell: Sequence[str],
    slot: str,
    bands: Mapping[str, Column],
    finish: Column,
    kind: str = "int16",
    steps: int = SHADOW_STEPS,
    coarse: int = COARSE,
    shrink: int = CLEAN_RADIUS,
    grow: int = GROW_RADIUS,
) -> DataFrame:
    """(cell, slot, value): medians of ``bands`` over the clear pixels of all scenes, then ``finish`` of them, encoded.

    ``pixels`` hold row, col, cloud, dark, azimuth and what the bands read.  Clouds and shadows are united
    before the mask is cleaned.  The pixels are written once with their flags; shadow, mask and medians read
    only that.  A cell and slot has one value for each scene at most.
    """
    base = reliable(pixels.select(*dict.fromkeys([*scene, "row", "col", slot, *cell]), "cloud", "dark", "azimuth", *[c.alias(n) for n, c in bands.items()]))
    flagged = reliable(coarse_shadow(base, scene, "cloud", "dark", "azimuth", steps, coarse).withColumn("bad", F.col("cloud") | F.col("shadow")))
    masked = clean_mask(flagged, scene, "bad", shrink, grow)
    medians = masked.groupBy(*cell, slot).agg(*[F.median(apply_mask(n, "cloudmask")).alias(n) for n in bands])
    return medians.select(*cell, slot, encode_band(finish, kind).alias("value"))
