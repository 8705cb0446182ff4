"""Points, discs, grids and one projection as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# WGS 84 ellipsoid and the UTM zone of the region (36 south); fixed values.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE_FACTOR = 0.9996
FALSE_EASTING = 500_000.0
FALSE_NORTHING = 10_000_000.0
CENTRAL_MERIDIAN = 33.0


def _series() -> dict[str, list[float] | float]:
    """Third-order Krüger coefficients of the transverse Mercator projection."""
    n = FLATTENING / (2 - FLATTENING)
    return {
        "n": n,
        "radius": SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "alpha": [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240],
        "beta": [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480],
        "delta": [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15],
    }


KRUEGER = _series()


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude/latitude in degrees to easting/northing in metres."""
    k = KRUEGER
    e = 2 * math.sqrt(k["n"]) / (1 + k["n"])
    phi, lam = F.radians(lat), F.radians(lon - CENTRAL_MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi0 = F.atan2(t, F.cos(lam))
    eta0 = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, a in enumerate(k["alpha"], start=1):
        xi = xi + F.lit(a) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + F.lit(a) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    reach = SCALE_FACTOR * k["radius"]
    return FALSE_EASTING + F.lit(reach) * eta, FALSE_NORTHING + F.lit(reach) * xi


def from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    """Easting/northing in metres to longitude/latitude in degrees."""
    k = KRUEGER
    reach = SCALE_FACTOR * k["radius"]
    xi, eta = (y - FALSE_NORTHING) / reach, (x - FALSE_EASTING) / reach
    xi0, eta0 = xi, eta
    for j, b in enumerate(k["beta"], start=1):
        xi0 = xi0 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, d in enumerate(k["delta"], start=1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta0), F.cos(xi0))
    return F.degrees(lam) + CENTRAL_MERIDIAN, F.degrees(phi)


# --- points as binary text --------------------------------------------------

POINT_HEX_LENGTH = 42


XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


@F.pandas_udf(XY)
def point_from_hex(texts: pd.Series) -> pd.DataFrame:
    """Little-endian WKB point in hex to x and y; anything else gives nulls."""
    good = texts.fillna("").str.fullmatch(r"0101000000[0-9A-Fa-f]{32}")
    out = np.full((len(texts), 2), np.nan)
    if good.any():
        raw = bytes.fromhex("".join(t[10:] for t in texts[good]))
        out[good.to_numpy()] = np.frombuffer(raw, dtype="<f8").reshape(-1, 2)
    frame = pd.DataFrame(out, columns=["x", "y"], index=texts.index).astype(object)
    return frame.where(good, None)


@F.pandas_udf(T.StringType())
def point_to_hex(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """x and y to a little-endian WKB point in upper-case hex."""
    pairs = np.column_stack([xs.to_numpy("<f8"), ys.to_numpy("<f8")])
    text = pairs.astype("<f8").tobytes().hex().upper()
    out = pd.Series(["0101000000" + text[i : i + 32] for i in range(0, len(text), 32)], index=xs.index)
    return out.where(xs.notna() & ys.notna(), None)


# --- grids ------------------------------------------------------------------


def pixel_of(x: Column, y: Column, x0: float, y0: float, size: float) -> tuple[Column, Column]:
    """Row and column of a coordinate; rows count down from the top edge."""
    return (
        F.floor((F.lit(y0) - y) / size).cast("int"),
        F.floor((x - F.lit(x0)) / size).cast("int"),
    )


def pixel_corner(row: Column, col: Column, x0: float, y0: float, size: float) -> tuple[Column, Column]:
    """Upper left corner of a pixel."""
    return F.lit(x0) + col * size, F.lit(y0) - row * size


def square_of(x: Column, y: Column, x0: float, y0: float, side: float) -> tuple[Column, Column]:
    return F.floor((x - x0) / side).cast("bigint"), F.floor((y - y0) / side).cast("bigint")


def hex_of(x: Column, y: Column, x0: float, y0: float, side: float) -> tuple[Column, Column]:
    """Column and row of the flat-top hexagon holding a point.

    Columns lie 1.5 sides apart; odd columns are shifted down by half a hexagon.
    """
    q = (x - x0) * F.lit(2 / 3) / side
    r = (-(x - x0) / 3 + F.lit(math.sqrt(3) / 3) * (y - y0)) / side
    s = -q - r
    rq, rr, rs = (F.floor(c + 0.5) for c in (q, r, s))
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    cq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    cr = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    odd = F.pmod(cq, F.lit(2))
    return cq.cast("bigint"), (cr + (cq + odd) / 2).cast("bigint")


def hex_centre(col: Column, row: Column, x0: float, y0: float, side: float) -> tuple[Column, Column]:
    shift = F.when(F.pmod(col, F.lit(2)) == 1, 0.5).otherwise(0.0)
    return F.lit(x0) + col * (1.5 * side), F.lit(y0) + (row - shift) * (math.sqrt(3) * side)


def hex_grid(bounds: DataFrame, side: float, pad: float = 20) -> DataFrame:
    """Centres of all flat-top hexagons over a one-row table of bounds."""
    b = bounds.select(*[F.col(c) + (pad if c.startswith("max") else -pad) for c in BOUNDS])
    b = b.toDF(*BOUNDS)
    cols = F.ceil((F.col("max_x") - F.col("min_x")) / (1.5 * side)).cast("int")
    rows = F.ceil((F.col("max_y") - F.col("min_y")) / (math.sqrt(3) * side)).cast("int")
    wide = b.select("*", F.explode(F.sequence(F.lit(0), cols)).alias("hex_col"))
    odd = F.pmod(F.col("hex_col"), F.lit(2))
    cells = wide.repartition("hex_col").select("*", F.explode(F.sequence(F.lit(0), rows + odd)).alias("hex_row"))
    return cells.select(
        "hex_col",
        "hex_row",
        (F.col("min_x") + F.col("hex_col") * (1.5 * side)).alias("x"),
        (F.col("min_y") + (F.col("hex_row") - 0.5 * F.pmod(F.col("hex_col"), F.lit(2))) * (math.sqrt(3) * side)).alias("y"),
    )


def square_grid(bounds: DataFrame, side: float, pad: float = 20) -> DataFrame:
    """Lower left corners of all squares over a one-row table of bounds."""
    b = bounds.select(*[F.col(c) + (pad if c.startswith("max") else -pad) for c in BOUNDS])
    b = b.toDF(*BOUNDS)
    count = {a: F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / side).cast("int") for a in "xy"}
    wide = b.select("*", F.explode(F.sequence(F.lit(-1), count["x"])).alias("grid_col"))
    cells = wide.repartition("grid_col").select("*", F.explode(F.sequence(F.lit(-1), count["y"])).alias("grid_row"))
    return cells.select(
        "grid_col",
        "grid_row",
        (F.col("min_x") + F.col("grid_col") * side).alias("x"),
        (F.col("min_y") + F.col("grid_row") * side).alias("y"),
    )


BOUNDS = ["min_x", "min_y", "max_x", "max_y"]
