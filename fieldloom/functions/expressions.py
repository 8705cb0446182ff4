"""Scalar expressions: indices, masks, recodes, text and dates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND_SCALE = 10_000
CLOUD_PROBABILITY = 50
DARK_NIR = 0.15
WATER_CLASS = 6

# Field size words to metres; fixed values.
FIELD_SIZE_METRES = {
    "Small": 5,
    "Medium": 10,
    "Large": 20,
    "small": 5,
    "medium": 10,
    "large": 20,
    "none": 5,
    "poor": 5,
    "no_stress": 5,
    "heat_damage": 5,
}
FIELD_SIZE_UNKNOWN = 10


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal_map(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs.items())])


# --- band maths -----------------------------------------------------------


def scale_by(c: str | Column, factor: float) -> Column:
    return _col(c) * F.lit(factor)


def evi(nir: str | Column, red: str | Column, blue: str | Column) -> Column:
    """Enhanced vegetation index of integer-coded reflectance."""
    n, r, b = (_col(c) / BAND_SCALE for c in (nir, red, blue))
    return F.try_divide(2.5 * (n - r), n + 6 * r - 7.5 * b + 1)


def hue(red: str | Column, green: str | Column, blue: str | Column) -> Column:
    """Hue in [0, 1); 0 for grey."""
    r, g, b = (_col(c) / BAND_SCALE for c in (red, green, blue))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sextant = (
        F.when(top == r, F.try_divide(g - b, span))
        .when(top == g, 2 + F.try_divide(b - r, span))
        .otherwise(4 + F.try_divide(r - g, span))
    )
    turned = sextant / 6
    return F.when(span == 0, 0.0).otherwise(turned - F.floor(turned))


def is_cloud(probability: str | Column, limit: float = CLOUD_PROBABILITY) -> Column:
    return _col(probability) > limit


def is_dark(nir: str | Column, scene_class: str | Column, limit: float = DARK_NIR) -> Column:
    """Dark near-infrared and not water: a possible shadow."""
    return (_col(nir) < limit * BAND_SCALE) & (_col(scene_class) != WATER_CLASS)


def apply_mask(value: str | Column, masked: str | Column) -> Column:
    return F.when(~_col(masked), _col(value))


# --- recodes --------------------------------------------------------------


def recode(c: str | Column, pairs: Mapping) -> Column:
    """Replace listed values; the others stay."""
    c = _col(c)
    return F.coalesce(_literal_map(pairs)[c], c)


def map_values(c: str | Column, pairs: Mapping, null_value=None) -> Column:
    """Replace listed values; the others become null."""
    c = _col(c)
    mapped = _literal_map(pairs)[c]
    return mapped if null_value is None else F.when(c.isNull(), F.lit(null_value)).otherwise(mapped)


def field_size_metres(c: str | Column) -> Column:
    """Size word to metres; numbers pass, null becomes the default size."""
    c = _col(c).cast("string")
    known = map_values(c, FIELD_SIZE_METRES).cast("double")
    return F.when(c.isNull(), F.lit(float(FIELD_SIZE_UNKNOWN))).otherwise(
        F.coalesce(known, c.try_cast("double"))
    )


def coalesce_layers(own: Column, second: Column, third: Column, literal: bool = False) -> Column:
    """Own value, else the second layer's, else the third's.

    ``literal`` leaves the third layer out, for the size column whose fill from
    that layer the original workflow computes and throws away.
    """
    return F.coalesce(own, second) if literal else F.coalesce(own, second, third)


def keep_drop_other(
    df: DataFrame,
    c: str,
    keep: Iterable[str],
    drop: Iterable[str],
    drop_other: bool = False,
    other: str = "Other",
) -> DataFrame:
    """Remove dropped classes, fold the rest outside ``keep`` (and null) into one."""
    left = df.where(F.col(c).isNull() | ~F.col(c).isin(list(drop)))
    folded = left.withColumn(c, F.when(F.col(c).isin(list(keep)), F.col(c)).otherwise(F.lit(other)))
    return folded.where(F.col(c) != other) if drop_other else folded


def not_equal_or_null(c: str | Column, value) -> Column:
    """True unless equal; null counts as different."""
    return ~_col(c).eqNullSafe(F.lit(value))


# --- names ----------------------------------------------------------------


def excludes(c: str | Column, parts: Iterable[str], regex: bool = False) -> Column:
    """No part is contained in the name (literal text, or patterns)."""
    c, out = _col(c), F.lit(True)
    for part in parts:
        out = out & ~(c.rlike(part) if regex else c.contains(part))
    return out


def display_name(c: str | Column) -> Column:
    """Feature name with dots for underscores, as printed in charts."""
    return F.replace(_col(c), F.lit("_"), F.lit("."))


def strip_layer_suffix(c: str | Column) -> Column:
    """Drop a closing ``_0`` only; a ``_0`` inside a parameter stays."""
    return F.regexp_replace(_col(c), "_0$", "")


# --- dates ----------------------------------------------------------------


def month_start(c: str | Column) -> Column:
    return F.trunc(_col(c), "month")


def month_end(c: str | Column) -> Column:
    return F.last_day(_col(c))


def month_key(c: str | Column) -> Column:
    return F.date_format(_col(c), "MMyyyy")


def month_number(name: str | Column) -> Column:
    """Short English month name to 1..12."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    at = F.array_position(names, _col(name))
    return F.when(at > 0, at).cast("int")


# Month names in calendar order; fixed values.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def month_span_days(start: Column, end: Column, year: int) -> Column:
    """Days from the first of the start month to the last of the end month."""
    first = F.make_date(F.lit(year), month_number(start), F.lit(1))
    last = F.last_day(F.make_date(F.lit(year), month_number(end), F.lit(1)))
    return F.datediff(last, first)


def months_between_names(start: Column, end: Column) -> Column:
    """Month numbers covered; empty when the interval runs over the year's end."""
    s, e = month_number(start), month_number(end)
    return F.when(s <= e, F.sequence(s, e)).otherwise(F.array().cast("array<int>"))


def category_rank(c: str | Column, order: list[str]) -> Column:
    """Position in an ordered category list; unknown values are null."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), _col(c))
    return F.when(at > 0, at).cast("int")


def parse_estimate(c: str | Column) -> tuple[Column, Column]:
    """``"0.83 ± 0.01"`` to estimate and error."""
    parts = F.split(_col(c), " ± ")
    return parts[0].cast("double"), parts[1].cast("double")
