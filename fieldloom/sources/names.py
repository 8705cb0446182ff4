"""What layer file names say: band, month, grid tile, feature."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layer name patterns; fixed values.
GRID = r"(\d+-\d+(?:-part[12])?)\.tif$"
BAND = r"S2_SR_([A-Za-z0-9]+)_M_"
MONTH = r"_M_(\d{4}[-_]\d{2})"
TILE_SUFFIX = r"_\d{10}-\d{10}(-part\d+)?$"


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def filename_meta(df: DataFrame, path: str) -> DataFrame:
    """Band, month and grid of each row's own file name; null where absent."""
    c = F.col(path)
    month = F.replace(_found(c, MONTH), F.lit("_"), F.lit("-"))
    return df.select(
        "*",
        _found(c, BAND).alias("band"),
        F.to_date(F.try_to_timestamp(month, F.lit("yyyy-MM"))).alias("month"),
        _found(c, GRID).alias("grid"),
    )


def feature_of_layer(c: Column) -> Column:
    """File name without folder, extension and last underscore part."""
    base = F.element_at(F.split(c, "/"), -1)
    stem = F.substring_index(base, ".", 1)
    return F.regexp_replace(stem, "_[^_]*$", "")


def clean_name(name: str) -> str:
    """Column name without its tile suffix; a bare suffix is left alone."""
    return re.sub(r"^(.+?)" + TILE_SUFFIX, r"\1", name)


def clean_columns(df: DataFrame) -> DataFrame:
    """Strip tile suffixes; columns that end up with one name are coalesced."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(clean_name(c), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(n) for n, cs in groups.items()])


def clean_name_column(c: Column) -> Column:
    """The same rule on names held as values."""
    return F.regexp_replace(c, "^(.+?)" + TILE_SUFFIX, "$1")


def matching_columns(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose whole name matches."""
    return df.select(df.colRegex(f"`{pattern}`"))


def pending(wanted: DataFrame, done: DataFrame, by: Iterable[str], min_bytes: int | None = None) -> DataFrame:
    """Outputs not written yet; a finished one counts only above ``min_bytes``."""
    finished = done if min_bytes is None else done.where(F.col("bytes") > min_bytes)
    return wanted.join(finished.select(*by), list(by), "left_anti")
