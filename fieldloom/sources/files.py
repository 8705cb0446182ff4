"""CSV, Parquet and GeoJSON tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.geometry import point_from_hex, point_to_hex
from fieldloom.sources.features import collection_features


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str, name_glob: str | None = None) -> DataFrame:
    """One file, a folder, or the files of a folder whose names match a glob."""
    reader = spark.read
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob).option("recursiveFileLookup", True)
    return reader.parquet(path)


def write_tiles(df: DataFrame, path: str, by: Sequence[str] = ("band", "tile")) -> None:
    """Snappy Parquet, one folder per band and tile; only touched folders are replaced.

    Rows are gathered by the folder keys into partitions of about one size; a large
    tile becomes several of them, as many as its rows need.
    """
    gathered = df.hint("rebalance", *by)
    (
        gathered.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*by)
        .parquet(path)
    )


FEATURE = "struct<type string, geometry struct<type string, coordinates array<double>>, properties {}>"


def read_geojson(
    spark: SparkSession, path: str, properties: str, collection: bool = True
) -> DataFrame:
    """Point features to rows with their properties and x, y.

    ``collection`` reads whole documents with a feature list, in byte ranges of any
    size; otherwise each line is one feature.
    """
    feature = FEATURE.format(properties)
    if collection:
        raw = collection_features(spark, path).select(F.from_json("feature", feature).alias("f")).where("f.type = 'Feature'")
    else:
        raw = spark.read.text(path).select(F.from_json("value", feature).alias("f"))
    at = F.col("f.geometry.coordinates")
    return raw.select("f.properties.*", at[0].alias("x"), at[1].alias("y"))


def feature_lines(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One GeoJSON point feature per row, as text."""
    properties = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (x, y)])
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    feature = F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")
    )
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, mode: str = "error") -> None:
    feature_lines(df).write.mode(mode).text(path)


def load_points(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Hex WKB column to x, y; ``bad_point`` marks rows that are no point."""
    at = df.withColumn("_at", point_from_hex(F.col(geometry)))
    return at.select(
        *[c for c in df.columns if c != geometry],
        F.col("_at.x").alias("x"),
        F.col("_at.y").alias("y"),
        F.col("_at.x").isNull().alias("bad_point"),
    )


def save_points(df: DataFrame, x: str = "x", y: str = "y", out: str = "geometry") -> DataFrame:
    return df.withColumn(out, point_to_hex(F.col(x), F.col(y))).drop(x, y)


def points_from_columns(df: DataFrame, x: str, y: str, srid: int) -> DataFrame:
    """Coordinate columns to the point layout used everywhere here."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (x, y)]
    return df.select(*rest, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(srid).alias("srid"))
