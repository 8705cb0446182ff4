"""Shared pieces of the text operators: words, spans, shared files, connected groups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import checkpoint_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, removed when the driver's JVM ends."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read on from there: lineage ends, columns stay prunable."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other letters as they are; the fast built-in where the text is pure ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-case words: runs of digits, a-z and anything beyond ASCII. Null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def running_total(lengths: Column, block: int = 256) -> Column:
    """Sum of all earlier elements, for each element of an array of longs.

    Appending to an array copies it, so sums are made within blocks and then over blocks.
    """
    long_array = F.array().cast("array<long>")

    def sums(values: Column) -> Column:
        return F.aggregate(
            values,
            F.struct(F.lit(0).cast("long").alias("total"), long_array.alias("seen")),
            lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["seen"], F.array(a["total"])).alias("seen")),
            lambda a: a["seen"],
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) + block - 1) / block).cast("int") - 1),
        lambda i: F.slice(lengths, i * block + 1, block),
    )
    whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
    parts = F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), sums(whole).alias("t")), lambda z: F.transform(sums(z["b"]), lambda x: x + z["t"])))
    return F.when(F.size(lengths) > 0, parts).otherwise(long_array)


def with_found(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Adds ``name``: all leftmost non-overlapping matches as structs (start, text), in code points.

    What lies between the matches gives their places: start = gaps so far + matches so far. The steps are
    columns of their own, so that no match is made twice and texts without a match are not split.
    """
    hits, gaps, ends = f"{name}_hits", f"{name}_gaps", f"{name}_ends"
    nothing = F.array().cast("array<string>")
    df = df.withColumn(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size(hits) > 0
    df = df.withColumn(gaps, F.when(some, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))).otherwise(nothing))
    lengths = F.zip_with(gaps, hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
    df = df.withColumn(ends, F.when(some, running_total(lengths)).otherwise(F.array().cast("array<long>")))
    spans = F.transform(
        F.arrays_zip(F.col(ends).alias("before"), F.col(gaps).alias("gap"), F.col(hits).alias("hit")),
        lambda z: F.struct((z["before"] + F.length(z["gap"])).alias("start"), z["hit"].alias("text")),
    )
    return df.withColumn(name, spans).drop(hits, gaps, ends)


def connected(edges: DataFrame, kind: str) -> DataFrame:
    """Smallest reachable node of every node of ``edges(a, b)``: columns node, label.

    Alternates large-star and small-star steps until the edges stay the same; each step is written to
    the shared folder. A node with very many edges is pre-aggregated, and its join can be split.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large.where("a <> b"), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(small.where("a <> b").distinct(), "small-star")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == seen:
            break
        seen = tuple(row)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return out.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
