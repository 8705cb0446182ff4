"""Isolation forest per class.

A tree needs at most a few hundred rows, so trees are built from bounded samples
in parallel tasks; scoring runs over all rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Transformer
from pyspark.ml.param import Params
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.scale import group_quantiles, pin_small
from fieldloom.session import reliable

#: Rows of a class that meet one copy of its forest in a task.
BLOCK_ROWS = 32_768
EULER = 0.5772156649015329


def average_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth); feature -1 marks a leaf."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        at = len(nodes)
        if parent >= 0:
            f, cut, left, right, d = nodes[parent]
            nodes[parent] = (f, cut, left, at, d) if is_right else (f, cut, at, right, d)
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append((-1, 0.0, -1, -1, depth + average_depth(len(rows))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = part[:, f] < cut
        nodes.append((f, cut, -1, -1, float(depth)))
        todo.append((rows[~goes_left], depth + 1, at, True))
        todo.append((rows[goes_left], depth + 1, at, False))
    return nodes


def bounded_samples(df: DataFrame, key: str, label: str, trees: int, sample: int, seed: int) -> DataFrame:
    """Rows of every (class, tree): at most ``sample`` each.

    A row joins a tree if their draw is below 2 * sample / class size; of those the
    ``sample`` smallest draws stay.  One rule for classes of any size; a row is only
    multiplied by the trees it joins.
    """
    sizes, _ = pin_small(df.groupBy(label).agg(F.count(F.lit(1)).alias("_size")))
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("_size"))
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    draws = F.transform(numbers, lambda t: F.struct((F.xxhash64(F.lit(seed), F.col(key), t) / F.lit(2.0**64) + 0.5).alias("draw"), t.alias("tree")))
    joins = df.join(sizes, label).withColumn("_joins", F.filter(draws, lambda d: d["draw"] < share))
    each = joins.select(key, label, "features", F.explode("_joins").alias("_j")).select(key, label, "features", "_j.*")
    nth = F.row_number().over(Window.partitionBy(label, "tree").orderBy("draw", key))
    return each.withColumn("_nth", nth).where(F.col("_nth") <= sample).select(key, label, "tree", "features")


def build_forests(df: DataFrame, key: str, label: str, trees: int, sample: int, seed: int) -> DataFrame:
    """Node rows of all trees of all classes."""
    samples = bounded_samples(df, key, label, trees, sample, seed)
    schema = T.StructType(
        [
            T.StructField(label, df.schema[label].dataType),
            T.StructField("tree", T.IntegerType()),
            T.StructField("rows", T.IntegerType()),
            T.StructField("feature", T.ArrayType(T.IntegerType())),
            T.StructField("threshold", T.ArrayType(T.DoubleType())),
            T.StructField("left", T.ArrayType(T.IntegerType())),
            T.StructField("right", T.ArrayType(T.IntegerType())),
            T.StructField("depth", T.ArrayType(T.DoubleType())),
        ]
    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        name, tree = pdf[label].iloc[0], int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree, zlib.crc32(str(name).encode())])
        x = np.vstack(pdf["features"].to_numpy())
        nodes = grow(x, rng, math.ceil(math.log2(max(sample, 2))))
        feature, threshold, left, right, depth = (list(c) for c in zip(*nodes))
        return pd.DataFrame(
            {label: [name], "tree": [tree], "rows": [len(pdf)], "feature": [feature], "threshold": [threshold],
             "left": [left], "right": [right], "depth": [depth]}
        )

    return samples.groupBy(label, "tree").applyInPandas(build, schema)


def _depths(x: np.ndarray, tree: tuple) -> np.ndarray:
    feature, threshold, left, right, depth = tree
    at = np.zeros(len(x), dtype=np.int64)
    open_rows = np.flatnonzero(feature[at] >= 0)
    while len(open_rows):
        node = at[open_rows]
        goes_left = x[open_rows, feature[node]] < threshold[node]
        at[open_rows] = np.where(goes_left, left[node], right[node])
        open_rows = open_rows[feature[at[open_rows]] >= 0]
    return depth[at]


def score(df: DataFrame, forests: DataFrame, key: str, label: str) -> DataFrame:
    """Anomaly score of every row by its class's forest, for any number of classes.

    Rows of a class are dealt by their key's hash to blocks of about ``BLOCK_ROWS``; each block meets its own copy of
    the class's forest (bounded by trees x nodes) in one task.  The features are read once, the label column
    once more for the sizes; nothing passes the driver.  A class without a forest gives a null score.
    """
    blocks = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_blocks"))
    r, b = df.select(key, label, "features").alias("r"), blocks.alias("b")
    rows = r.join(b, F.col(f"r.{label}").eqNullSafe(F.col(f"b.{label}"))).select(
        *[F.col(f"r.{c}").alias(c) for c in (key, label, "features")],
        F.pmod(F.xxhash64(F.col(f"r.{key}")), F.col("b._blocks")).cast("int").alias("_block"),
    )
    f = forests.alias("f")
    dealt = f.join(b, F.col(f"f.{label}").eqNullSafe(F.col(f"b.{label}"))).select(
        "f.*", F.explode(F.sequence(F.lit(0), F.col("b._blocks") - 1)).alias("_block")
    )
    schema = T.StructType([df.schema[key], df.schema[label], T.StructField("score", T.DoubleType())])

    def run(part: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        scores = np.full(len(part), np.nan)
        if len(part) and len(trees):
            x = np.vstack(part["features"].to_numpy())
            trees = trees.sort_values("tree")
            fields = [trees[c] for c in ("feature", "threshold", "left", "right", "depth")]
            total = sum(_depths(x, tuple(np.asarray(v) for v in tree)) for tree in zip(*fields)) / len(trees)
            norm = average_depth(int(trees["rows"].iloc[0]))
            scores = np.power(2.0, -total / norm) if norm > 0 else np.full(len(x), 0.5)
        return pd.DataFrame({key: part[key], label: part[label], "score": scores})

    by = [label, "_block"]
    met = rows.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(run, schema)
    return met.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def class_cuts(scored: DataFrame, label: str, contamination: float) -> DataFrame:
    """(label, cut): the upper quantile of each class's scores; one row a class."""
    return group_quantiles(scored, [label], "score", {"cut": 1.0 - contamination})


def flag(scored: DataFrame, cuts: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, score, is_outlier): scores above their class's cut; a class without a cut has no outliers."""
    s, c = scored.alias("s"), cuts.alias("c")
    met = s.join(c, F.col(f"s.{label}").eqNullSafe(F.col(f"c.{label}")), "left")
    above = F.coalesce(F.col("s.score") > F.col("c.cut"), F.lit(False))
    return met.select(f"s.{key}", f"s.{label}", "s.score", above.alias("is_outlier"))


def isolation_outliers(
    df: DataFrame, key: str, label: str, contamination: float = 0.05, trees: int = 100, sample: int = 256, seed: int = 0
) -> DataFrame:
    """(key, label, score, is_outlier): per class, the rows above the score's upper quantile.

    ``df`` holds an array column ``features`` without nulls.
    """
    forests = reliable(build_forests(df, key, label, trees, sample, seed))
    scored = reliable(score(df, forests, key, label))
    return flag(scored, class_cuts(scored, label, contamination), key, label)


def remove_outliers(df: DataFrame, key: str, label: str, **options) -> DataFrame:
    flagged = isolation_outliers(df, key, label, **options).where("is_outlier").select(key)
    return df.join(flagged, key, "left_anti")


class _Settings(Params):
    """Names of the key and the class column; what the forests are built with."""

    def __init__(self, key: str, label: str, contamination: float = 0.05, **options):
        super().__init__()
        self.key, self.label = key, label
        self.options = {"contamination": contamination, **options}

    @property
    def settings(self) -> dict:
        return {"key": self.key, "label": self.label, **self.options}


class _SettingsWriter(MLWriter):
    """Settings as metadata; the tables of a fitted stage as Parquet beside them."""

    def __init__(self, stage: _Settings):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"settings": self.stage.settings})
        for name, table in self.stage.tables().items():
            table.write.parquet(f"{path}/{name}")


class _SettingsReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in self.kind.TABLES}
        stage = self.kind(**tables, **metadata["settings"])
        stage._resetUid(metadata["uid"])
        return stage


class _Saved(_Settings, MLWritable, MLReadable):
    TABLES: tuple[str, ...] = ()

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.TABLES}

    def write(self) -> MLWriter:
        return _SettingsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SettingsReader(cls)


class OutlierRemover(_Saved, Estimator):
    """Learns a forest and a cut for each class; the fitted stage removes the rows above their class's cut."""

    def _fit(self, dataset: DataFrame) -> "OutlierRemoverModel":
        options = {"trees": 100, "sample": 256, "seed": 0} | self.options
        share = options.pop("contamination")
        forests = reliable(build_forests(dataset, self.key, self.label, **options))
        cuts = reliable(class_cuts(reliable(score(dataset, forests, self.key, self.label)), self.label, share))
        return OutlierRemoverModel(forests=forests, cuts=cuts, **self.settings)


class OutlierRemoverModel(_Saved, Transformer):
    """Node rows and cuts of the classes; judges any rows with the same columns, also after ``save`` and ``load``.

    Rows of classes that the fit has not seen stay, so do rows without a class.  A key stands for its row.
    """

    TABLES = ("forests", "cuts")

    def __init__(self, forests: DataFrame, cuts: DataFrame, key: str, label: str, **options):
        super().__init__(key, label, **options)
        self.forests, self.cuts = forests, cuts

    def flagged(self, dataset: DataFrame) -> DataFrame:
        """(key, label, score, is_outlier) of every row."""
        return flag(score(dataset, self.forests, self.key, self.label), self.cuts, self.key, self.label)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.flagged(dataset).where("is_outlier").select(self.key)
        return dataset.join(out, self.key, "left_anti")
