"""Folds, per-class samples and sample points, all repeatable on any layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.draws import draw, draw_of, draw_slice, uniform
from fieldloom.operators.scale import number_rows, pin_small


def _slices(df: DataFrame) -> int:
    """Slices of a uniform draw; any number gives the same result."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sample_per_class(df: DataFrame, label: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` random rows of each class, all of them if the class is smaller.

    A first cut takes ``n`` of each class and salt, so no class is sorted by one task, whatever ``n`` is.
    """
    drawn = df.where(F.col(label).isNotNull()).withColumn("_draw", draw(seed, key))
    order = [F.col("_draw"), F.col(key)]
    salted = drawn.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(_slices(df))))
    first = Window.partitionBy(label, "_salt").orderBy(*order)
    drawn = salted.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= n).drop("_salt", "_nth")
    nth = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return drawn.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_draw", "_nth")


def stratified_folds(
    df: DataFrame, label: str, key: str, folds: int, seed: int = 0, out: str = "fold"
) -> DataFrame:
    """Random fold per row, each class dealt round the folds.

    The deal needs the exact position inside a class, so positions are taken per
    (class, slice of the draw) and shifted by the earlier slices' sizes.
    """
    drawn = df.where(F.col(label).isNotNull()).withColumn("_draw", draw(seed, key))
    sliced = drawn.withColumn("_slice", draw_slice(F.col("_draw"), _slices(df)))
    numbered = number_rows(sliced, [label], ["_slice"], [F.col("_draw"), F.col(key)], "_nth")
    fold = F.pmod(F.col("_nth") - 1, F.lit(folds)).cast("int")
    return numbered.withColumn(out, fold).drop("_draw", "_slice", "_nth")


def fold_rounds(df: DataFrame, label: str, key: str, folds: int, rounds: int, out: str = "folds") -> DataFrame:
    """The folds of several rounds as one array per row; round ``i`` uses seed ``i``.

    All rounds are numbered in one pass over (key, class), without the features.
    """
    names = df.where(F.col(label).isNotNull()).select(key, label)
    each = names.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    text = F.concat_ws(":", F.col("_round"), F.col(key))
    drawn = each.withColumn("_draw", draw_of(text))
    sliced = drawn.withColumn("_slice", draw_slice(F.col("_draw"), _slices(df)))
    numbered = number_rows(sliced, [label, "_round"], ["_slice"], [F.col("_draw"), F.col(key)], "_nth")
    fold = F.pmod(F.col("_nth") - 1, F.lit(folds)).cast("int")
    per_row = numbered.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("_round").alias("r"), fold.alias("f")))), lambda s: s["f"]
        ).alias(out)
    )
    return df.join(per_row, key)


def group_fold_table(
    df: DataFrame, group: str, label: str, folds: int, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """One fold per group: groups of a main class, largest first, dealt in snake order."""
    # both null filters stand here, so that the two uses of the group table share its shuffles
    known = df.where(F.col(label).isNotNull() & F.col(group).isNotNull())
    pairs = known.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    groups = pairs.groupBy(group).agg(
        F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("_main"),
        F.sum("_n").alias("_size"),
    )
    drawn = groups.withColumn("_draw", draw(seed, group)).select(
        "*", (-F.col("_size")).alias("_lead"), draw_slice(F.col("_draw"), _slices(df)).alias("_slice")
    )
    numbered = number_rows(
        drawn, ["_main"], ["_lead", "_slice"], [F.col("_draw"), F.col(group)], "_nth"
    )
    turn = F.pmod(F.col("_nth") - 1, F.lit(2 * folds))
    snake = F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("int")
    return numbered.select(group, snake.alias(out))


def group_folds(
    df: DataFrame, group: str, label: str, folds: int, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Fold per row such that no group lies in two folds."""
    return df.join(group_fold_table(df, group, label, folds, seed, out), group)


# --- discs --------------------------------------------------------------------


def buffer_boxes(points: DataFrame, radius: str, x: str = "x", y: str = "y") -> DataFrame:
    """Box corners of each point's disc and the number of samples wanted in it."""
    r = F.col(radius)
    return points.select(
        "*",
        (F.col(x) - r).alias("min_x"),
        (F.col(y) - r).alias("min_y"),
        (F.col(x) + r).alias("max_x"),
        (F.col(y) + r).alias("max_y"),
        F.floor(r / 5).cast("int").alias("sample"),
    )


def disc_sample(
    points: DataFrame, key: str, radius: str, seed: int = 42, original_group: str = "shared"
) -> DataFrame:
    """``radius // 5`` uniform points in each disc, plus the original points.

    Samples carry their polygon's number (from 1, by key) as ``sample_id``.  The
    originals carry 0, one group for all of them, or their polygon's own number.
    """
    from fieldloom.operators.tables import row_index

    numbered = row_index(points, key, "_number", start=1)
    rest = [c for c in points.columns if c not in ("x", "y")]
    wanted = F.floor(F.col(radius) / 5).cast("int")
    each = numbered.where(wanted > 0).select(
        *rest, "x", "y", "_number", wanted.alias("sample"), F.explode(F.sequence(F.lit(1), wanted)).alias("_i")
    )
    reach = F.col(radius) * F.sqrt(uniform(f"{seed}:r", key, "_i"))
    angle = F.lit(2 * math.pi) * uniform(f"{seed}:a", key, "_i")
    drawn = each.select(
        *rest,
        (F.col("x") + reach * F.cos(angle)).alias("x"),
        (F.col("y") + reach * F.sin(angle)).alias("y"),
        "sample",
        F.col("_number").alias("sample_id"),
    )
    own: Column = F.lit(0).cast("bigint") if original_group == "shared" else F.col("_number")
    kept = numbered.select(*rest, "x", "y", F.lit(0).alias("sample"), own.alias("sample_id"))
    return kept.unionByName(drawn)


def shuffle_split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Stratified test flag: the first ``share`` of each class in draw order."""
    drawn = df.where(F.col(label).isNotNull()).withColumn("_draw", draw(seed, key))
    sliced = drawn.withColumn("_slice", draw_slice(F.col("_draw"), _slices(df)))
    numbered = number_rows(sliced, [label], ["_slice"], [F.col("_draw"), F.col(key)], "_nth")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    return (
        numbered.join(pin_small(sizes)[0], label)
        .withColumn("is_test", F.col("_nth") <= F.round(F.col("_size") * share))
        .drop("_draw", "_slice", "_nth", "_size")
    )


