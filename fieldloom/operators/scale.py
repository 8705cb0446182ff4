"""Building blocks that keep a hot key from landing in one task.

A class, a source or a cell may hold a third of all rows.  Numbering rows inside
such a group, or taking its exact median, must not send the group to one task.
Each helper here cuts a group into *slices* along the wanted order, sums up the
slices (a small table) and works inside one slice at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import reliable

SLICE_ROWS = 1_000_000
LEAST_SLICES = 32
FIRST_SLICES = 512
MAX_SLICES = 20_000


def pin_small(df: DataFrame, max_rows: int = 10_000) -> tuple[DataFrame, bool]:
    """Return ``df`` ready to be broadcast if it has at most ``max_rows`` rows.

    At most ``max_rows + 1`` rows reach the driver.  A larger table comes back as
    it was, so that the join shuffles and adaptive skew handling applies.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df, False
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), True


def join_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` ready to meet rows that are written out from few others, on an equality.

    The planner takes such rows to be as small as what they come from and would broadcast them.  ``df`` is written once
    and counted: at most ``max_rows`` rows are broadcast themselves, a larger table meets the others in a sort-merge
    join, whose hot keys can be split.
    """
    held = reliable(df)
    return F.broadcast(held) if held.count() <= max_rows else held.hint("merge")


def slice_bounds(df: DataFrame, column: str, slices: int | None = None) -> list[float]:
    """Cut points splitting the rows of ``df`` into slices of about equal size.

    One pass gives the row count and a first set of cuts; only a table too long
    for those takes a second pass with finer ones.
    """

    def cuts_for(n_slices: int):
        shares = [i / n_slices for i in range(1, n_slices)]
        return F.percentile_approx(F.col(column).cast("double"), shares, 20 * n_slices)

    if slices is not None:
        cuts = df.agg(cuts_for(slices)).first()[0] if slices > 1 else []
        return sorted({float(c) for c in cuts or []})
    n, cuts = df.agg(F.count(column), cuts_for(FIRST_SLICES)).first()
    if n == 0:
        return []
    wanted = min(MAX_SLICES, max(LEAST_SLICES, math.ceil(n / SLICE_ROWS)))
    if wanted > FIRST_SLICES:
        cuts = df.agg(cuts_for(wanted)).first()[0]
        every = 1
    else:
        every = max(1, FIRST_SLICES // wanted)
    return sorted({float(c) for c in cuts[every - 1 :: every]})


def add_slice(df: DataFrame, column: str, bounds: list[float], out: str = "_slice") -> DataFrame:
    """Number of the slice of ``column``; it never falls when the column grows."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    probe = f"{out}_probe"
    cutter = Bucketizer(
        splits=[-math.inf, *bounds, math.inf], inputCol=probe, outputCol=out, handleInvalid="keep"
    )
    tagged = cutter.transform(df.withColumn(probe, F.col(column).cast("double")))
    return tagged.withColumn(out, F.col(out).cast("int")).drop(probe)


def running_before(
    df: DataFrame,
    part: Sequence[str],
    coarse: Sequence[str],
    fine: Sequence[Column],
    measures: dict[str, Column],
) -> DataFrame:
    """Sum of each measure over the rows before this one, ordered by (coarse, fine).

    ``coarse`` are non-null columns that lead the order and cut every partition
    into bounded slices.  Only the slice sums meet in a window per partition.
    """
    cells = [*part, *coarse]
    inside = Window.partitionBy(*cells).orderBy(*fine).rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        Window.partitionBy(*part).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = df.groupBy(*cells).agg(*[F.sum(m).alias(f"_{k}") for k, m in measures.items()])
    offsets = sums.select(
        *cells, *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in measures]
    )
    local = df.select(
        "*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_in_{k}") for k, m in measures.items()]
    )
    joined = local.join(offsets, cells)
    keep = [F.col(f"`{c}`") for c in df.columns]
    return joined.select(*keep, *[(F.col(f"_in_{k}") + F.col(f"_{k}")).alias(k) for k in measures])


def number_rows(
    df: DataFrame,
    part: Sequence[str],
    coarse: Sequence[str],
    fine: Sequence[Column],
    out: str = "rn",
) -> DataFrame:
    """Exact ``row_number`` (from 1) per partition without one task per partition.

    Rows with a null partition key must be removed first.
    """
    numbered = running_before(df, part, coarse, fine, {out: F.lit(1)})
    return numbered.withColumn(out, (F.col(out) + 1).cast("bigint"))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    slices: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, for groups of any size.

    Slices are cut along the value over all rows, so no (group, slice) holds more
    than one slice's share.  Equal values are counted before they are shuffled.
    The slice sums tell which slices hold the wanted ranks; only those are sorted.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    tagged = add_slice(rows, "_v", slice_bounds(rows, "_v", slices))
    counts = tagged.groupBy(*keys, "_slice", "_v").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # the same counts again, so the engine reuses their shuffle
    per_slice = (
        counts.groupBy(*keys, "_slice")
        .agg(F.sum("_n").alias("_n"))
        .select(
            *keys,
            "_slice",
            F.col("_n").alias("_in_slice"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias("_total"),
        )
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(side).alias("side"),
                (F.floor if side == "lo" else F.ceil)(F.lit(q) * (F.col("_total") - 1)).alias("rank"),
            )
            for name, q in quantiles.items()
            for side in ("lo", "hi")
        ]
    )
    targets = (
        per_slice.withColumn("_w", F.explode(wanted))
        .where(
            (F.col("_w.rank") >= F.col("_before"))
            & (F.col("_w.rank") < F.col("_before") + F.col("_in_slice"))
        )
        .groupBy(*keys, "_slice", "_before", "_total")
        .agg(F.collect_list("_w").alias("_ws"))
    )
    t, c = targets.alias("t"), counts.alias("c")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "_slice"]]
    held = c.join(t, same).select(
        *[F.col(f"c.{k}").alias(k) for k in [*keys, "_slice", "_v", "_n"]],
        *[F.col(f"t.{k}") for k in ("_before", "_total", "_ws")],
    )
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = held.withColumn(
        "_at", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    hits = placed.withColumn(
        "_hit",
        F.filter("_ws", lambda w: (w["rank"] >= F.col("_at")) & (w["rank"] < F.col("_at") + F.col("_n"))),
    ).where(F.size("_hit") > 0)
    flat = hits.select(*keys, "_total", "_v", F.explode("_hit").alias("_h"))
    ends = flat.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[
            F.max(F.when((F.col("_h.name") == name) & (F.col("_h.side") == side), F.col("_v"))).alias(
                f"_{name}_{side}"
            )
            for name in quantiles
            for side in ("lo", "hi")
        ],
    )
    out = []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("_total") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return ends.select(*keys, *out)


def group_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    hot_rows: int = 5_000_000,
    slices: int | None = None,
    biggest: int | None = None,
) -> DataFrame:
    """Exact median per group; groups above ``hot_rows`` rows go slice by slice.

    ``biggest`` is the largest group's row count where the caller knows it.
    """
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    if biggest is None:
        biggest = counts.agg(F.max("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > hot_rows).select(*keys)
    if biggest <= hot_rows:
        return df.groupBy(*keys).agg(F.median(value).alias(out))
    hot, _ = pin_small(hot)
    r, h = df.alias("r"), hot.alias("h")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    cold_rows = r.join(h, same, "left_anti")
    hot_rows_df = r.join(h, same, "left_semi")
    cold = cold_rows.groupBy(*keys).agg(F.median(value).alias(out))
    return cold.unionByName(group_quantiles(hot_rows_df, keys, value, {out: 0.5}, slices))
