"""Composites, gap filling and series statistics."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.series import DEFAULT_FEATURES, READS, build
from fieldloom.operators.scale import group_median, group_quantiles
from fieldloom.session import reliable

#: Slots (rows after the calendar, about 100 bytes each) that a task fills and aggregates.
SLOTS_PER_TASK = 2_000_000
INT16 = (-32768, 32767)
UINT16 = (0, 65535)


def nodata_to_null(value: str | Column, nodata: float = 0) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.nullif(value, F.lit(nodata))


def encode_band(value: Column, kind: str = "int16", nodata: int = 0) -> Column:
    """Null to the nodata mark, clamped to the storage range, truncated to whole numbers."""
    low, high = {"int16": INT16, "uint16": UINT16}[kind]
    clamped = F.least(F.greatest(F.coalesce(value, F.lit(float(nodata))), F.lit(float(low))), F.lit(float(high)))
    return clamped.cast("smallint" if kind == "int16" else "int")


def median_composite(
    pixels: DataFrame,
    cell: Sequence[str],
    band: str,
    slot: str,
    value: str,
    nodata: float | None = 0,
    hot_rows: int = 5_000_000,
    biggest: int | None = None,
) -> DataFrame:
    """One exact median per cell, band and time slot; nodata and nulls are skipped."""
    clean = pixels if nodata is None else pixels.withColumn(value, nodata_to_null(value, nodata))
    return group_median(clean, [*cell, band, slot], value, value, hot_rows, biggest=biggest)


def slot_range(first: dt.date | None, last: dt.date | None, step: str = "day") -> Column:
    """All slots from the first to the last one, as an array column."""
    if first is None:
        return F.array().cast("array<date>")
    if step == "day":
        return F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 DAY"))
    second = (first.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    if second > last:
        return F.array(F.lit(first))
    return F.concat(F.array(F.lit(first)), F.sequence(F.lit(second), F.lit(last), F.expr("INTERVAL 1 MONTH")))


def slot_calendar(table: DataFrame, slot: str, step: str = "day") -> Column:
    """All slots between the first and the last one present."""
    return slot_range(*table.agg(F.min(slot), F.max(slot)).first(), step)


def on_slot_grid(
    composite: DataFrame, keys: Sequence[str], slot: str, value: str, slots: Column
) -> DataFrame:
    """One row per series and slot, null where the composite has no value.

    The composite has one value per slot, so a series is bounded by the calendar.
    """
    held = composite.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(slot), F.col(value)))).alias("_held")
    )
    spread = held.select(*keys, "_held", F.posexplode(slots).alias("pos", slot))
    return spread.select(*keys, slot, "pos", F.col("_held")[F.col(slot)].alias(value))


def interpolate(grid: DataFrame, keys: Sequence[str], value: str, pos: str = "pos") -> DataFrame:
    """Linear gap filling by slot position; the nearest value is held at the edges."""
    by = ", ".join(f"`{k}`" for k in keys)
    over = f"OVER (PARTITION BY {by} ORDER BY `{pos}`)"
    known = f"IF(`{value}` IS NULL, NULL, `{pos}`)"
    looked = grid.select(
        "*",
        F.expr(f"lag(`{value}`) IGNORE NULLS {over}").alias("_v0"),
        F.expr(f"lead(`{value}`) IGNORE NULLS {over}").alias("_v1"),
        F.expr(f"lag({known}) IGNORE NULLS {over}").alias("_p0"),
        F.expr(f"lead({known}) IGNORE NULLS {over}").alias("_p1"),
    )
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (
        (F.col(pos) - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    )
    filled = F.coalesce(F.col(value), between, F.col("_v0"), F.col("_v1"))
    return looked.withColumn(value, filled).drop("_v0", "_v1", "_p0", "_p1")


def with_series_columns(
    series: DataFrame, keys: Sequence[str], slot: str, value: str, pos: str, features: list
) -> DataFrame:
    """Neighbours, mean, ranks and run lengths as columns; only those the features read."""
    reads = set().union(*[READS[f] for f, _ in features])
    lags = {p["lag"] for f, p in features if "lag" in READS[f]}
    if "bend" in reads:
        lags |= {1, 2}
    order = Window.partitionBy(*keys).orderBy("t")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = series.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("x"), F.col(pos).alias("t"), F.dayofyear(slot).alias("doy")
    )
    if "rank" in reads:
        by_value = Window.partitionBy(*keys).orderBy("x")
        everything = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.select(
            "*", (F.row_number().over(by_value) - 1).alias("rank"), F.count("x").over(everything).alias("n")
        )
    low, top = F.min("x").over(whole), F.max("x").over(whole)
    extra = {
        "prev": F.lag("x").over(order),
        "top": top,
        "low": low,
        "sigma": F.stddev_pop("x").over(whole),
    }
    out = rows.select(
        "*",
        # a mean lies between the extremes; rounding must not lift it off a constant series
        F.least(F.greatest(F.avg("x").over(whole), low), top).alias("mu"),
        F.row_number().over(order).alias("_nth"),
        *[F.lead("x", lag).over(order).alias(f"ahead_{lag}") for lag in sorted(lags)],
        *[c.alias(name) for name, c in extra.items() if name in reads],
    )
    runs = []
    for side, broken in (("above", F.col("x") <= F.col("mu")), ("below", F.col("x") >= F.col("mu"))):
        if f"run_{side}" in reads:
            stop = F.last(F.when(broken, F.col("_nth")), ignorenulls=True).over(so_far)
            runs.append((F.col("_nth") - F.coalesce(stop, F.lit(0))).alias(f"run_{side}"))
    return out.select("*", *runs)


def series_features(
    series: DataFrame,
    keys: Sequence[str],
    slot: str,
    value: str,
    pos: str = "pos",
    features: list[tuple[str, dict]] | None = None,
) -> DataFrame:
    """All wanted statistics of each series in one aggregation."""
    features = features or DEFAULT_FEATURES
    prepared = with_series_columns(series, keys, slot, value, pos, features)
    return prepared.groupBy(*keys).agg(*[build(f, p) for f, p in features])


def band_pivot(
    table: DataFrame, cell: Sequence[str], band: str, bands: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Bands to columns ``<band>_<column>``; the band list is always given."""
    return (
        table.groupBy(*cell)
        .pivot(band, list(bands))
        .agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in columns])
        if len(columns) > 1
        else table.groupBy(*cell).agg(
            *[
                F.max(F.when(F.col(band) == b, F.col(f"`{columns[0]}`"))).alias(f"{b}_{columns[0]}")
                for b in bands
            ]
        )
    )


def series_tasks(series: int, first: dt.date | None, last: dt.date | None, step: str, parallelism: int) -> int:
    """Tasks for so many series on the calendar from the first to the last slot, by the rows they become."""
    if first is None:
        return 1
    slots = (last - first).days + 1 if step == "day" else 12 * (last.year - first.year) + last.month - first.month + 1
    return max(parallelism, math.ceil(series * slots / SLOTS_PER_TASK))


def filled_series(
    pixels: DataFrame,
    cell: Sequence[str],
    band: str,
    slot: str,
    value: str,
    nodata: float | None = 0,
    step: str = "day",
    hot_rows: int = 5_000_000,
) -> DataFrame:
    """Composite, slot grid and gap filling, laid out by cell.

    One counting pass tells the calendar and whether any group is too large for a
    plain median.  The rows are then spread by cell once; the series windows, the
    statistics and the pivot all find that layout and shuffle nothing again.
    """
    counts = pixels.groupBy(*cell, band, slot).agg(F.count(value).alias("_n"))
    biggest, first, last, series = counts.agg(
        F.max("_n"), F.min(slot), F.max(slot), F.approx_count_distinct(F.struct(*cell, band))
    ).first()
    composite = median_composite(pixels, cell, band, slot, value, nodata, hot_rows, biggest or 0)
    # the rows multiply by the calendar after this shuffle, so its task count comes
    # from the counting pass rather than from the size the engine measures before
    tasks = series_tasks(series, first, last, step, pixels.sparkSession.sparkContext.defaultParallelism)
    by_cell = composite.repartition(tasks, *cell)
    grid = on_slot_grid(by_cell, [*cell, band], slot, value, slot_range(first, last, step))
    return interpolate(grid, [*cell, band], value)


def split_stack(stacks: DataFrame, keys: Sequence[str], stack: str, slots: Column) -> DataFrame:
    """A cell's multi-slot array to one row per slot."""
    return stacks.select(*keys, F.posexplode(stack).alias("pos", "value")).select(
        *keys, "pos", F.get(slots, F.col("pos")).alias("slot"), "value"
    )


def class_profile(
    series: DataFrame, labels: str, slot: str, value: str, slices: int | None = None
) -> DataFrame:
    """Mean and exact median per class and slot; a class may hold most rows.

    The series are read several times, so they are written once.
    """
    series = reliable(series.select(labels, slot, value))
    means = series.groupBy(labels, slot).agg(F.avg(value).alias("mean_value"))
    medians = group_quantiles(series, [labels, slot], value, {"median_value": 0.5}, slices)
    return means.join(medians, [labels, slot])
