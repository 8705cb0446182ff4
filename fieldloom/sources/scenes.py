"""Scene selection by area, date and cloud share."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOUD_LIMIT = 30


def scene_filter(
    scenes: DataFrame,
    box: tuple[float, float, float, float],
    start: dt.date,
    end: dt.date,
    cloud_limit: float = CLOUD_LIMIT,
    literal: bool = False,
) -> DataFrame:
    """Scenes that overlap the box, lie in the period and are clear enough.

    ``end`` is the last day wanted.  ``literal`` cuts before that day instead,
    which is what a half-open filter does with a month's last day.
    """
    stop = end if literal else end + dt.timedelta(days=1)
    left, bottom, right, top = box
    return scenes.where(
        (F.col("max_x") >= left)
        & (F.col("min_x") <= right)
        & (F.col("max_y") >= bottom)
        & (F.col("min_y") <= top)
        & (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("ts") < F.lit(stop).cast("timestamp_ntz"))
        & (F.col("cloud_pct") <= cloud_limit)
    )


def total_bounds(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return points.agg(
        F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y")
    )
