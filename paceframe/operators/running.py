"""Running load: composite load, short and long sums, workload ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions.convert import sane_distance
from paceframe.functions.numbers import or_zero, settle
from paceframe.keys import by_days, with_day
from paceframe.operators.daily import canonical, override_running


def composite_load(df: DataFrame) -> DataFrame:
    """Volume, speed, climb, effort and heart-rate time in one number."""
    duration = or_zero("running_duration")
    pace = F.greatest(or_zero("running_avg_speed"), or_zero("running_max_speed") * fixed.MAX_SPEED_SHARE)
    load = (
        or_zero("running_distance") * fixed.LOAD_DISTANCE
        + duration * pace * fixed.LOAD_SPEED_DURATION
        + or_zero("running_elevation_gain") * fixed.LOAD_ELEVATION
        + or_zero("running_aerobic_te") * fixed.LOAD_AEROBIC
        + or_zero("running_anaerobic_te") * fixed.LOAD_ANAEROBIC
        + or_zero("running_avg_hr") * duration / 3600.0 * fixed.LOAD_HR_DURATION
    )
    return df.withColumn("running_bone_stress_load", settle(load))


def with_sane_distance(df: DataFrame) -> DataFrame:
    return df.withColumn("running_distance", sane_distance("running_distance", "running_duration"))


def running_sums(df: DataFrame) -> DataFrame:
    """Sums over 7 and 28 days, today included, and their ratio."""
    frame = with_day(df)
    week, month = by_days(-6, 0), by_days(-27, 0)
    frame = frame.withColumns(
        {
            "running_7d_load_sum": settle(F.sum("running_bone_stress_load").over(week)),
            "running_28d_load_sum": settle(F.sum("running_bone_stress_load").over(month)),
            "running_7d_sum_m": F.sum("running_distance").over(week),
            "running_28d_sum_m": F.sum("running_distance").over(month),
        }
    )
    ratio = settle(4.0 * F.col("running_7d_load_sum") / F.col("running_28d_load_sum"))
    return frame.withColumn("running_7d_acwr", F.when(F.col("running_28d_load_sum") > 0, ratio))


def enrich_running(daily: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Canonical daily frame with cleaned running columns, load and sums."""
    frame = canonical(daily, fixed.CANONICAL, fixed.CANONICAL_RUNNING)
    frame = frame.withColumn("running_distance_raw", F.col("running_distance"))
    frame = with_sane_distance(frame)
    if totals is not None:
        frame = with_sane_distance(override_running(frame, totals))
    speed = F.col("running_distance") / F.col("running_duration")
    frame = frame.withColumn("running_avg_speed", settle(F.when(F.col("running_duration") > 0, speed)))
    return running_sums(composite_load(frame))
