"""Sustained periods: islands of elevated days with small gaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions.numbers import exact_round, fixed_text, settle, spaced, texts
from paceframe.keys import ATHLETE, DATE, DAY, history_order, top_per, with_day

_SPAN = "start_date", "end_date"


def _risk_summary() -> Column:
    readiness = F.when(
        F.col("min_readiness").isNotNull(), texts(" Lowest readiness ", fixed_text("min_readiness"), ".")
    )
    return texts(
        "Sustained elevated risk from ", F.col("start_date"), " to ", F.col("end_date"), " (", F.col("calendar_days"),
        " calendar days). Accumulated state peaked at ", fixed_text("peak_accumulated_risk_state"), " with ",
        F.col("high_risk_days"), " high-risk day(s). Dominant pattern: ", spaced("dominant_risk_reason"), ".", readiness,
    )


def _bone_summary() -> Column:
    peak = F.when(
        F.col("peak_running_7d_km").isNotNull(),
        texts(" Peak 7-day running total ", fixed_text("peak_running_7d_km"), " km."),
    )
    return texts(
        "Sustained elevated bone-stress load from ", F.col("start_date"), " to ", F.col("end_date"), " (",
        F.col("calendar_days"), " calendar days). Accumulated bone-stress state peaked at ",
        fixed_text("peak_accumulated_bone_stress_state"), " with ", F.col("high_bone_stress_days"),
        " high day(s). Dominant pattern: ", spaced("dominant_bone_stress_reason"), ".", peak,
    )


def _calendar_days() -> Column:
    return (F.datediff("end_date", "start_date") + 1).cast("bigint")


def with_islands(df: DataFrame, elevated: Column, max_step: int) -> DataFrame:
    """Number the groups of elevated rows and mark the rows inside them.

    A row between two elevated rows belongs to their group when they are at
    most ``max_step`` days apart.  Everything is read from one ordered pass.
    """
    frame = with_day(df).withColumn("_elevated", F.coalesce(elevated, F.lit(False)))
    order = history_order()
    marked = F.when(F.col("_elevated"), F.col(DAY))
    frame = frame.withColumn("_marked", marked)
    frame = frame.withColumns(
        {
            "_before": F.last("_marked", ignorenulls=True).over(order.rowsBetween(-(2**31) + 1, -1)),
            "_after": F.expr(f"lead(_marked, 1) ignore nulls over (partition by {ATHLETE} order by {DAY})"),
        }
    )
    opens = F.col("_elevated") & (F.col("_before").isNull() | (F.col(DAY) - F.col("_before") > max_step))
    inside = F.col("_elevated") | F.coalesce(F.col("_after") - F.col("_before") <= max_step, F.lit(False))
    frame = frame.withColumns(
        {"island": F.sum(opens.cast("bigint")).over(order.rowsBetween(-(2**31) + 1, 0)), "in_island": inside}
    )
    return frame.drop("_marked", "_before", "_after")


def risk_periods(
    scores: DataFrame,
    threshold: float = fixed.RISK_PERIOD_THRESHOLD,
    min_elevated_days: int = fixed.RISK_PERIOD_MIN_DAYS,
    max_gap_days: int = fixed.RISK_PERIOD_MAX_GAP,
) -> DataFrame:
    """Periods of raised recovery-risk state, numbered before short ones drop out."""
    elevated = F.col("accumulated_risk_state") >= threshold
    rows = with_islands(scores, elevated, max_gap_days + 1).filter("in_island")
    state = F.col("accumulated_risk_state")
    periods = rows.groupBy(ATHLETE, F.col("island").alias("period_id")).agg(
        F.min(DATE).alias("start_date"),
        F.max(DATE).alias("end_date"),
        F.count_if("_elevated").alias("elevated_days"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_days"),
        F.max(state).alias("peak_accumulated_risk_state"),
        settle(F.avg(state), 9).alias("mean_accumulated_risk_state"),
        settle(F.avg("recovery_strain_score"), 9).alias("mean_recovery_strain"),
        settle(F.avg("metabolic_fatigue_score"), 9).alias("mean_metabolic_fatigue"),
        settle(F.avg("tissue_load_score"), 9).alias("mean_tissue_load"),
        F.min("readiness").alias("min_readiness"),
        F.mode("risk_reason", True).alias("dominant_risk_reason"),
    )
    periods = periods.filter(F.col("elevated_days") >= min_elevated_days)
    periods = periods.withColumns(
        {
            "calendar_days": _calendar_days(),
            "period_level": F.when(F.col("peak_accumulated_risk_state") >= fixed.STATE_HIGH, "high").otherwise("moderate"),
        }
    )
    return periods.withColumn("period_summary", _risk_summary())


def split_long_cluster(days: list[int], max_span: int, min_days: int) -> list[list[int]]:
    """Cut a cluster at its largest gap (the latest of equals) until it fits.

    A half with too few days is given up; if that loses both, the cluster is
    kept whole.
    """
    if len(days) < 2 or days[-1] - days[0] + 1 <= max_span:
        return [days]
    gaps = [later - earlier for earlier, later in zip(days, days[1:])]
    widest = max(gaps)
    cut = len(gaps) - gaps[::-1].index(widest)
    halves = [half for half in (days[:cut], days[cut:]) if len(half) >= min_days]
    parts = [part for half in halves for part in split_long_cluster(half, max_span, min_days)]
    return parts or [days]


def high_day_blocks(
    scores: DataFrame,
    max_gap_days: int = fixed.BONE_PERIOD_MAX_GAP,
    min_high_days: int = fixed.BONE_PERIOD_MIN_DAYS,
    max_span_days: int = fixed.BONE_PERIOD_MAX_SPAN,
) -> DataFrame:
    """Blocks of high bone-stress days: start, end, count, number per athlete."""
    high = with_day(scores).filter(F.col("bone_stress_risk_level") == "high").select(ATHLETE, DAY)
    order = history_order()
    opens = F.coalesce(F.col(DAY) - F.lag(DAY).over(order) > max_gap_days, F.lit(True))
    clusters = high.withColumn("_opens", opens.cast("int")).withColumn("_cluster", F.sum("_opens").over(order))

    days = clusters.groupBy(ATHLETE, "_cluster").agg(F.array_sort(F.collect_list(DAY)).alias("_days"))
    days = days.filter(F.size("_days") >= min_high_days).select(ATHLETE, "_days")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (athlete, part[0], part[-1], len(part))
                for athlete, listed in zip(batch[ATHLETE], batch["_days"])
                for part in split_long_cluster([int(d) for d in listed], max_span_days, min_high_days)
            ]
            yield pd.DataFrame(found, columns=[ATHLETE, "_start", "_end", "elevated_days"])

    # One row is one cluster of high days, far less than one history.
    id_type = scores.schema[ATHLETE].dataType.simpleString()
    blocks = days.mapInPandas(split, f"{ATHLETE} {id_type}, _start int, _end int, elevated_days bigint")
    number = F.row_number().over(history_order_by("_start"))
    return blocks.select(
        ATHLETE,
        number.cast("bigint").alias("period_id"),
        F.date_from_unix_date("_start").alias("start_date"),
        F.date_from_unix_date("_end").alias("end_date"),
        "elevated_days",
    )


def history_order_by(column: str) -> WindowSpec:
    """One athlete's periods in the order of a column."""
    return Window.partitionBy(ATHLETE).orderBy(column)


def period_days(periods: DataFrame, *columns: str, grace: int = 0) -> DataFrame:
    """One row per day of each period, optionally some days beyond its end."""
    days = F.sequence("start_date", F.date_add("end_date", grace))
    return periods.select(ATHLETE, F.explode(days).alias(DATE), *columns)


def bone_periods(
    scores: DataFrame,
    max_gap_days: int = fixed.BONE_PERIOD_MAX_GAP,
    min_high_days: int = fixed.BONE_PERIOD_MIN_DAYS,
    min_peak_state: float = fixed.BONE_PERIOD_MIN_PEAK,
    max_span_days: int = fixed.BONE_PERIOD_MAX_SPAN,
) -> DataFrame:
    """Running-load blocks with their peaks, means and dominant reason."""
    blocks = high_day_blocks(scores, max_gap_days, min_high_days, max_span_days)
    days = period_days(blocks, "period_id", *_SPAN, "elevated_days")
    rows = days.join(
        scores.select(
            ATHLETE, DATE, "accumulated_bone_stress_state", "running_7d_sum_m", "running_7d_load_score",
            "running_progression_score", "running_intensity_score", "bone_stress_risk_reason",
        ),
        [ATHLETE, DATE],
    )
    periods = rows.groupBy(ATHLETE, "period_id", *_SPAN, "elevated_days").agg(
        F.max("accumulated_bone_stress_state").alias("peak_accumulated_bone_stress_state"),
        settle(F.avg("accumulated_bone_stress_state"), 9).alias("mean_accumulated_bone_stress_state"),
        (F.max("running_7d_sum_m") / 1000.0).alias("peak_running_7d_km"),
        settle(F.avg("running_7d_sum_m") / 1000.0, 9).alias("mean_running_7d_km"),
        settle(F.avg("running_7d_load_score"), 9).alias("mean_running_7d_load_score"),
        settle(F.avg("running_progression_score"), 9).alias("mean_running_progression_score"),
        settle(F.avg("running_intensity_score"), 9).alias("mean_running_intensity_score"),
        F.mode("bone_stress_risk_reason", True).alias("dominant_bone_stress_reason"),
    )
    periods = periods.filter(F.col("peak_accumulated_bone_stress_state") >= min_peak_state)
    high = F.col("peak_accumulated_bone_stress_state") >= fixed.STATE_HIGH
    periods = periods.withColumns(
        {
            "calendar_days": _calendar_days(),
            "high_bone_stress_days": F.col("elevated_days"),
            "period_level": F.when(high, "high").otherwise("moderate"),
        }
    )
    return periods.withColumn("period_summary", _bone_summary())


# --- lookups -------------------------------------------------------------------


def first_period_of_day(days: DataFrame, periods: DataFrame, *columns: str) -> DataFrame:
    """Attach the first period (by start) that contains the day.

    Periods are laid out as days, so the match is an equality on athlete and
    date instead of a range comparison.
    """
    covering = period_days(periods, "start_date", "end_date", "period_id", *[c for c in columns if c not in _SPAN])
    first = top_per(covering, [ATHLETE, DATE], [F.col("start_date"), F.col("period_id")], 1)
    return days.join(first, [ATHLETE, DATE], "left")


def active_period(days: DataFrame, periods: DataFrame, *columns: str, grace: int = fixed.PERIOD_GRACE_DAYS) -> DataFrame:
    """Attach the highest-peaking period that contains the day, with grace."""
    peak = "peak_accumulated_bone_stress_state"
    covering = period_days(periods, "period_id", peak, *_SPAN, *columns, grace=grace)
    best = top_per(covering, [ATHLETE, DATE], [F.col(peak).desc(), F.col("period_id")], 1)
    return days.join(best, [ATHLETE, DATE], "left")


def overlapping(windows: DataFrame, periods: DataFrame, keys: list[str], start: str, end: str, n: int = 5) -> DataFrame:
    """Periods that overlap each window, the highest peaks first."""
    meets = (F.col("start_date") <= F.col(end)) & (F.col("end_date") >= F.col(start))
    pairs = windows.join(periods, ATHLETE).filter(meets)
    order = [F.col("peak_accumulated_bone_stress_state").desc(), F.col("period_id")]
    return top_per(pairs, [ATHLETE, *keys], order, n, rank="overlap_rank")


def days_per_period(periods: DataFrame, scores: DataFrame) -> DataFrame:
    """Agreement and high-day counts of the days in each period."""
    days = period_days(periods, "period_id").join(
        scores.select(
            ATHLETE, DATE, "monitoring_signal_agreement", "accumulated_frontier_level", "literature_bone_stress_level"
        ),
        [ATHLETE, DATE],
        "left",
    )
    return days.groupBy(ATHLETE, "period_id").agg(
        F.count_if(F.col("monitoring_signal_agreement") == "all_agree").alias("all_agree_days"),
        F.count_if(F.col("accumulated_frontier_level") == "high").alias("frontier_high_days"),
        F.count_if(F.col("literature_bone_stress_level") == "high").alias("literature_high_days"),
    )


def period_payload(periods: DataFrame, scores: DataFrame, n: int = 24) -> DataFrame:
    """The top periods of each athlete with counts, and the one still active."""
    last = scores.groupBy(ATHLETE).agg(F.max(DATE).alias("_latest"))
    counted = periods.join(days_per_period(periods, scores), [ATHLETE, "period_id"]).join(last, ATHLETE)
    covers = F.col("_latest").between(F.col("start_date"), F.date_add("end_date", fixed.PERIOD_GRACE_DAYS))
    order = [F.col("peak_accumulated_bone_stress_state").desc(), F.col("period_id")]
    ranked = top_per(counted, [ATHLETE], order, n, rank="period_rank")
    first_active = F.min(F.when(covers, F.col("period_rank"))).over(Window.partitionBy(ATHLETE))
    return ranked.select(
        ATHLETE, "period_rank", "period_id", *_SPAN, "calendar_days", "elevated_days",
        exact_round("peak_accumulated_bone_stress_state", 1).alias("peak_state"),
        exact_round(F.coalesce("peak_running_7d_km", F.lit(0.0)), 1).alias("peak_km"),
        F.col("period_level").alias("level"), spaced("dominant_bone_stress_reason").alias("pattern"),
        F.col("period_summary").alias("summary"), "all_agree_days", "frontier_high_days", "literature_high_days",
        F.coalesce(first_active == F.col("period_rank"), F.lit(False)).alias("active"),
    )


def top_periods(periods: DataFrame, peak: str, n: int) -> DataFrame:
    """Highest peaks first, longer periods first among equals."""
    return periods.orderBy(F.col(peak).desc(), F.col("calendar_days").desc(), ATHLETE, "period_id").limit(n)
