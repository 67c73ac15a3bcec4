"""What-if volume scenarios on the literature score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions import risk
from paceframe.functions.numbers import exact_round, fixed_text, texts
from paceframe.keys import ATHLETE, DATE, latest_first, with_day
from paceframe.operators.trailing import monotony



def _literature(km: Column, monotony_: Column, strain: Column) -> Column:
    """Literature score without a workload ratio, as scenarios see it.

    The score table carries no ratio column, so scenarios treat it as unknown.
    """
    return risk.literature_score(F.lit(None).cast("double"), "running_avg_speed", km, monotony_, strain)


def _summary() -> Column:
    cut = F.round((1.0 - F.col("factor")) * 100).cast("int")
    return texts(
        "If 7-day running volume were ~", cut, "% lower (", fixed_text("scenario_run7_km"), " vs ",
        fixed_text("baseline_run7_km"), " km/week), literature score would move ",
        fixed_text("baseline_literature_score"), " → ", fixed_text("scenario_literature_score"), " (",
        fixed_text("delta_literature_score", sign=True), ").",
    )


def with_week_strain(scores: DataFrame) -> DataFrame:
    """Monotony and strain over the week's rolling load sums.

    Scenarios feed the 7-day sums of the week's rows, not the daily loads,
    into the monotony rule; scaling all of them leaves monotony as it is.
    """
    frame = monotony(with_day(scores).drop("foster_monotony", "foster_strain"), "running_7d_load_sum")
    return frame.withColumnsRenamed({"foster_monotony": "_week_monotony", "foster_strain": "_week_strain"})


def volume_scenarios(scores: DataFrame, factors: Sequence[float], days: Column | None = None) -> DataFrame:
    """Every day under every factor; ``days`` narrows the days first."""
    frame = with_week_strain(scores)
    if days is not None:
        frame = frame.filter(days)
    factor = F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor")
    frame = frame.select("*", factor)
    km = F.coalesce("running_7d_sum_m", F.lit(0.0))
    frame = frame.withColumns({"baseline_run7_km": km / 1000.0, "scenario_run7_km": km * F.col("factor") / 1000.0})
    frame = frame.withColumns(
        {
            "baseline_literature_score": _literature(F.col("baseline_run7_km"), F.col("_week_monotony"), F.col("_week_strain")),
            "scenario_literature_score": _literature(
                F.col("scenario_run7_km"), F.col("_week_monotony"), F.col("_week_strain") * F.col("factor")
            ),
        }
    )
    frame = frame.withColumn(
        "delta_literature_score", F.col("scenario_literature_score") - F.col("baseline_literature_score")
    )
    return frame.withColumn("summary", _summary()).drop("_week_monotony", "_week_strain")


def latest_scenarios(scores: DataFrame, factors: Sequence[float] = fixed.SCENARIO_FACTORS) -> DataFrame:
    """Scenario sentences of each athlete's latest day, and the best one."""
    last = F.col("_age") == 1
    ranked = with_day(scores).withColumn("_age", F.row_number().over(latest_first()))
    grid = volume_scenarios(ranked, factors, last)
    by_factor = [F.max(F.when(F.col("factor") == f, F.col("summary"))).alias(n) for f, n in zip(factors, _SCENARIO_NAMES)]
    best = F.min_by("summary", F.struct("scenario_literature_score", -F.col("factor")))
    return grid.groupBy(ATHLETE, DATE).agg(*by_factor, best.alias("whatif_best_scenario_summary"))


# --- fixed values: names of the scenario columns ---
_SCENARIO_NAMES = ["whatif_volume_15_summary", "whatif_volume_45_summary"]


def add_latest_scenarios(scores: DataFrame) -> DataFrame:
    return scores.join(latest_scenarios(scores), [ATHLETE, DATE], "left")


def volume_cut(scores: DataFrame, date: str, factor: float = 0.85) -> DataFrame:
    """One day under one factor, rounded for display."""
    grid = volume_scenarios(scores, [factor], F.col(DATE) == F.lit(date).cast("date"))
    return grid.select(
        ATHLETE, DATE, texts("Volume cut to ", fixed_text(F.col("factor") * 100), "%").alias("scenario"),
        exact_round("integrated_bone_stress_score", 2).alias("current_score"),
        exact_round("literature_bone_stress_score", 2).alias("actual_literature_score"),
        exact_round("scenario_literature_score", 2).alias("scenario_literature_score"),
        exact_round("delta_literature_score", 2).alias("literature_score_change"),
        exact_round("baseline_run7_km", 1).alias("actual_run7_km"),
        exact_round("scenario_run7_km", 1).alias("scenario_run7_km"),
    )


def adjustment_grid(scores: DataFrame, min_factor: float = 0.5, days: Column | None = None) -> DataFrame:
    """Volume factors from 0.95 down in steps of 0.05."""
    factors = [round(x / 100, 2) for x in range(95, int(min_factor * 100) - 1, -5)]
    grid = volume_scenarios(scores, factors, days)
    return grid.select(
        ATHLETE, DATE, F.col("factor").alias("volume_factor"),
        F.round((1 - F.col("factor")) * 100).cast("int").alias("volume_reduction_pct"),
        exact_round("scenario_run7_km", 1).alias("scenario_run7_km"),
        exact_round("scenario_literature_score", 2).alias("scenario_literature_score"),
        exact_round("delta_literature_score", 2).alias("literature_score_change"),
    )


def adjustment_plan(
    scores: DataFrame, target: float = fixed.TARGET_LITERATURE_SCORE, min_factor: float = 0.5, days: Column | None = None
) -> DataFrame:
    """Smallest cut per day that brings the literature score under the target."""
    grid = adjustment_grid(scores, min_factor, days)
    meets = F.col("scenario_literature_score") < target
    step = F.struct(
        "volume_factor", "volume_reduction_pct", "scenario_run7_km", "scenario_literature_score", "literature_score_change"
    )
    return grid.groupBy(ATHLETE, DATE).agg(
        F.max(F.when(meets, step)).alias("smallest_reduction_meeting_target"),
        F.count_if(meets).alias("factors_meeting_target"),
        F.reverse(F.array_sort(F.collect_list(step))).alias("scenario_grid"),
    )


def down_week(scores: DataFrame, start: str, factor: float = 0.8, days: int = 7) -> DataFrame:
    """Actual and scenario ranges of each athlete over a reduced week."""
    first = F.lit(start).cast("date")
    grid = volume_scenarios(scores, [factor], F.col(DATE).between(first, F.date_add(first, days - 1)))
    shown = {
        "integrated": exact_round("integrated_bone_stress_score", 2),
        "literature": exact_round("literature_bone_stress_score", 2),
        "scenario": exact_round("scenario_literature_score", 2),
        "delta": exact_round("delta_literature_score", 2),
    }
    rows = grid.select(ATHLETE, DATE, *[c.alias(n) for n, c in shown.items()])
    week = rows.groupBy(ATHLETE).agg(
        F.min("integrated").alias("actual_integrated_min"),
        F.max("integrated").alias("actual_integrated_max"),
        F.min("literature").alias("actual_literature_min"),
        F.max("literature").alias("actual_literature_max"),
        F.min("scenario").alias("scenario_literature_min"),
        F.max("scenario").alias("scenario_literature_max"),
        F.avg("delta").alias("_mean"),
        F.min("delta").alias("largest_literature_drop"),
        F.count(F.lit(1)).alias("days"),
    )
    return week.withColumn("mean_literature_delta", exact_round(F.round("_mean", 9), 2)).drop("_mean")
