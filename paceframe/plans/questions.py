"""Ready-made questions about a day, a range or an athlete.

Each question is a DataFrame with one row per athlete (or per day); a filter
on ``athlete_id`` or ``date`` reaches the scan of the score table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from paceframe.functions.numbers import exact_round, or_zero, texts
from paceframe.keys import ATHLETE, DATE, col_or_null, per_athlete, top_per, with_day
from paceframe.plans.scenarios import adjustment_plan

# --- fixed values: bases of the three tracks ---
LITERATURE_BASIS = "Objective workload-rule features: ACWR/workload ratio, absolute 7-day running volume, speed/intensity, Foster monotony/strain."
PERSONALIZED_BASIS = "Athlete-specific percentile/context scoring versus this athlete's historical running patterns and recent progression."
FRONTIER_BASIS = "Learned-state strain from embedding novelty, negative readiness surprise, and reference-block similarity. It should not be explained as ACWR-driven unless the stored frontier attribution specifically says so."

# --- fixed values: columns of the day view and their sources ---
_ROUNDED_2 = {
    "literature_score": "literature_bone_stress_score",
    "personalized_score": "personalized_bone_stress_score",
    "frontier_score": "accumulated_frontier_state",
    "embedding_novelty_score": "embedding_novelty_score",
    "contrastive_novelty_score": "contrastive_novelty_score",
    "readiness_forecast_error_score": "readiness_forecast_error_score",
    "reference_similarity_score": "reference_block_similarity_score",
    "acwr": "running_acwr_score",
    "recovery_strain": "recovery_strain_score",
    "accumulated_state": "accumulated_bone_stress_state",
}
_KM = {"run_7d_km": "running_7d_sum_m", "run_28d_km": "running_28d_sum_m", "run_today_km": "running_distance"}
_TEXT = {
    "alert_tier": "operational_alert_tier",
    "alert_label": "operational_alert_label",
    "combined_level": "bone_stress_risk_level",
    "reason": "bone_stress_risk_reason",
    "acwr_zone": "running_acwr_zone",
    "accumulated_level": "accumulated_bone_stress_level",
    "agreement": "monitoring_signal_agreement",
    "recommendation": "operational_recommendation",
    "counterfactual": "counterfactual_hint",
    "archetype": "reference_archetype_label",
    "neighbors": "embedding_neighbor_summary",
    "attribution": "frontier_attribution_summary",
    "attribution_drivers": "frontier_attribution_drivers",
}


def _km(meters: Column) -> Column:
    return exact_round(meters / 1000.0, 1)


def _date(text: str) -> Column:
    return F.lit(text).cast("date")


def _between(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.filter(F.col(DATE).between(start, end))


def day_view(scores: DataFrame) -> DataFrame:
    """All monitoring fields of every day, rounded for display."""
    headline = exact_round(F.coalesce("integrated_bone_stress_score", "bone_stress_risk_score"), 2)
    out = [headline.alias("combined_score"), headline.alias("integrated_score")]
    out += [exact_round(col_or_null(scores, c), 2).alias(n) for n, c in _ROUNDED_2.items()]
    out += [_km(F.coalesce(c, F.lit(0.0))).alias(n) for n, c in _KM.items()]
    out += [col_or_null(scores, c, "string").alias(n) for n, c in _TEXT.items()]
    return scores.select(ATHLETE, DATE, *out)


def get_day(scores: DataFrame, date: str) -> DataFrame:
    return day_view(scores.filter(F.col(DATE) == _date(date)))


def days_timeline(scores: DataFrame, dates: Sequence[str]) -> DataFrame:
    """The day view of a list of dates."""
    return day_view(scores.filter(F.col(DATE).isin([_date(d) for d in dates])))


def latest_day(scores: DataFrame) -> DataFrame:
    return day_view(top_per(with_day(scores), [ATHLETE], [F.col("day").desc()], 1))


def compare_days(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Two days of each athlete side by side, with what changed."""
    names = ["combined_score", "run_7d_km", "run_28d_km", "alert_tier", "alert_label", "acwr_zone"]
    view = days_timeline(scores, [first, second]).select(ATHLETE, DATE, *names)
    a = view.filter(F.col(DATE) == _date(first)).select(ATHLETE, *[F.col(n).alias(f"a_{n}") for n in names])
    b = view.filter(F.col(DATE) == _date(second)).select(ATHLETE, *[F.col(n).alias(f"b_{n}") for n in names])
    both = a.join(b, ATHLETE)
    change = {n: F.col(f"a_{n}") - F.col(f"b_{n}") for n in names[:3]}
    moved = [
        F.when(~F.col("a_alert_tier").eqNullSafe(F.col("b_alert_tier")), texts("Alert tier: ", F.col("b_alert_tier"), " → ", F.col("a_alert_tier"))),
        F.when(F.abs(change["combined_score"]) > 10, texts("Score difference: ", F.format_string("%.1f", exact_round(F.abs(change["combined_score"]), 1)), " pts")),
        F.when(F.abs(change["run_7d_km"]) > 5, texts("7-day volume: ", F.col("b_run_7d_km"), " km → ", F.col("a_run_7d_km"), " km")),
        F.when(~F.col("a_acwr_zone").eqNullSafe(F.col("b_acwr_zone")), texts("ACWR zone: ", F.col("b_acwr_zone"), " → ", F.col("a_acwr_zone"))),
    ]
    listed = F.array_compact(F.array(*moved))
    return both.select(
        ATHLETE,
        exact_round(change["combined_score"], 2).alias("score_change"),
        exact_round(change["run_7d_km"], 1).alias("run_7d_change_km"),
        exact_round(change["run_28d_km"], 1).alias("run_28d_change_km"),
        texts(F.col("b_alert_label"), " → ", F.col("a_alert_label")).alias("alert_change"),
        F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("No major differences"))).alias("key_differences"),
    )


def _top_days(n: int, *fields: Column) -> Column:
    """The ``n`` highest days of a range, earliest first among equals."""
    score = F.col("integrated_bone_stress_score")
    entry = F.struct((-score).alias("_k"), F.col(DATE).alias("date"), exact_round(score, 2).alias("score"), *fields)
    ranked = F.slice(F.array_sort(F.collect_list(F.when(score.isNotNull(), entry))), 1, n)
    return F.transform(ranked, lambda e: e.dropFields("_k"))


def periods_around(scores: DataFrame, date: str, before: int = 7, after: int = 7) -> DataFrame:
    """Days around a date: alerts, three highest days, range and mean volume."""
    center = _date(date)
    window = _between(scores, F.date_add(center, -before), F.date_add(center, after))
    score, km = F.col("integrated_bone_stress_score"), _km(F.col("running_7d_sum_m"))
    alert = F.struct(
        F.col(DATE).alias("date"), F.col("operational_alert_tier").alias("tier"),
        exact_round("bone_stress_risk_score", 2).alias("score"), km.alias("run_7d_km"),
    )
    return window.groupBy(ATHLETE).agg(
        F.array_sort(F.collect_list(alert)).alias("alerts_in_period"),
        _top_days(3, km.alias("run_7d_km")).alias("top_3_scores"),
        exact_round(F.min(score), 2).alias("min_score"),
        exact_round(F.max(score), 2).alias("max_score"),
        _km(F.avg("running_7d_sum_m")).alias("avg_run_7d"),
    )


def riskiest_period(periods: DataFrame, metric: str = "peak_accumulated_bone_stress_state") -> DataFrame:
    """Each athlete's top period by a chosen metric."""
    best = top_per(periods, [ATHLETE], [F.col(metric).desc(), F.col("period_id")], 1)
    return best.select(
        ATHLETE, F.lit(metric).alias("metric"), "start_date", "end_date", "calendar_days", "elevated_days",
        exact_round("peak_accumulated_bone_stress_state", 2).alias("peak_state"),
        exact_round("mean_accumulated_bone_stress_state", 2).alias("mean_state"),
        exact_round(or_zero("peak_running_7d_km"), 1).alias("peak_7d_km"),
        exact_round(or_zero("mean_running_7d_km"), 1).alias("mean_7d_km"),
        F.col("dominant_bone_stress_reason").alias("dominant_reason"), "period_level",
        F.col("period_summary").alias("summary"),
    )


# --- fixed values: score and level column per track ---
TRACKS = {
    "literature": ("literature_bone_stress_score", "literature_bone_stress_level"),
    "personalized": ("personalized_bone_stress_score", "personalized_bone_stress_level"),
    "frontier": ("accumulated_frontier_state", "accumulated_frontier_level"),
}


def highlighted_days(scores: DataFrame, start: str, end: str, n: int = 8) -> DataFrame:
    """Highest days of each track in a range; high days only, if there are any."""
    window = _between(scores, _date(start), _date(end))
    tracks = F.array(
        *[
            F.struct(F.lit(t).alias("track"), F.col(s).alias("score"), F.col(v).alias("level"))
            for t, (s, v) in TRACKS.items()
        ]
    )
    long = window.select(
        ATHLETE, DATE, F.inline(tracks), "integrated_bone_stress_score", "running_7d_sum_m", "running_28d_sum_m",
        "bone_stress_risk_reason", "monitoring_signal_agreement",
        col_or_null(scores, "frontier_attribution_drivers", "string").alias("frontier_drivers"),
    )
    # The ranking must know whether any high day exists; that first ranked row
    # tells, because high days come first.
    high = F.coalesce(F.col("level") == "high", F.lit(False))
    order = [high.desc(), F.col("score").desc(), F.col(DATE)]
    top = top_per(long.filter("score is not null"), [ATHLETE, "track"], order, n, rank="place")
    any_high = F.max(high).over(_track_window())
    kept = top.withColumn("_any", any_high).filter(high | ~F.col("_any"))
    return kept.select(
        ATHLETE, "track", "place", DATE, exact_round("score", 2).alias("score"), "level",
        exact_round("integrated_bone_stress_score", 2).alias("integrated_score"),
        _km(F.col("running_7d_sum_m")).alias("run_7d_km"), _km(F.col("running_28d_sum_m")).alias("run_28d_km"),
        F.col("bone_stress_risk_reason").alias("reason"), F.col("monitoring_signal_agreement").alias("agreement"),
        "frontier_drivers",
    )


def _track_window() -> WindowSpec:
    return Window.partitionBy(ATHLETE, "track")


def explain_day(scores: DataFrame, date: str) -> DataFrame:
    """Evidence per track for a day, one struct each."""
    day = get_day(scores, date)
    return day.select(
        ATHLETE, DATE,
        F.struct(
            F.col("literature_score").alias("score"), F.lit(LITERATURE_BASIS).alias("basis"), "run_7d_km", "run_28d_km",
            F.col("acwr").alias("acwr_score"), "acwr_zone", "reason",
        ).alias("literature"),
        F.struct(
            F.col("personalized_score").alias("score"), F.lit(PERSONALIZED_BASIS).alias("basis"), "run_7d_km",
            "run_28d_km", "accumulated_state", "reason",
        ).alias("personalized"),
        F.struct(
            F.col("frontier_score").alias("score"), F.lit(FRONTIER_BASIS).alias("basis"), "embedding_novelty_score",
            "contrastive_novelty_score", "readiness_forecast_error_score", "reference_similarity_score", "archetype",
            "neighbors", "attribution", "attribution_drivers",
        ).alias("frontier"),
        F.struct("alert_tier", "alert_label", "integrated_score", "agreement").alias("alert"),
    )


def weekly_points(scores: DataFrame, end: str, lookback: int = 42) -> DataFrame:
    """The day nearest to each weekly grid date; the earlier of two equals."""
    last = _date(end)
    first = F.date_add(last, -lookback)
    rows = _between(scores, first, last).select(ATHLETE, DATE, "running_7d_sum_m")
    grid = F.explode(F.sequence(F.date_add(first, 6), last, F.expr("interval 7 days"))).alias("grid_date")
    distance = F.abs(F.datediff(DATE, "grid_date"))
    paired = rows.select("*", grid)
    nearest = paired.groupBy(ATHLETE, "grid_date").agg(
        F.min(F.struct(distance.alias("d"), F.col(DATE).alias("date"), F.col("running_7d_sum_m").alias("m"))).alias("_n")
    )
    return nearest.select(
        ATHLETE, "grid_date", F.col("_n.date").alias(DATE), _km(F.coalesce("_n.m", F.lit(0.0))).alias("run_7d_km")
    )


def progression_steps(scores: DataFrame, end: str, lookback: int = 42, reference_pct: float = 10.0) -> DataFrame:
    """Week-to-week volume steps against a fixed percentage benchmark."""
    order = Window.partitionBy(ATHLETE).orderBy("grid_date")
    points = weekly_points(scores, end, lookback).withColumns(
        {"from_date": F.lag(DATE).over(order), "from_7d_km": F.lag("run_7d_km").over(order)}
    )
    before, now = F.col("from_7d_km"), F.col("run_7d_km")
    change, allowed = now - before, before * (reference_pct / 100.0)
    return points.filter(before.isNotNull()).select(
        ATHLETE, "grid_date", "from_date", F.col(DATE).alias("to_date"), "from_7d_km", now.alias("to_7d_km"),
        exact_round(change, 1).alias("actual_change_km"),
        exact_round(F.when(before > 0, change / before * 100.0), 1).alias("actual_change_pct"),
        exact_round(before + allowed, 1).alias("reference_target_km"),
        exact_round(allowed, 1).alias("reference_change_km"),
        exact_round(now - (before + allowed), 1).alias("excess_vs_reference_km"),
    )


def progression(scores: DataFrame, end: str, lookback: int = 42, reference_pct: float = 10.0) -> DataFrame:
    """Steps, the largest excess and the total change, one row per athlete."""
    steps = progression_steps(scores, end, lookback, reference_pct)
    step = F.struct(*[c for c in steps.columns if c not in (ATHLETE, "grid_date")])
    first, last = F.min_by("from_7d_km", "grid_date"), F.max_by("to_7d_km", "grid_date")
    # The first of equal excesses is the largest step.
    largest = F.max_by(step, F.struct("excess_vs_reference_km", -F.unix_date("grid_date")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("grid_date", step.alias("s")))), lambda e: e["s"])
    out = steps.groupBy(ATHLETE).agg(
        listed.alias("week_to_week_steps"), largest.alias("largest_excess_step"), first.alias("_a"), last.alias("_b")
    )
    change = F.col("_b") - F.col("_a")
    return out.withColumns(
        {
            "total_7d_volume_change_km": exact_round(change, 1),
            "total_7d_volume_change_pct": exact_round(F.when(F.col("_a") > 0, change / F.col("_a") * 100.0), 1),
        }
    ).drop("_a", "_b")


def compare_ranges(scores: DataFrame, ranges: dict[str, tuple[str, str]]) -> DataFrame:
    """Peaks, means, high days, agreement and top days per athlete and range."""
    named = F.array_compact(
        F.array(*[F.when(F.col(DATE).between(_date(a), _date(b)), F.lit(name)) for name, (a, b) in ranges.items()])
    )
    earliest, latest = min(a for a, _ in ranges.values()), max(b for _, b in ranges.values())
    rows = _between(scores, _date(earliest), _date(latest)).withColumn("range", F.explode(named))
    score = F.col("integrated_bone_stress_score")
    km = _km(F.col("running_7d_sum_m"))
    main = rows.groupBy(ATHLETE, "range").agg(
        F.count(F.lit(1)).alias("days"),
        exact_round(F.max(score), 2).alias("peak_integrated_score"),
        exact_round(F.round(F.avg(score), 9), 2).alias("mean_integrated_score"),
        exact_round(F.max("accumulated_frontier_state"), 2).alias("peak_frontier_score"),
        exact_round(F.max("literature_bone_stress_score"), 2).alias("peak_literature_score"),
        exact_round(F.max("personalized_bone_stress_score"), 2).alias("peak_personalized_score"),
        _km(F.max("running_7d_sum_m")).alias("peak_7d_km"),
        _km(F.avg("running_7d_sum_m")).alias("mean_7d_km"),
        exact_round(F.max("accumulated_bone_stress_state"), 2).alias("peak_accumulated_state"),
        F.count_if(score >= 70).alias("high_integrated_days"),
        _top_days(3, km.alias("run_7d_km"), F.col("bone_stress_risk_reason").alias("reason")).alias("top_days"),
    )
    counts = rows.groupBy(ATHLETE, "range", F.coalesce("monitoring_signal_agreement", F.lit("unknown")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "label", "n")))
    agreement = counts.groupBy(ATHLETE, "range").agg(
        F.transform(F.slice(ranked, 1, 6), lambda e: e.dropFields("k")).alias("agreement_counts")
    )
    return main.join(agreement, [ATHLETE, "range"])


def recent_trend(scores: DataFrame, days: int = 30) -> DataFrame:
    """Change, peaks and alert counts over each athlete's latest days."""
    start = F.date_add("end_date", 1 - days)
    rows = scores.withColumn("end_date", F.max(DATE).over(per_athlete())).filter(F.col(DATE) >= start)
    score = F.col("integrated_bone_stress_score")

    def change(column: str, scale: float, digits: int) -> Column:
        return exact_round((F.max_by(column, DATE) - F.min_by(column, DATE)) / scale, digits)

    tiers = ["Adjust training", "Investigate state", "Watch", "Clear"]
    counts = [F.struct(F.lit(t).alias("label"), F.count_if(F.col("operational_alert_label") == t).alias("n")) for t in tiers]
    return rows.groupBy(ATHLETE, "end_date").agg(
        F.count(F.lit(1)).alias("days"),
        change("integrated_bone_stress_score", 1.0, 2).alias("integrated_change"),
        change("running_7d_sum_m", 1000.0, 1).alias("run_7d_change_km"),
        change("accumulated_bone_stress_state", 1.0, 2).alias("accumulated_state_change"),
        exact_round(F.max(score), 2).alias("peak_integrated_score"),
        _km(F.max("running_7d_sum_m")).alias("peak_7d_km"),
        F.array(*counts).alias("alert_counts"),
        _top_days(5, _km(F.col("running_7d_sum_m")).alias("run_7d_km")).alias("top_recent_days"),
    ).withColumn("start_date", start)


def workout_context(scores: DataFrame, date: str) -> DataFrame:
    """A day's run against all of the athlete's run days."""
    day = scores.filter(F.col(DATE) == _date(date)).select(
        ATHLETE, F.col(DATE).alias("_date"), _km(or_zero("running_distance")).alias("run_distance_km"),
        F.col("running_avg_speed").alias("avg_speed"), F.col("running_max_speed").alias("max_speed"),
        F.col("running_aerobic_te").alias("aerobic_training_effect"),
        F.col("running_anaerobic_te").alias("anaerobic_training_effect"),
    )
    runs = scores.filter(F.col("running_distance") > 0).select(ATHLETE, (F.col("running_distance") / 1000).alias("_km"))
    keys = day.columns
    below = F.avg((F.col("_km") <= F.col("run_distance_km")).cast("double"))
    ranked = day.join(runs, ATHLETE, "left").groupBy(*keys).agg(
        exact_round(below * 100, 1).alias("distance_percentile_vs_run_days")
    )
    return ranked.withColumnRenamed("_date", DATE)


_RECOVERY = [
    "actual",
    "prediction",
    "readiness_forecast_error",
    "readiness_forecast_error_score",
    "readiness_model_pessimism_score",
    "recovery_strain_score",
]


def recovery_context(scores: DataFrame, date: str) -> DataFrame:
    """Forecast, surprise and strain of a day; missing stays missing."""
    day = scores.filter(F.col(DATE) == _date(date))
    return day.select(
        ATHLETE, DATE, *[exact_round(col_or_null(scores, c), 2).alias(c) for c in _RECOVERY],
        _km(or_zero("running_7d_sum_m")).alias("run_7d_km"), _km(or_zero("running_28d_sum_m")).alias("run_28d_km"),
        exact_round("accumulated_bone_stress_state", 2).alias("accumulated_state"),
        exact_round("accumulated_frontier_state", 2).alias("frontier_score"),
    )


def track_spread(scores: DataFrame, date: str) -> DataFrame:
    """Distance between the highest and the lowest known track score."""
    day = get_day(scores, date)
    tracks = ["literature_score", "personalized_score", "frontier_score", "integrated_score"]
    # ``greatest`` and ``least`` skip missing scores, as wanted here.
    spread = exact_round(F.greatest(*tracks) - F.least(*tracks), 2)
    return day.select(ATHLETE, DATE, *tracks, spread.alias("score_spread"), "agreement")


def adjustment_options(scores: DataFrame, date: str) -> DataFrame:
    """A day's state with the athlete's recent trend."""
    day = get_day(scores, date)
    state = F.struct(*[c for c in day.columns if c not in (ATHLETE, DATE)])
    trend = recent_trend(scores)
    recent = F.struct(*[c for c in trend.columns if c != ATHLETE])
    return day.select(ATHLETE, DATE, state.alias("current_state")).join(
        trend.select(ATHLETE, recent.alias("recent_trend")), ATHLETE
    )


def case_file(scores: DataFrame, date: str, lookback: int = 42) -> DataFrame:
    """Everything about a day in one nested row per athlete."""

    def nested(df: DataFrame, name: str) -> DataFrame:
        return df.select(ATHLETE, F.struct(*[c for c in df.columns if c not in (ATHLETE, DATE)]).alias(name))

    here = F.col(DATE) == _date(date)
    day = get_day(scores, date)
    parts = [
        nested(explain_day(scores, date), "model_explanations"),
        nested(track_spread(scores, date), "model_disagreement"),
        nested(progression(scores, date, lookback), "progression"),
        nested(recovery_context(scores, date), "recovery_context"),
        nested(recent_trend(scores), "recent_trend"),
        nested(periods_around(scores, date, 14, 0), "period_context"),
        nested(adjustment_plan(scores, days=here), "adjustment_plan"),
    ]
    file = day.select(ATHLETE, DATE, F.struct(*[c for c in day.columns if c not in (ATHLETE, DATE)]).alias("summary_state"))
    for part in parts:
        file = file.join(part, ATHLETE, "left")
    return file
