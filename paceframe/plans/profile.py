"""Athlete profile, daily briefing, date explorer and context packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe.functions.numbers import exact_round, fixed_text, km_from_meters, km_text, or_zero, short_number, spaced, texts
from paceframe.keys import ATHLETE, DATE, col_or_null, latest_first, per_athlete, top_per, with_day
from paceframe.operators.periods import active_period, first_period_of_day


def _high(column: str) -> Column:
    return F.coalesce(F.col(column) == "high", F.lit(False))


def profile_snapshot(bone: DataFrame, recovery: DataFrame, bone_periods: DataFrame, risk_periods: DataFrame, daily: DataFrame) -> DataFrame:
    """Day, period and overlap counts per athlete."""
    km = F.coalesce("running_7d_sum_m", F.lit(0.0)) / 1000
    lit, per, fro = (_high(c) for c in ("literature_bone_stress_level", "personalized_bone_stress_level", "accumulated_frontier_level"))
    risk = recovery.select(ATHLETE, DATE, F.col("recovery_strain_score").alias("_strain"), F.col("risk_level").alias("_risk_level"))
    merged = bone.join(risk, [ATHLETE, DATE], "left")
    dual = _high("bone_stress_risk_level") & _high("_risk_level") & (F.coalesce("_strain", F.lit(0.0)) >= 55)
    big = km >= 100
    days = merged.groupBy(ATHLETE).agg(
        F.min(DATE).alias("date_start"),
        F.max(DATE).alias("date_end"),
        F.count(F.lit(1)).alias("total_days"),
        F.count_if(_high("bone_stress_risk_level")).alias("bone_high_days"),
        F.count_if(per & ~lit).alias("personalized_not_literature"),
        F.count_if(lit & ~per).alias("literature_not_personalized"),
        F.count_if(dual).alias("dual_stress_days"),
        F.count_if((km < 40) & F.col("bone_stress_risk_level").isin("moderate", "high")).alias("low_run_elevated_days"),
        F.count_if(big).alias("big_week_days"),
        F.coalesce(F.avg(F.when(big, _high("bone_stress_risk_level").cast("double"))), F.lit(0.0)).alias("big_week_high_rate"),
        F.count_if(fro & ~lit).alias("frontier_without_load_days"),
        F.count_if(F.col("monitoring_signal_agreement") == "all_agree").alias("all_agree_days"),
        F.count_if(lit).alias("literature_high_days"),
        F.count_if(per).alias("personalized_high_days"),
        F.count_if(F.col("accumulated_frontier_state").isNotNull()).alias("frontier_scored_days"),
        F.count_if(fro).alias("frontier_high_days"),
        F.count_if(F.col("running_edwards_speed_band") == "high_magnitude").alias("high_magnitude_days"),
        F.percentile(F.when(_high("bone_stress_risk_level"), F.col("foster_monotony")), F.lit(0.5)).alias("median_monotony_high_days"),
    )
    run = F.coalesce("running_distance_m", F.lit(0.0)) > 0
    sport = daily.groupBy(ATHLETE).agg(
        F.count_if(run).alias("run_days"),
        F.count_if(F.coalesce("cycling_distance_m", F.lit(0.0)) > 0).alias("cycle_days"),
        exact_round(F.percentile(F.when(run, F.col("running_distance_m")), F.lit(0.5)) / 1000, 1).alias("median_run_km"),
    )
    counts = [
        recovery.groupBy(ATHLETE).agg(F.count_if(_high("risk_level")).alias("recovery_high_days")),
        bone_periods.groupBy(ATHLETE).agg(F.count(F.lit(1)).alias("bone_periods")),
        risk_periods.groupBy(ATHLETE).agg(F.count(F.lit(1)).alias("recovery_periods")),
    ]
    out = days.join(sport, ATHLETE, "left")
    for part in counts:
        out = out.join(part, ATHLETE, "left")
    return out.fillna(0, ["recovery_high_days", "bone_periods", "recovery_periods"])


def high_days_by_year(bone: DataFrame) -> DataFrame:
    return bone.groupBy(ATHLETE, F.year(DATE).alias("year")).agg(F.count_if(_high("bone_stress_risk_level")).alias("high_days"))


def top_reasons(bone: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent reasons of an athlete's high days."""
    high = bone.filter(_high("bone_stress_risk_level"))
    counts = high.groupBy(ATHLETE, "bone_stress_risk_reason").agg(F.count(F.lit(1)).alias("days"))
    ranked = top_per(counts, [ATHLETE], [F.col("days").desc(), F.col("bone_stress_risk_reason")], n, rank="place")
    return ranked.withColumn("reason_label", spaced("bone_stress_risk_reason"))


def plain_period_summary() -> Column:
    """One short sentence per load block."""
    reason, peak = F.col("dominant_bone_stress_reason"), km_text("peak_running_7d_km")
    return (
        F.when(
            reason.contains("progression"),
            texts("Running ramped quickly (", peak, " peak week) from ", F.col("start_date"), " to ", F.col("end_date"), "."),
        )
        .when(
            reason.contains("volume"),
            texts("Sustained high weekly running (", peak, " peak) over ", F.col("calendar_days"), " days."),
        )
        .when(reason.contains("hard running session"), texts("Hard sessions stacked during a ", peak, " running week."))
        .otherwise(texts("Elevated running-load block peaking at ", peak, " weekly volume."))
    )


def risk_windows(periods: DataFrame, n: int = 6) -> DataFrame:
    """Each athlete's highest load blocks with a sentence."""
    order = [F.col("peak_accumulated_bone_stress_state").desc(), F.col("period_id")]
    top = top_per(periods, [ATHLETE], order, n, rank="place")
    return top.select(
        ATHLETE, "place", "start_date", "end_date", "calendar_days", km_text("peak_running_7d_km").alias("peak_km"),
        F.col("dominant_bone_stress_reason").alias("pattern"), plain_period_summary().alias("summary"),
    )


def current_block(bone: DataFrame, periods: DataFrame) -> DataFrame:
    """The load block each athlete's latest day still belongs to."""
    latest = top_per(with_day(bone), [ATHLETE], [F.col("day").desc()], 1).select(ATHLETE, DATE)
    cols = ["period_level", "dominant_bone_stress_reason", "peak_running_7d_km", "calendar_days"]
    found = active_period(latest, periods, *cols).filter("period_id is not null")
    return found.select(
        ATHLETE, DATE, "period_id", "start_date", "end_date", "period_level", plain_period_summary().alias("summary")
    )


def profile(bone: DataFrame, recovery: DataFrame, bone_periods: DataFrame, risk_periods: DataFrame, daily: DataFrame) -> DataFrame:
    """Snapshot with yearly counts, reasons, risk windows and active block."""
    years = high_days_by_year(bone).groupBy(ATHLETE).agg(
        F.array_sort(F.collect_list(F.struct("year", "high_days"))).alias("high_days_by_year")
    )
    reasons = top_reasons(bone).groupBy(ATHLETE).agg(
        F.array_sort(F.collect_list(F.struct("place", "reason_label", "days"))).alias("high_day_reasons")
    )
    windows = risk_windows(bone_periods)
    listed = windows.groupBy(ATHLETE).agg(
        F.array_sort(F.collect_list(F.struct(*[c for c in windows.columns if c != ATHLETE]))).alias("risk_windows")
    )
    block = current_block(bone, bone_periods)
    active = block.select(ATHLETE, F.struct("start_date", "end_date", "period_level", "summary").alias("active_period"))
    out = profile_snapshot(bone, recovery, bone_periods, risk_periods, daily)
    for part in (years, reasons, listed, active):
        out = out.join(part, ATHLETE, "left")
    return out


def briefing(scores: DataFrame, recovery: DataFrame) -> DataFrame:
    """Latest day of each athlete with the trend of the last seven rows."""
    recent = with_day(scores).withColumn("_age", F.row_number().over(latest_first())).filter("_age <= 7")
    dash = F.lit("—")
    trend = F.struct(
        F.col(DATE).alias("date"), F.col("bone_stress_risk_score").alias("bone"), F.col("accumulated_frontier_state").alias("frontier")
    )

    def text_of(name: str) -> Column:
        return F.coalesce(col_or_null(scores, name, "string"), dash)

    def track(label: str, score: str, level: str) -> Column:
        return F.struct(
            F.lit(label).alias("track"), F.coalesce(fixed_text(score), dash).alias("score"), F.coalesce(F.col(level), dash).alias("level")
        )

    rows = F.array(
        track("Literature", "literature_bone_stress_score", "literature_bone_stress_level"),
        track("Personalized", "personalized_bone_stress_score", "personalized_bone_stress_level"),
        track("Frontier", "accumulated_frontier_state", "accumulated_frontier_level"),
        track("Combined", "bone_stress_risk_score", "bone_stress_risk_level"),
    )
    today = {
        "operational_alert_tier": F.col("operational_alert_tier"),
        "operational_alert_label": F.col("operational_alert_label"),
        "agreement": F.col("monitoring_signal_agreement"),
        "reason": F.col("bone_stress_risk_reason"),
        "recommendation": F.col("operational_recommendation"),
        "counterfactual": F.col("counterfactual_hint"),
        "whatif15": text_of("whatif_volume_15_summary"),
        "whatif45": text_of("whatif_volume_45_summary"),
        "whatif_best": text_of("whatif_best_scenario_summary"),
        "attribution": text_of("frontier_attribution_summary"),
        "attribution_drivers": text_of("frontier_attribution_drivers"),
        "contrastive_novelty": F.coalesce(fixed_text(col_or_null(scores, "contrastive_novelty_score")), dash),
        "archetype": text_of("reference_archetype_label"),
        "neighbors": text_of("embedding_neighbor_summary"),
        "run7_km": exact_round(or_zero("running_7d_sum_m") / 1000.0, 1),
        "accumulated_state": exact_round(or_zero("accumulated_bone_stress_state"), 1),
        "track_rows": rows,
    }
    now = F.struct(F.col(DATE).alias(DATE), *[c.alias(n) for n, c in today.items()])
    brief = recent.groupBy(ATHLETE).agg(
        F.max(F.when(F.col("_age") == 1, now)).alias("_now"), F.array_sort(F.collect_list(trend)).alias("week_trend")
    )
    last_risk = recovery.groupBy(ATHLETE).agg(
        F.max_by("risk_level", DATE).alias("recovery_risk_level"), F.max_by("risk_reason", DATE).alias("recovery_reason")
    )
    out = brief.select(ATHLETE, "_now.*", "week_trend").join(last_risk, ATHLETE, "left")
    return out.fillna("—", ["recovery_risk_level", "recovery_reason"])


# --- fixed values: explorer columns, (source, shown as) ---
EXPLORER_KM = {"running_7d_sum_m": "run7Km", "running_28d_sum_m": "run28Km", "running_distance": "runKm"}
EXPLORER_NUMBERS = {
    "bone_stress_risk_score": "combinedScore",
    "literature_bone_stress_score": "literatureScore",
    "personalized_bone_stress_score": "personalizedScore",
    "accumulated_frontier_state": "frontierScore",
    "integrated_bone_stress_score": "integratedScore",
    "accumulated_bone_stress_state": "accumulatedState",
    "recovery_strain_score": "recoveryStrain",
    "running_7d_acwr": "acwr",
    "running_progression_score": "progressionScore",
    "foster_monotony": "fosterMonotony",
    "embedding_novelty_score": "embeddingNovelty",
    "contrastive_novelty_score": "contrastiveNovelty",
    "readiness_forecast_error_score": "forecastError",
    "readiness_absolute_forecast_error_score": "absoluteForecastError",
    "risk_score": "recoveryRiskScore",
    "accumulated_risk_state": "accumulatedRecoveryState",
}
EXPLORER_TEXTS = {
    "operational_alert_tier": "tier",
    "operational_alert_label": "alertLabel",
    "monitoring_signal_agreement": "agreement",
    "bone_stress_risk_level": "combinedLevel",
    "bone_stress_risk_reason": "reason",
    "literature_bone_stress_level": "literatureLevel",
    "personalized_bone_stress_level": "personalizedLevel",
    "accumulated_frontier_level": "frontierLevel",
    "accumulated_bone_stress_level": "accumulatedLevel",
    "running_acwr_zone": "acwrZone",
    "reference_archetype_label": "archetype",
    "embedding_neighbor_summary": "neighbors",
    "frontier_attribution_summary": "attribution",
    "frontier_attribution_drivers": "attributionDrivers",
    "counterfactual_hint": "counterfactual",
    "operational_recommendation": "recommendation",
    "risk_level": "recoveryRiskLevel",
    "risk_reason": "recoveryReason",
}

# --- fixed values: insight sentences ---
INSIGHT_DIFFERS = "Literature and personalized tracks agree, but frontier differs — multivariate latent state is not matching the rule-based load picture."
INSIGHT_INVESTIGATE = "Investigate-state tier: frontier is elevated while objective load rules are modest. Check recovery markers and mixed-sport fatigue before adding intensity."
INSIGHT_FRONTIER = "Frontier high with literature not high — learned-state strain without extreme km thresholds."


def insights(df: DataFrame) -> Column:
    """Up to five rule sentences on a day; expects run km and period label."""
    run7, run28 = F.coalesce("run7Km", F.lit(0.0)), F.coalesce("run28Km", F.lit(0.0))
    state = or_zero("accumulated_bone_stress_state")
    literature = F.coalesce("literature_bone_stress_level", F.lit(""))
    attribution = col_or_null(df, "frontier_attribution_summary", "string")
    found = F.array_compact(
        F.array(
            F.when(
                (state >= 65) & (run7 < 95),
                texts(
                    "Accumulated load state is elevated (", fixed_text(state), ") while this 7-day window is only ", fixed_text(run7),
                    " km — strain is mostly carryover from earlier weeks, not this week's absolute volume.",
                ),
            ),
            F.when(F.col("monitoring_signal_agreement") == "literature_personalized_agree_frontier_differs", INSIGHT_DIFFERS),
            F.when(F.col("operational_alert_tier") == "investigate_state", INSIGHT_INVESTIGATE),
            F.when((F.col("accumulated_frontier_level") == "high") & (literature != "high"), INSIGHT_FRONTIER),
            F.when(
                (run28 >= 340) & (run7 < run28 / 4.5),
                texts("28-day running is high (", fixed_text(run28), " km) but the latest 7-day window has eased (", fixed_text(run7), " km)."),
            ),
            F.when(F.col("period_label").isNotNull(), texts("Falls inside detected load block: ", F.col("period_label"), ".")),
            F.when(attribution != "", attribution),
        )
    )
    reason = spaced(F.coalesce("bone_stress_risk_reason", F.lit("routine day")))
    routine = F.array(texts("No strong disagreement signals — dominant pattern: ", reason, "."))
    return F.when(F.size(found) > 0, F.slice(found, 1, 5)).otherwise(routine)


def explorer_days(bone: DataFrame, recovery: DataFrame, periods: DataFrame) -> DataFrame:
    """One display row per day: renamed, rounded columns and insights."""
    risk = recovery.select(ATHLETE, DATE, "risk_score", "risk_level", "risk_reason", "accumulated_risk_state")
    frame = bone.drop("risk_score", "risk_level", "risk_reason", "accumulated_risk_state").join(risk, [ATHLETE, DATE], "left")
    frame = first_period_of_day(frame, periods, "dominant_bone_stress_reason")
    label = texts(F.col("start_date"), " → ", F.col("end_date"), " (", F.col("dominant_bone_stress_reason"), ")")
    frame = frame.withColumns(
        {"period_label": F.when(F.col("period_id").isNotNull(), label)}
        | {shown: km_from_meters(source) for source, shown in EXPLORER_KM.items()}
    )
    frame = frame.withColumn("insights", insights(frame))
    numbers = [short_number(col_or_null(frame, s)).alias(n) for s, n in EXPLORER_NUMBERS.items()]
    words = [col_or_null(frame, s, "string").alias(n) for s, n in EXPLORER_TEXTS.items()]
    return frame.select(ATHLETE, DATE, *EXPLORER_KM.values(), *numbers, *words, "period_label", "insights")


def explorer_anchors(bone: DataFrame, big_week_m: float = 140000.0) -> DataFrame:
    """First and last day, day count, and the first very big week."""
    big = F.coalesce("running_7d_sum_m", F.lit(0.0)) >= big_week_m
    return bone.groupBy(ATHLETE).agg(
        F.min(DATE).alias("date_start"),
        F.max(DATE).alias("date_end"),
        F.count(F.lit(1)).alias("day_count"),
        F.min(F.when(big, F.col(DATE))).alias("big_week_date"),
    )


# --- fixed values: tiers that get a context pack ---
PACK_TIERS = ["watch", "investigate_state", "adjust_training"]


def context_packs(scores: DataFrame, periods: DataFrame, recent_days: int = 14, n: int = 5) -> DataFrame:
    """Facts for each athlete's newest flagged days, with the period around them."""
    recent = with_day(scores).withColumn("_last", F.max(DATE).over(per_athlete())).filter(F.col(DATE) >= F.date_add("_last", -recent_days))
    flagged = recent.filter(F.col("operational_alert_tier").isin(PACK_TIERS))
    newest = top_per(flagged, [ATHLETE], [F.col("day").desc()], n, rank="place")
    joined = active_period(newest, periods, "period_summary", "dominant_bone_stress_reason")
    return joined.select(
        ATHLETE, DATE, "place", "operational_alert_tier", "operational_alert_label", "monitoring_signal_agreement",
        F.col("literature_bone_stress_score").alias("literature_score"),
        F.col("personalized_bone_stress_score").alias("personalized_score"),
        F.col("accumulated_frontier_state").alias("frontier_score"), F.col("bone_stress_risk_score").alias("combined_score"),
        F.col("bone_stress_risk_reason").alias("dominant_reason"),
        exact_round(or_zero("running_7d_sum_m") / 1000.0, 1).alias("run7_km"),
        F.col("accumulated_bone_stress_state").alias("accumulated_state"), "counterfactual_hint",
        col_or_null(scores, "whatif_best_scenario_summary", "string").alias("whatif_best_scenario"),
        col_or_null(scores, "reference_archetype_label", "string").alias("reference_archetype"),
        col_or_null(scores, "embedding_neighbor_summary", "string").alias("embedding_neighbors"),
        col_or_null(scores, "frontier_attribution_summary", "string").alias("frontier_attribution"),
        col_or_null(scores, "frontier_attribution_drivers", "string").alias("frontier_drivers"),
        F.coalesce("period_summary", "dominant_bone_stress_reason").alias("period_context"),
    )
