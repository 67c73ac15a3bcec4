"""Recovery-risk track: workload, tissue, rest and novelty against recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions import risk
from paceframe.functions.numbers import clamp
from paceframe.keys import ATHLETE, DATE, has, with_day
from paceframe.operators.embeddings import normalised
from paceframe.operators.running import enrich_running
from paceframe.operators.state import linear_carry
from paceframe.operators.trailing import Rank, RollingRank, add_ranks, insufficient_rest, previous_rows
from paceframe.plans.bone_stress import recovery_ranks, recovery_strain

# --- fixed values: columns whose previous row is read ---
PREVIOUS = ["load", "duration", "distance", "impact_duration", "impact_distance", "fatigue_duration", "running_duration", "running_distance", "cycling_distance"]

# --- fixed values: output columns ---
OUTPUT_COLUMNS = [
    "risk_score", "risk_level", "risk_reason", "state_novelty_score", "raw_anomaly_zscore", "recovery_strain_score",
    "prior_workload_score", "tissue_load_score", "metabolic_fatigue_score", "preparedness_mismatch_score",
    "run_under_recovered_score", "rest_context_score", "insufficient_rest_score", "readiness", "hrv", "resting_hr",
    "load", "duration", "distance", "previous_day_load", "previous_day_duration", "previous_day_distance",
    "previous_day_impact_duration", "previous_day_running_distance", "previous_day_cycling_distance",
    "running_duration", "running_distance", "cycling_duration", "cycling_distance", "impact_duration",
    "fatigue_duration", "readiness_risk", "hrv_risk", "resting_hr_risk", "sleep_risk", "body_battery_risk",
]
INPUT_COLUMNS = [
    "state_novelty_score", "readiness", "hrv", "resting_hr", "sleep", "body_battery_charged", "body_battery_drained",
    "load", "duration", "distance", "impact_duration", "impact_distance", "fatigue_duration", "running_duration",
    "running_distance", "cycling_duration", "cycling_distance",
]
STATE_COLUMNS = ["daily_strain_contribution", "accumulated_risk_state", "accumulated_risk_level"]


def recovery_inputs(embeddings: DataFrame, daily: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Embedding days with their daily columns and a 0..100 novelty score."""
    frame = enrich_running(embeddings.join(daily, [ATHLETE, DATE], "left"), totals)
    zscore = F.col("anomaly_zscore") if has(frame, "anomaly_zscore") else F.lit(0.0)
    return frame.withColumn("state_novelty_score", normalised(zscore))


def _ranks(days: int) -> tuple[list[Rank], list[RollingRank]]:
    previous = [
        Rank(f"_prior_{c}", c, f"prev_{c}", days=days)
        for c in PREVIOUS
        if c != "cycling_distance"
    ]
    current = [Rank(f"_low_{c}", c, high=False, days=days) for c in ("duration", "distance", "load")]
    running = [Rank(f"_now_{c}", c, days=days) for c in ("running_duration", "running_distance")]
    return previous + current + running + recovery_ranks(days), [RollingRank("_recent_load", "load", 7, days)]


def _risk_reason() -> Column:
    strain, rest = F.col("recovery_strain_score"), F.col("rest_context_score")
    under, tissue = F.col("_under"), F.col("_tissue_mismatch")
    delayed, alone, pile = F.col("_delayed"), F.col("_alone"), F.col("_accumulated")
    low = F.col("risk_level") == "low"
    return (
        F.when(low & (rest >= 70) & (strain < 35), "low-risk rest/easy day")
        .when(low & (F.col("state_novelty_score") >= 70) & (strain < 35), "novel but not clearly risky")
        .when(low, "low risk")
        .when((under >= F.greatest(delayed, tissue, alone, pile)) & (under >= 35), "running while under-recovered")
        .when((tissue >= F.greatest(delayed, alone, pile)) & (tissue >= 35), "tissue-load recovery mismatch")
        .when((delayed >= F.greatest(alone, pile)) & (delayed >= 35), "post-load recovery response")
        .when((pile >= F.greatest(delayed, alone)) & (pile >= 35), "accumulated insufficient rest")
        .when(alone >= 35, "poor recovery markers")
        .otherwise("low risk")
    )


def score_recovery_risk(inputs: DataFrame, baseline_days: int = fixed.BASELINE_DAYS) -> DataFrame:
    """Risk score, level and reason of every input day."""
    wanted = [c for c in ("split", "anomaly_zscore") if has(inputs, c)] + INPUT_COLUMNS
    frame = with_day(inputs).select(ATHLETE, DATE, "day", *wanted)
    frame = insufficient_rest(previous_rows(frame, PREVIOUS))
    ranks, rolling = _ranks(baseline_days)
    frame = recovery_strain(add_ranks(frame, ranks, rolling))
    impact = F.greatest("_prior_impact_duration", "_prior_impact_distance")
    running = F.greatest("_prior_running_duration", "_prior_running_distance")
    frame = frame.withColumns(
        {
            "prior_workload_score": clamp(
                F.greatest("_prior_load", "_prior_duration", "_prior_distance", "_prior_fatigue_duration", "_recent_load")
            ),
            "tissue_load_score": clamp(F.greatest(impact, running)),
            "metabolic_fatigue_score": clamp(F.greatest("_prior_load", "_prior_fatigue_duration", "_recent_load")),
            "rest_context_score": clamp(0.4 * F.col("_low_duration") + 0.4 * F.col("_low_distance") + 0.2 * F.col("_low_load")),
        }
    )
    strain = F.col("recovery_strain_score")
    frame = frame.withColumns(
        {
            "_delayed": F.col("prior_workload_score") * strain / 100.0,
            "_tissue_mismatch": F.col("tissue_load_score") * strain / 100.0,
            "_under": F.greatest("_now_running_duration", "_now_running_distance") * strain / 100.0,
            "_alone": strain * 0.75,
            "_accumulated": F.col("insufficient_rest_score") * 0.65,
            "_novelty": F.when(strain >= 40, F.col("state_novelty_score") * 0.15).otherwise(0.0),
        }
    )
    frame = frame.withColumn("preparedness_mismatch_score", clamp(F.greatest("_delayed", "_tissue_mismatch", "_under")))
    raw = F.greatest("preparedness_mismatch_score", "_alone", "_accumulated") + F.col("_novelty")
    resting = (F.col("rest_context_score") >= 70) & (strain < 35) & (F.col("prior_workload_score") < 60)
    frame = frame.withColumn("risk_score", clamp(F.when(resting, raw * 0.35).otherwise(raw)))
    frame = frame.withColumn("risk_level", risk.level("risk_score"))
    frame = frame.withColumns(
        {
            "risk_reason": _risk_reason(),
            "run_under_recovered_score": clamp(F.col("_under")),
            "raw_anomaly_zscore": F.col("anomaly_zscore") if has(frame, "anomaly_zscore") else F.lit(None).cast("double"),
            "previous_day_load": F.col("prev_load"),
            "previous_day_duration": F.col("prev_duration"),
            "previous_day_distance": F.col("prev_distance"),
            "previous_day_impact_duration": F.col("prev_impact_duration"),
            "previous_day_running_distance": F.col("prev_running_distance"),
            "previous_day_cycling_distance": F.col("prev_cycling_distance"),
        }
    )
    split = ["split"] if has(frame, "split") else []
    return frame.select(ATHLETE, DATE, "day", *split, *OUTPUT_COLUMNS)


def recovery_contribution() -> Column:
    return clamp(
        0.35 * F.col("recovery_strain_score")
        + 0.25 * F.col("metabolic_fatigue_score")
        + 0.20 * F.col("tissue_load_score")
        + 0.20 * F.col("insufficient_rest_score")
    )


def accumulate_recovery_risk(scores: DataFrame, decay: float = fixed.RECOVERY_DECAY) -> DataFrame:
    """Carried recovery-risk state and its level."""
    frame = scores.withColumn("daily_strain_contribution", recovery_contribution())
    frame = linear_carry(frame, "daily_strain_contribution", "accumulated_risk_state", decay)
    return frame.withColumn("accumulated_risk_level", risk.state_level("accumulated_risk_state"))


def recovery_history(inputs: DataFrame, baseline_days: int = fixed.BASELINE_DAYS) -> DataFrame:
    return accumulate_recovery_risk(score_recovery_risk(inputs, baseline_days))
