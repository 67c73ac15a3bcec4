"""Running bone-stress track: literature, personalized and combined scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions import risk
from paceframe.functions.numbers import clamp, total
from paceframe.keys import ATHLETE, DATE, DAY, with_day
from paceframe.operators.state import linear_carry
from paceframe.operators.trailing import Rank, RollingRank, add_ranks, monotony, previous_rows, rolling_max

# --- fixed values: reason names, in the order ties are settled ---
REASONS = [
    "running while under-recovered",
    "sustained high running volume",
    "running volume progression",
    "running monotony block",
    "running load spike",
    "elevated running workload ratio",
    "hard running session",
    "elevated running intensity block",
]
LOW_REASON = "low running bone-stress context"
PROGRESSION_REASONS = [
    "running volume progression",
    "running monotony block",
    "sustained high running volume",
    "elevated running workload ratio",
]
VOLUME_REASONS = ["sustained high running volume", "running volume progression", "running monotony block"]

# --- fixed values: recovery markers and their weights ---
RECOVERY_MARKERS = ["readiness", "hrv", "resting_hr", "sleep", "body_battery_charged", "body_battery_drained"]

# --- fixed values: output columns ---
OUTPUT_COLUMNS = [
    "bone_stress_risk_score",
    "literature_bone_stress_score",
    "personalized_bone_stress_score",
    "literature_bone_stress_level",
    "personalized_bone_stress_level",
    "running_acwr_zone",
    "running_edwards_speed_band",
    "foster_monotony",
    "foster_strain",
    "bone_stress_severity_score",
    "bone_stress_risk_level",
    "bone_stress_risk_reason",
    "recovery_strain_score",
    "running_7d_load_score",
    "running_28d_load_score",
    "running_7d_volume_score",
    "running_28d_volume_score",
    "running_intensity_score",
    "running_workout_score",
    "running_acwr_score",
    "running_progression_score",
    "running_monotony_score",
    "run_under_recovered_score",
    "running_7d_sum_m",
    "running_28d_sum_m",
    "running_7d_load_sum",
    "running_28d_load_sum",
    "running_avg_speed",
    "running_max_speed",
    "running_aerobic_te",
    "running_anaerobic_te",
    "running_distance",
    "previous_day_running_distance",
]
STATE_COLUMNS = [
    "daily_bone_stress_contribution",
    "accumulated_bone_stress_state",
    "accumulated_bone_stress_level",
    "bone_stress_carryover_score",
]


def recovery_ranks(days: int) -> list[Rank]:
    """Percentile risks of the recovery markers; low is bad for most."""
    return [
        Rank("_readiness_rank", "readiness", high=False, days=days),
        Rank("hrv_risk", "hrv", high=False, days=days),
        Rank("resting_hr_risk", "resting_hr", days=days),
        Rank("sleep_risk", "sleep", high=False, days=days),
        Rank("_charged_risk", "body_battery_charged", high=False, days=days),
        Rank("_drained_risk", "body_battery_drained", days=days),
    ]


def recovery_strain(df: DataFrame) -> DataFrame:
    """Combine the marker risks; expects the columns of ``recovery_ranks``."""
    frame = df.withColumns(
        {
            "readiness_risk": F.greatest(risk.readiness_risk("readiness"), F.col("_readiness_rank")),
            "body_battery_risk": F.greatest("_charged_risk", "_drained_risk"),
        }
    )
    strain = (
        0.45 * F.col("readiness_risk")
        + 0.2 * F.col("hrv_risk")
        + 0.15 * F.col("resting_hr_risk")
        + 0.1 * F.col("sleep_risk")
        + 0.1 * F.col("body_battery_risk")
    )
    return frame.withColumn("recovery_strain_score", clamp(strain)).drop("_readiness_rank", "_charged_risk", "_drained_risk")


def score_recovery_strain(df: DataFrame, baseline_days: int = fixed.BASELINE_DAYS) -> DataFrame:
    """Recovery strain alone, for tables that need nothing else."""
    return recovery_strain(add_ranks(df, recovery_ranks(baseline_days)))


def literature_track(df: DataFrame) -> DataFrame:
    """Rule-only score: needs the running sums, no personal history."""
    frame = monotony(df)
    frame = frame.withColumn("run7_km", F.coalesce("running_7d_sum_m", F.lit(0.0)) / 1000.0)
    score = risk.literature_score("running_7d_acwr", "running_avg_speed", "run7_km", "foster_monotony", "foster_strain")
    frame = frame.withColumn("literature_bone_stress_score", score)
    return frame.withColumn("literature_bone_stress_level", risk.level("literature_bone_stress_score"))


def _ranks(days: int) -> tuple[list[Rank], list[RollingRank]]:
    long = max(days * 2, 56)
    ranks = [
        Rank("_prior_load", "running_bone_stress_load", "prev_running_bone_stress_load", days=days),
        Rank("_prior_duration", "running_duration", "prev_running_duration", days=days),
        Rank("_prior_distance", "running_distance", "prev_running_distance", days=days),
        Rank("_load", "running_bone_stress_load", days=days),
        Rank("_duration", "running_duration", days=days),
        Rank("_distance", "running_distance", days=days),
        Rank("_acwr", "running_7d_acwr", days=days),
        Rank("_aerobic", "running_aerobic_te", days=days),
        Rank("_anaerobic", "running_anaerobic_te", days=days),
        Rank("_speed", "running_avg_speed", days=days),
        Rank("_top_speed", "running_max_speed", days=days),
        Rank("_hr", "running_avg_hr", days=days),
        Rank("_top_hr", "running_max_hr", days=days),
    ]
    rolling = [
        RollingRank("_load_7d", "running_bone_stress_load", 7, days),
        RollingRank("_load_28d", "running_bone_stress_load", 28, long),
        RollingRank("_volume_7d", "running_distance", 7, days),
        RollingRank("_volume_28d", "running_distance", 28, long),
        RollingRank("_speed_7d", "running_avg_speed", 7, days, mean=True),
    ]
    return ranks + recovery_ranks(days), rolling


def _components(df: DataFrame) -> DataFrame:
    """Ranks blended with absolute rules."""
    blended = risk.blended
    frame = df.withColumns(
        {
            "_run28_km": F.coalesce("running_28d_sum_m", F.lit(0.0)) / 1000.0,
            "_day_km": F.coalesce("running_distance", F.lit(0.0)) / 1000.0,
            "_abs_workout": risk.workout_risk("running_aerobic_te", "running_anaerobic_te"),
            "_abs_intensity": risk.intensity_risk(
                "running_avg_speed", "running_max_speed", "running_aerobic_te", "running_anaerobic_te"
            ),
            "_abs_volume": risk.volume_risk("run7_km"),
            "_abs_acwr": risk.acwr_risk("running_7d_acwr"),
            "_prior_run": F.greatest("_prior_load", "_prior_duration", "_prior_distance"),
            "_same_day": F.greatest("_load", "_duration", "_distance"),
            "_workout_rank": clamp(F.greatest(F.col("_aerobic"), F.col("_anaerobic") * 1.1)),
            "_speed_rank": F.greatest("_speed", "_top_speed", "_speed_7d"),
            "_hr_rank": F.greatest("_hr", "_top_hr"),
            "running_monotony_score": risk.monotony_risk("foster_monotony"),
        }
    )
    frame = frame.withColumns(
        {
            "_intensity_rank": clamp(F.greatest(F.col("_speed_rank"), F.col("_hr_rank") * 0.85, F.col("_workout_rank") * 0.85)),
            "_hard": risk.hard_session("running_avg_speed", "_day_km"),
            "_factor": risk.volume_factor("_abs_volume"),
            "running_7d_load_score": blended("_load_7d", "_abs_volume"),
            "running_28d_load_score": blended("_load_28d", risk.volume_risk("_run28_km")),
            "running_7d_volume_score": F.col("_volume_7d"),
            "running_28d_volume_score": F.col("_volume_28d"),
            "running_acwr_score": blended("_acwr", "_abs_acwr"),
            "running_progression_score": risk.progression_risk("running_7d_acwr", "_volume_7d", "_load_7d", "run7_km"),
            "run_under_recovered_score": clamp(F.col("_same_day") * F.col("recovery_strain_score") / 100.0),
        }
    )
    return frame.withColumns(
        {
            "running_workout_score": blended("_workout_rank", "_abs_workout"),
            "running_intensity_score": blended("_intensity_rank", "_abs_intensity"),
            "_monotony_now": clamp(F.col("running_monotony_score") * F.col("_factor")),
        }
    )


def _combined(df: DataFrame) -> DataFrame:
    """Personalized score, chronic load and the combined risk with its caps."""
    load7, load28 = F.col("running_7d_load_score"), F.col("running_28d_load_score")
    strain = F.col("recovery_strain_score")
    chronic = clamp(F.greatest(load7, load28 * 0.9, F.col("_prior_run"), F.col("running_7d_volume_score") * 0.85))
    frame = df.withColumn("_chronic_base", chronic)
    monotone = clamp(F.greatest(F.col("_chronic_base"), (load7 + load28) / 2.0))
    frame = frame.withColumns(
        {
            "_chronic": F.when(F.col("_monotony_now") >= 35, monotone).otherwise(F.col("_chronic_base")),
            "personalized_bone_stress_score": clamp(
                0.25 * load7
                + 0.18 * load28
                + 0.15 * F.col("running_progression_score")
                + 0.12 * F.col("running_intensity_score")
                + 0.12 * F.col("running_workout_score")
                + 0.10 * F.col("running_acwr_score")
                + 0.08 * F.col("_monotony_now")
            ),
            "_acwr_spike": clamp(0.55 * F.col("running_acwr_score") + 0.45 * load7),
        }
    )
    hard_effort = clamp(0.55 * F.col("running_intensity_score") + 0.45 * F.col("running_workout_score"))
    frame = frame.withColumns(
        {
            "_suppressed": F.col("_chronic") * (0.3 + 0.7 * strain / 100.0),
            "_monotony_block": F.when(F.col("_monotony_now") >= 45, F.col("_chronic") * 0.65).otherwise(
                F.col("_monotony_now") * 0.45
            ),
            "_intensity_block": hard_effort * (0.35 + 0.65 * F.col("_chronic") / 100.0) * F.col("_factor"),
            "_hard_block": (F.col("_abs_intensity") >= 50) & F.col("_hard"),
        }
    )
    personal = F.col("personalized_bone_stress_score")
    raw = clamp(
        F.greatest(
            clamp(0.50 * F.col("literature_bone_stress_score") + 0.50 * personal),
            personal,
            F.col("_suppressed") * 0.9,
            F.col("run_under_recovered_score"),
            F.col("running_progression_score") * 0.92,
            F.when(F.col("_monotony_now") >= 50, F.col("_monotony_block") * 0.85).otherwise(0.0),
            F.col("_acwr_spike") * 0.85,
            F.when(F.col("_hard_block"), F.col("_intensity_block") * 0.8).otherwise(0.0),
            F.col("_same_day") * strain / 120.0,
        )
    )
    frame = frame.withColumn("_risk_before_caps", raw)
    quiet = (load7 < 25) & (load28 < 25) & (F.col("_same_day") < 25) & (F.col("running_intensity_score") < 25)
    capped = (
        F.when(F.coalesce(F.col("running_7d_sum_m") < 1000, F.lit(True)), F.least(F.col("_risk_before_caps"), F.lit(15.0)))
        .when(quiet, F.least(F.col("_risk_before_caps"), F.lit(20.0)))
        .otherwise(F.col("_risk_before_caps"))
    )
    frame = frame.withColumns(
        {
            "bone_stress_severity_score": risk.severity(
                "_risk_before_caps", "running_7d_load_score", "running_28d_load_score", "running_workout_score", F.col("_hard")
            ),
            "bone_stress_risk_score": capped,
        }
    )
    return frame.withColumns(
        {
            "bone_stress_risk_level": risk.level("bone_stress_risk_score"),
            "personalized_bone_stress_level": risk.level("personalized_bone_stress_score"),
            "running_acwr_zone": risk.acwr_zone("running_7d_acwr"),
            "running_edwards_speed_band": risk.speed_band("running_avg_speed"),
        }
    )


def rank_reasons(scores: list[Column], names: list[str]) -> Column:
    """Candidates as an array, highest score first, given order among equals."""
    entries = [
        F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(n).alias("name"))
        for i, (s, n) in enumerate(zip(scores, names))
    ]
    return F.sort_array(F.array(*entries), asc=False)


def _reason(df: DataFrame) -> DataFrame:
    """Strongest candidate, unless a preferred family comes close to it."""
    strain, chronic = F.col("recovery_strain_score"), F.col("_chronic")
    volume_block = clamp(F.greatest(F.col("_suppressed"), chronic * 0.85, F.col("personalized_bone_stress_score")))
    hard = clamp(0.6 * F.col("running_workout_score") + 0.4 * F.col("running_intensity_score"))
    progression = F.col("running_progression_score")
    ramping = (F.col("_abs_workout") < 50) & (F.col("_abs_acwr") >= 35)
    candidates = [
        F.col("run_under_recovered_score"),
        F.when(F.col("_abs_volume") >= 55, volume_block).otherwise(volume_block * 0.65),
        F.when(ramping, clamp(F.greatest(progression, progression * 1.08))).otherwise(progression),
        F.col("_monotony_block"),
        F.greatest(F.col("_same_day") * strain / 100.0, F.col("_prior_run") * 0.9),
        F.col("_acwr_spike"),
        F.when(F.col("_hard"), hard).otherwise(0.0),
        F.when(F.col("_hard_block"), F.col("_intensity_block")).otherwise(0.0),
    ]
    frame = df.withColumn("_ranked", rank_reasons(candidates, REASONS))
    ranked = F.col("_ranked")
    top = ranked[0]

    def preferred(names: list[str], share: float) -> Column:
        near = F.filter(ranked, lambda e: e["name"].isin(names) & (e["score"] >= top["score"] * share))
        return F.coalesce(F.get(near, F.lit(0))["name"], top["name"])

    easy_volume = (F.col("run7_km") >= 85) & (F.col("_day_km") < F.col("run7_km") / 5.0)
    reason = (
        F.when(F.col("bone_stress_risk_level") == "low", LOW_REASON)
        .when((F.col("_abs_workout") < 50) & (F.col("_abs_volume") < 70), preferred(PROGRESSION_REASONS, 0.85))
        .when(easy_volume, preferred(VOLUME_REASONS, 0.80))
        .otherwise(top["name"])
    )
    return frame.withColumn("bone_stress_risk_reason", reason)


# --- fixed values: the columns of the enriched table that scoring reads ---
INPUT_COLUMNS = [
    "readiness", "hrv", "resting_hr", "sleep", "body_battery_charged", "body_battery_drained", "running_distance",
    "running_duration", "running_avg_speed", "running_max_speed", "running_avg_hr", "running_max_hr",
    "running_aerobic_te", "running_anaerobic_te", "running_bone_stress_load", "running_7d_load_sum",
    "running_28d_load_sum", "running_7d_sum_m", "running_28d_sum_m", "running_7d_acwr",
]


def score_bone_stress(enriched: DataFrame, baseline_days: int = fixed.BASELINE_DAYS) -> DataFrame:
    """All bone-stress scores of every day of an enriched running table."""
    inputs = with_day(enriched).select(ATHLETE, DATE, DAY, *INPUT_COLUMNS)
    frame = previous_rows(inputs, ["running_bone_stress_load", "running_duration", "running_distance"])
    frame = literature_track(frame)
    ranks, rolling = _ranks(baseline_days)
    frame = recovery_strain(add_ranks(frame, ranks, rolling))
    frame = _reason(_combined(_components(frame)))
    frame = frame.withColumn("previous_day_running_distance", F.col("prev_running_distance"))
    return frame.select(ATHLETE, DATE, DAY, "running_duration", *OUTPUT_COLUMNS)


def bone_contribution() -> Column:
    return clamp(
        total(
            [
                0.22 * F.col("running_7d_load_score"),
                0.22 * F.col("running_28d_load_score"),
                0.15 * F.col("running_progression_score"),
                0.16 * F.col("running_intensity_score"),
                0.12 * F.col("running_workout_score"),
                0.13 * F.col("running_monotony_score"),
            ]
        )
    )


def accumulate_bone_stress(scores: DataFrame, decay: float = fixed.BONE_DECAY) -> DataFrame:
    """Carried state, its level, and the highest recent state."""
    frame = scores.withColumn("daily_bone_stress_contribution", bone_contribution())
    frame = linear_carry(frame, "daily_bone_stress_contribution", "accumulated_bone_stress_state", decay)
    frame = frame.withColumn("accumulated_bone_stress_level", risk.state_level("accumulated_bone_stress_state"))
    return rolling_max(frame, "accumulated_bone_stress_state", "bone_stress_carryover_score", fixed.CARRYOVER_ROWS)


def bone_stress_history(enriched: DataFrame, baseline_days: int = fixed.BASELINE_DAYS) -> DataFrame:
    return accumulate_bone_stress(score_bone_stress(enriched, baseline_days))
