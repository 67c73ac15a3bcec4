"""Operational tiers, hints and recommendations for a scored day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe.functions.numbers import fixed_text, or_zero, spaced, texts

# --- fixed values: tiers and labels ---
TIER_LABELS = {
    "adjust_training": "Adjust training",
    "investigate_state": "Investigate state",
    "watch": "Watch",
    "clear": "Clear",
}

# --- fixed values: hint and recommendation texts ---
HINT_HARD = "Replace the next hard run with easy volume or cross-training; intensity is contributing more than distance."
HINT_FRONTIER = (
    "Learned state is elevated without extreme load — prioritize sleep, HRV, and readiness before adding intensity."
)
HINT_DEFAULT = "Keep progression gradual over the next 7 days."
INVESTIGATE_TEXT = (
    "Multivariate strain is elevated while objective load rules are modest. "
    "Check readiness, sleep, and mixed-sport fatigue before progressing. "
)
CLEAR_TEXT = "No elevated running-load action needed today."


def _is(column: str, value: str) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


def alert_tier() -> Column:
    """Tier from the three levels and their agreement."""
    lit, per, fro = ("literature_bone_stress_level", "personalized_bone_stress_level", "accumulated_frontier_level")
    agreement = "monitoring_signal_agreement"
    any_high = _is(lit, "high") | _is(per, "high") | _is(fro, "high")
    any_moderate = _is(lit, "moderate") | _is(per, "moderate") | _is(fro, "moderate")
    return (
        F.when(_is(agreement, "all_agree") & any_high, "adjust_training")
        .when(_is(lit, "high") & _is(per, "high"), "adjust_training")
        .when(_is(agreement, "mixed_signals") & (_is(per, "high") | _is(fro, "high")), "adjust_training")
        .when(_is(fro, "high") & ~_is(lit, "high"), "investigate_state")
        .when(any_high | any_moderate, "watch")
        .otherwise("clear")
    )


def tier_label(tier: Column) -> Column:
    chain = None
    for name, label in TIER_LABELS.items():
        chain = F.when(tier == name, label) if chain is None else chain.when(tier == name, label)
    return chain.otherwise(tier)


def counterfactual_hint() -> Column:
    """What would most likely lower the alert."""
    reason = F.coalesce("bone_stress_risk_reason", F.lit(""))
    km = or_zero("running_7d_sum_m") / 1000.0
    progression = texts(
        "A ~15% reduction in 7-day running volume (from ", fixed_text(km), " km toward ",
        fixed_text(F.greatest(km * 0.85, F.lit(0.0))), " km) would likely lower progression pressure.",
    )
    volume = texts(
        "Sustained volume is the driver (~", fixed_text(km), " km/week). "
        "A recovery week at 50–60% of recent weekly km would reduce accumulated load.",
    )
    frontier = _is("accumulated_frontier_level", "high") & ~_is("literature_bone_stress_level", "high")
    return (
        F.when(reason.contains("progression"), progression)
        .when(reason.contains("volume") | reason.contains("sustained"), volume)
        .when(reason.contains("hard running session"), HINT_HARD)
        .when(frontier, HINT_FRONTIER)
        .when(km > 0, texts("Moderate 7-day running (", fixed_text(km), " km); avoid stacking hard sessions this week."))
        .otherwise(HINT_DEFAULT)
    )


def recommendation() -> Column:
    tier, hint = F.col("operational_alert_tier"), F.col("counterfactual_hint")
    reason = spaced(F.coalesce("bone_stress_risk_reason", F.lit("elevated context")))
    return (
        F.when(
            tier == "adjust_training",
            texts("Reduce running volume or intensity this week. Dominant pattern: ", reason, ". ", hint),
        )
        .when(tier == "investigate_state", texts(INVESTIGATE_TEXT, hint))
        .when(tier == "watch", texts("Monitor closely — ", reason, ". ", hint))
        .otherwise(CLEAR_TEXT)
    )


def add_alerts(scores: DataFrame) -> DataFrame:
    """Tier, label, hint and recommendation columns."""
    frame = scores.withColumns({"operational_alert_tier": alert_tier(), "counterfactual_hint": counterfactual_hint()})
    return frame.withColumns(
        {
            "operational_alert_label": tier_label(F.col("operational_alert_tier")),
            "operational_recommendation": recommendation(),
        }
    )
