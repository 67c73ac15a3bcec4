"""Did the tracks rise before a labelled event?  Lead times and peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions.numbers import fixed_text, texts
from paceframe.keys import ATHLETE, DATE
from paceframe.operators.daily import stack
from paceframe.operators.periods import overlapping

_EVENT = [ATHLETE, "event_id"]

# --- fixed values: interpretation sentences ---
STATE_NOTE = (
    "Scoring does not use labeled events — this check asks whether the same rules would have surfaced load "
    "beforehand. That supports validation, not prediction or diagnosis."
)
TRACK_NOTE = "Events and reference periods are for validation only — scoring never uses these dates."
OVERLAP_NOTE = "A detected bone-stress period overlapped the pre-onset symptom window."


def evaluation_targets(events: DataFrame, reference_periods: DataFrame | None = None) -> DataFrame:
    """Events and reference periods as windows with one evaluation end."""
    shaped = events.select(
        *_EVENT, "label", F.col("onset_date").alias("evaluation_end"),
        F.coalesce("symptom_window_start", "onset_date").alias("window_start"),
    )
    if reference_periods is None:
        return shaped
    periods = reference_periods.select(
        *_EVENT, "label", F.col("end_date").alias("evaluation_end"), F.col("start_date").alias("window_start")
    )
    return stack([shaped, periods])


def lookback_days(targets: DataFrame, scores: DataFrame, days: int, columns: Sequence[str]) -> DataFrame:
    """Score rows in the days before each target's end.

    The look-back is laid out as days, so the join is an equality.
    """
    offsets = F.explode(F.sequence(F.date_add("evaluation_end", -days), F.date_add("evaluation_end", -1))).alias(DATE)
    windows = targets.select(*_EVENT, "label", "evaluation_end", "window_start", offsets)
    return windows.join(scores.select(ATHLETE, DATE, *columns), [ATHLETE, DATE])


def _first(hit: Column, value: Column | None = None) -> list[Column]:
    """Date of the first hit, its lead time and, if asked, its value."""
    day = F.min(F.when(hit, F.col(DATE)))
    out = [day, F.datediff(F.max("evaluation_end"), day).cast("bigint")]
    if value is not None:
        out.append(F.min_by(value, F.when(hit, F.col(DATE))))
    return out


def first_crossings(targets: DataFrame, scores: DataFrame, column: str, thresholds: Sequence[float], days: int) -> DataFrame:
    """First day per target on which the column reaches each threshold."""
    rows = lookback_days(targets, scores, days, [column])
    aggs = []
    for t in thresholds:
        day, lead, value = _first(F.col(column) >= t, F.col(column))
        name = f"{t:g}"
        aggs += [day.alias(f"first_{name}_date"), lead.alias(f"first_{name}_lead_days"), value.alias(f"first_{name}_value")]
    return rows.groupBy(*_EVENT).agg(*aggs)


def first_signals(targets: DataFrame, scores: DataFrame, signals: dict[str, tuple[str, str]], days: int) -> DataFrame:
    """First day per target on which a label column has a given value."""
    rows = lookback_days(targets, scores, days, sorted({c for c, _ in signals.values()}))
    aggs = []
    for name, (column, value) in signals.items():
        day, lead = _first(F.col(column) == value)
        aggs += [day.alias(f"{name}_date"), lead.alias(f"{name}_lead_days")]
    return rows.groupBy(*_EVENT).agg(*aggs)


def window_peaks(targets: DataFrame, scores: DataFrame, days: int = fixed.LOOKBACK_DAYS) -> DataFrame:
    """The row with the highest state before each target; earliest of equals."""
    columns = ["accumulated_bone_stress_state", "bone_stress_risk_score", "running_7d_sum_m", "bone_stress_risk_level"]
    rows = lookback_days(targets, scores, days, columns)
    state = F.col("accumulated_bone_stress_state")
    best = F.max(F.struct(state.alias("state"), -F.unix_date(DATE), DATE, "bone_stress_risk_score", "running_7d_sum_m"))
    peaks = rows.groupBy(*_EVENT).agg(
        best.alias("_p"), F.count_if(F.col("bone_stress_risk_level") == "high").alias("high_bone_stress_days_in_window")
    )
    return peaks.select(
        *_EVENT, F.col(f"_p.{DATE}").alias("peak_accumulated_state_date"),
        F.col("_p.state").alias("peak_accumulated_bone_stress_state"),
        F.col("_p.bone_stress_risk_score").alias("peak_bone_stress_risk_score"),
        (F.col("_p.running_7d_sum_m") / 1000.0).alias("peak_running_7d_km"), "high_bone_stress_days_in_window",
    )


def evaluate_events(
    events: DataFrame,
    scores: DataFrame,
    periods: DataFrame,
    days: int = fixed.LOOKBACK_DAYS,
    thresholds: Sequence[float] = fixed.STATE_THRESHOLDS,
) -> DataFrame:
    """Peak, threshold crossings and overlapping periods before each event."""
    targets = evaluation_targets(events)
    state = "accumulated_bone_stress_state"
    met = overlapping(targets, periods, ["event_id"], "window_start", "evaluation_end")
    overlaps = met.groupBy(*_EVENT).agg(
        F.count(F.lit(1)).alias("overlapping_periods"),
        F.min_by("period_id", "overlap_rank").alias("top_overlapping_period"),
    )
    joined = (
        targets.join(window_peaks(targets, scores, days), _EVENT, "left")
        .join(first_crossings(targets, scores, state, thresholds, days), _EVENT, "left")
        .join(overlaps, _EVENT, "left")
    )
    joined = joined.withColumns(
        {
            "overlapping_periods": F.coalesce("overlapping_periods", F.lit(0)).cast("bigint"),
            "detected_warning_period": F.col("overlapping_periods").isNotNull(),
        }
    )
    return joined.withColumn("interpretation", _event_interpretation())


def _event_interpretation() -> Column:
    crossed = texts(
        "Before ", F.col("label"), ", accumulated bone-stress state crossed the high threshold (",
        F.col("first_65_lead_days"), " days before configured onset).",
    )
    peaked = texts(
        "Before ", F.col("label"), ", accumulated bone-stress state peaked at ",
        fixed_text("peak_accumulated_bone_stress_state"), " within the lookback window.",
    )
    parts = [
        F.when(F.col("first_65_lead_days").isNotNull(), crossed).when(F.col("peak_accumulated_bone_stress_state") > 0, peaked),
        F.when(F.col("detected_warning_period"), OVERLAP_NOTE),
        F.lit(STATE_NOTE),
    ]
    return F.concat_ws(" ", *parts)


# --- fixed values: signals of the track evaluation ---
TRACK_SIGNALS = {
    "literature_high": ("literature_bone_stress_level", "high"),
    "personalized_high": ("personalized_bone_stress_level", "high"),
    "frontier_high": ("accumulated_frontier_level", "high"),
    "all_agree": ("monitoring_signal_agreement", "all_agree"),
    "mixed_signals": ("monitoring_signal_agreement", "mixed_signals"),
}
TRACK_THRESHOLDS = {"frontier_state_70": "accumulated_frontier_state", "integrated_score_70": "integrated_bone_stress_score"}
TRACK_PEAKS = [
    "accumulated_frontier_state",
    "literature_bone_stress_score",
    "personalized_bone_stress_score",
    "bone_stress_risk_score",
]


def evaluate_tracks(targets: DataFrame, scores: DataFrame, days: int = fixed.LOOKBACK_DAYS) -> DataFrame:
    """Counts, first signals and peaks of all tracks before each target.

    Both windows (look-back and symptom window) are covered by one laid-out
    join, whatever their order, and one conditional aggregation.
    """
    columns = sorted({c for c, _ in TRACK_SIGNALS.values()} | set(TRACK_PEAKS) | {"integrated_bone_stress_score", "bone_stress_risk_level"})
    earliest = F.least(F.date_add("evaluation_end", -days), F.col("window_start"))
    spans = targets.filter(F.col("evaluation_end") > earliest)
    all_days = F.explode(F.sequence(earliest, F.date_add("evaluation_end", -1))).alias(DATE)
    windows = spans.select(*_EVENT, "label", "evaluation_end", "window_start", all_days)
    rows = windows.join(scores.select(ATHLETE, DATE, *columns), [ATHLETE, DATE])
    inside = F.col(DATE) >= F.date_add("evaluation_end", -days)
    aggs = [F.count_if(inside).alias("days_in_window")]
    for name, (column, value) in TRACK_SIGNALS.items():
        hit = inside & (F.col(column) == value)
        day, lead = _first(hit)
        aggs += [F.count_if(hit).alias(f"{name}_days"), day.alias(f"{name}_date"), lead.alias(f"{name}_lead_days")]
    literature_high = F.coalesce(F.col("literature_bone_stress_level") == "high", F.lit(False))
    aggs.append(
        F.count_if(inside & (F.col("accumulated_frontier_level") == "high") & ~literature_high).alias(
            "frontier_high_literature_not_days"
        )
    )
    for name, column in TRACK_THRESHOLDS.items():
        day, lead, value = _first(inside & (F.col(column) >= 70.0), F.col(column))
        aggs += [day.alias(f"{name}_date"), lead.alias(f"{name}_lead_days"), value.alias(f"{name}_value")]
    aggs += [F.max(F.when(inside, F.col(c))).alias(f"peak_{c}") for c in TRACK_PEAKS]
    symptomatic = (F.col(DATE) >= F.col("window_start")) & (F.col("bone_stress_risk_level") == "high")
    aggs.append(F.count_if(symptomatic).alias("pre_symptom_high_days"))
    found = rows.groupBy(*_EVENT).agg(*aggs)
    joined = targets.join(found, _EVENT, "left")
    return joined.withColumn("interpretation", _track_interpretation())


def _track_interpretation() -> Column:
    """One sentence on the first signals; the lead difference keeps its sign."""
    fro, lit = F.col("frontier_high_lead_days"), F.col("literature_high_lead_days")
    both = texts(
        "Before ", F.col("label"), ", frontier high preceded literature high by ", lit - fro, " days (frontier ", fro,
        "d, literature ", lit, "d lead).",
    )
    only_frontier = texts("Before ", F.col("label"), ", frontier flagged high with ", fro, " days lead.")
    only_literature = texts("Before ", F.col("label"), ", literature flagged high with ", lit, " days lead.")
    agreed = texts(
        "All three tracks agreed on ", F.col("all_agree_date"), " (", F.col("all_agree_lead_days"), " days before)."
    )
    parts = [
        F.when(fro.isNotNull() & lit.isNotNull(), both)
        .when(fro.isNotNull(), only_frontier)
        .when(lit.isNotNull(), only_literature),
        F.when(F.col("all_agree_date").isNotNull(), agreed),
        F.lit(TRACK_NOTE),
    ]
    return F.concat_ws(" ", *parts)
