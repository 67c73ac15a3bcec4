"""Risk ladders and the literature score, as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions.numbers import ColumnLike, clamp, col, ladder, or_zero


def level(score: ColumnLike) -> Column:
    """high from 70, moderate from 45; a missing score reads as low."""
    x = col(score)
    return F.when(x >= fixed.LEVEL_HIGH, "high").when(x >= fixed.LEVEL_MODERATE, "moderate").otherwise("low")


def known_level(score: ColumnLike) -> Column:
    """As ``level``, but null without a score."""
    return F.when(col(score).isNotNull(), level(score))


def state_level(state: ColumnLike) -> Column:
    x = col(state)
    return F.when(x >= fixed.STATE_HIGH, "high").when(x >= fixed.STATE_MODERATE, "moderate").otherwise("low")


def readiness_risk(value: ColumnLike) -> Column:
    return F.when(col(value).isNull(), 0.0).otherwise(ladder(value, fixed.READINESS_RISK, 0.0))


def blended(relative: ColumnLike, absolute: ColumnLike, weight: float = 0.45) -> Column:
    return clamp(weight * col(relative) + (1.0 - weight) * col(absolute))


def acwr_risk(ratio: ColumnLike) -> Column:
    r = col(ratio)
    return (
        F.when(r.isNull(), 0.0)
        .when(r < fixed.ACWR_LOW, fixed.ACWR_RISK_BELOW_LOW)
        .otherwise(ladder(r, fixed.ACWR_RISK, fixed.ACWR_RISK_ABOVE))
    )


def acwr_zone(ratio: ColumnLike) -> Column:
    r = col(ratio)
    return (
        F.when(r.isNull(), "unknown")
        .when(r < fixed.ACWR_LOW, fixed.ACWR_ZONE_BELOW_LOW)
        .otherwise(ladder(r, fixed.ACWR_ZONES, fixed.ACWR_ZONE_ABOVE))
    )


def speed_risk(speed: ColumnLike) -> Column:
    return F.when(col(speed).isNull(), 0.0).otherwise(ladder(speed, fixed.SPEED_RISK, fixed.SPEED_RISK_ABOVE))


def speed_band(speed: ColumnLike) -> Column:
    s = col(speed)
    return F.when(s.isNull() | (s <= 0), "none").otherwise(ladder(s, fixed.SPEED_BANDS, fixed.SPEED_BAND_ABOVE))


def volume_risk(km_7d: ColumnLike) -> Column:
    return F.when(col(km_7d).isNull(), 0.0).otherwise(ladder(km_7d, fixed.VOLUME_RISK, fixed.VOLUME_RISK_ABOVE))


def monotony_risk(monotony: ColumnLike) -> Column:
    m = col(monotony)
    return F.when(m <= 0, 0.0).otherwise(ladder(m, fixed.MONOTONY_RISK, fixed.MONOTONY_RISK_ABOVE, strict=True))


def strain_risk(strain: ColumnLike, reference: float = fixed.STRAIN_REFERENCE) -> Column:
    s = col(strain)
    return F.when(s <= 0, 0.0).otherwise(clamp(100.0 * (1.0 - F.exp(-s / reference))))


def hard_session(speed: ColumnLike, km: ColumnLike) -> Column:
    """Fast enough and long enough; false, never null."""
    return F.coalesce((col(speed) >= fixed.HARD_SESSION_SPEED) & (col(km) >= fixed.HARD_SESSION_KM), F.lit(False))


def workout_risk(aerobic: ColumnLike, anaerobic: ColumnLike) -> Column:
    steady = clamp((or_zero(aerobic) - 1.75) / 2.0 * 100.0)
    sharp = clamp(or_zero(anaerobic) / 1.5 * 100.0)
    return clamp(F.greatest(steady, sharp * 1.05))


def intensity_risk(speed: ColumnLike, max_speed: ColumnLike, aerobic: ColumnLike, anaerobic: ColumnLike) -> Column:
    mean, top = or_zero(speed), or_zero(max_speed)
    peak = F.when(top > 1.5, F.greatest(mean, top * fixed.MAX_SPEED_SHARE)).otherwise(mean)
    return clamp(F.greatest(speed_risk(peak), workout_risk(aerobic, anaerobic) * 0.35))


def progression_risk(ratio: ColumnLike, volume_rank: ColumnLike, load_rank: ColumnLike, km_7d: ColumnLike) -> Column:
    relative = clamp(0.55 * col(volume_rank) + 0.45 * col(load_rank))
    absolute = clamp(0.65 * acwr_risk(ratio) + 0.35 * volume_risk(km_7d))
    return blended(relative, absolute, 0.50)


def volume_factor(absolute_volume: ColumnLike) -> Column:
    """The bound is 0..100, so for any volume this is 0.4 to 1.0."""
    return clamp(0.40 + 0.60 * col(absolute_volume) / 100.0)


def severity(risk: ColumnLike, load_7d: ColumnLike, load_28d: ColumnLike, workout: ColumnLike, hard: Column) -> Column:
    session = F.when(hard, col(workout)).otherwise(col(workout) * 0.35)
    return clamp(0.45 * col(load_7d) + 0.25 * col(load_28d) + 0.15 * session + 0.15 * col(risk))


def literature_score(
    ratio: ColumnLike, speed: ColumnLike, km_7d: ColumnLike, monotony: ColumnLike, strain: ColumnLike
) -> Column:
    """Five weighted rules, lifted by the strongest of three spikes.

    The hard-session spike looks at the week's mean daily distance, not at the
    day's own distance.
    """
    volume = volume_risk(km_7d)
    progression = clamp(0.65 * acwr_risk(ratio) + 0.35 * volume)
    magnitude = speed_risk(speed)
    context = 0.35 + 0.65 * volume / 100.0
    monotone = monotony_risk(monotony) * context
    strained = strain_risk(strain) * context
    blend = clamp(0.28 * volume + 0.27 * progression + 0.20 * magnitude + 0.15 * monotone + 0.10 * strained)
    spike = F.greatest(
        F.when(acwr_zone(ratio).isin(fixed.ACWR_SPIKE_ZONES), progression * 0.92).otherwise(0.0),
        F.when(col(monotony) >= fixed.MONOTONY_ELEVATED, monotone * 0.85).otherwise(0.0),
        F.when(hard_session(speed, col(km_7d) / 7.0), magnitude * 0.80).otherwise(0.0),
    )
    return clamp(F.greatest(blend, spike))


def agreement(literature: ColumnLike, personalized: ColumnLike, frontier: ColumnLike) -> Column:
    """Which of the three tracks name the same level."""
    lit, per, fro = col(literature), col(personalized), col(frontier)
    pair = lit.eqNullSafe(per)
    return (
        F.when(fro.isNull() & pair, "literature_personalized_agree")
        .when(fro.isNull(), "mixed_signals")
        .when(pair & lit.eqNullSafe(fro), "all_agree")
        .when(pair, "literature_personalized_agree_frontier_differs")
        .when(fro.eqNullSafe(lit), "literature_frontier_agree")
        .when(fro.eqNullSafe(per), "personalized_frontier_agree")
        .otherwise("mixed_signals")
    )
