"""How the tracks differ, and summaries of a scored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe.functions import risk
from paceframe.keys import ATHLETE, DATE, has


def comparison(scores: DataFrame) -> DataFrame:
    """Score differences between tracks; levels are filled in if absent."""
    levels = {
        f"{t}_bone_stress_level": risk.level(f"{t}_bone_stress_score")
        for t in ("literature", "personalized")
        if not has(scores, f"{t}_bone_stress_level")
    }
    frame = scores.withColumns(levels) if levels else scores
    literature = F.col("literature_bone_stress_score")
    return frame.withColumns(
        {
            "literature_vs_personalized_delta": literature - F.col("personalized_bone_stress_score"),
            "integrated_vs_literature_delta": F.col("integrated_bone_stress_score") - literature,
        }
    )


def _level(column: str, value: str = "high") -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


def disagreement_summary(scores: DataFrame) -> DataFrame:
    """Day counts per athlete: each track high, and one high without another."""
    lit, per = _level("literature_bone_stress_level"), _level("personalized_bone_stress_level")
    fro, known = _level("accumulated_frontier_level"), F.col("accumulated_frontier_state").isNotNull()
    return scores.groupBy(ATHLETE).agg(
        F.count(F.lit(1)).alias("days_scored"),
        F.count_if(lit).alias("literature_high_days"),
        F.count_if(per).alias("personalized_high_days"),
        F.count_if(_level("bone_stress_risk_level")).alias("combined_high_days"),
        F.count_if(known).alias("frontier_coverage_days"),
        F.count_if(known & fro).alias("frontier_high_days"),
        F.count_if(lit & ~per).alias("literature_high_personalized_not"),
        F.count_if(per & ~lit).alias("personalized_high_literature_not"),
        F.count_if(known & fro & ~lit).alias("frontier_high_literature_not"),
    )


def value_counts(df: DataFrame, column: str, *keys: str, n: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; the value settles ties."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("days"))
    ranked = counts.orderBy(F.col("days").desc(), *keys, column)
    return ranked.limit(n) if n is not None else ranked


def largest_disagreements(scores: DataFrame, n: int = 30) -> DataFrame:
    """Days whose levels differ, by size of the score difference."""
    frame = comparison(scores)
    differing = frame.filter(F.col("literature_bone_stress_level") != F.col("personalized_bone_stress_level"))
    ranked = differing.withColumn("abs_delta", F.abs("literature_vs_personalized_delta"))
    return ranked.orderBy(F.col("abs_delta").desc(), F.col("bone_stress_risk_score").desc(), ATHLETE, DATE).limit(n)


def top_bone_days(scores: DataFrame, n: int = 20) -> DataFrame:
    order = [F.col(c).desc() for c in ("bone_stress_severity_score", "running_7d_load_score", "bone_stress_risk_score")]
    return scores.orderBy(*order, ATHLETE, DATE).limit(n)


def top_risk_days(scores: DataFrame, n: int = 20) -> DataFrame:
    return scores.orderBy(F.col("risk_score").desc(), F.col("recovery_strain_score").desc(), ATHLETE, DATE).limit(n)


def _top_day(score: str) -> Column:
    """Earliest of the days with the highest score."""
    return F.max_by(DATE, F.struct(F.col(score), -F.unix_date(DATE)))


def risk_summary(scores: DataFrame, periods: DataFrame) -> DataFrame:
    """Level counts, date range, top days and top period per athlete."""
    days = scores.groupBy(ATHLETE).agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.min(DATE).alias("start_date"),
        F.max(DATE).alias("end_date"),
        F.count_if(_level("risk_level")).alias("high_risk_days"),
        F.count_if(_level("risk_level", "moderate")).alias("moderate_risk_days"),
        F.count_if(_level("accumulated_risk_level")).alias("high_accumulated_state_days"),
        F.count_if(_level("accumulated_risk_level", "moderate")).alias("moderate_accumulated_state_days"),
        _top_day("risk_score").alias("top_risk_day"),
        _top_day("accumulated_risk_state").alias("top_accumulated_state_day"),
    )
    blocks = periods.groupBy(ATHLETE).agg(
        F.count(F.lit(1)).alias("risk_period_count"),
        F.max_by("period_id", F.struct("peak_accumulated_risk_state", -F.col("period_id"))).alias("top_risk_period"),
    )
    joined = days.join(blocks, ATHLETE, "left")
    return joined.withColumn("risk_period_count", F.coalesce("risk_period_count", F.lit(0)).cast("bigint"))


def bone_summary(scores: DataFrame, periods: DataFrame) -> DataFrame:
    days = scores.groupBy(ATHLETE).agg(
        F.count_if(_level("bone_stress_risk_level")).alias("high_bone_stress_days"),
        _top_day("bone_stress_risk_score").alias("top_bone_stress_day"),
    )
    blocks = periods.groupBy(ATHLETE).agg(
        F.count(F.lit(1)).alias("bone_stress_period_count"),
        F.max_by("period_id", F.struct("peak_accumulated_bone_stress_state", -F.col("period_id"))).alias("top_bone_stress_period"),
    )
    joined = days.join(blocks, ATHLETE, "left")
    return joined.withColumn("bone_stress_period_count", F.coalesce("bone_stress_period_count", F.lit(0)).cast("bigint"))


def summary_running_context(scores: DataFrame) -> DataFrame:
    """Conditional rates: how often big weeks are flagged high."""
    km = F.coalesce("running_7d_sum_m", F.lit(0.0)) / 1000.0
    high = _level("bone_stress_risk_level")
    return scores.groupBy(ATHLETE).agg(
        F.count_if(km >= 100).alias("big_week_days"),
        F.coalesce(F.avg(F.when(km >= 100, high.cast("double"))), F.lit(0.0)).alias("big_week_high_rate"),
    )
