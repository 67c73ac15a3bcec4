"""Workout records: de-duplication, plausibility, daily roll-up per sport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions.convert import source_priority, sport_family
from paceframe.functions.numbers import or_zero, to_number, total
from paceframe.keys import ATHLETE, DATE, top_per

_SIGNAL = ["activity_duration_seconds", "activity_distance_m", "activity_avg_hr", "activity_max_hr"]
_ROW_ID = ["source_file", "record_ordinal"]


def _trust_order(df: DataFrame) -> list[Column]:
    """Best copy first; file and position make the order total."""
    filled = total([F.col(c).isNotNull().cast("int") for c in df.columns if c.startswith("activity_")])
    return [
        F.col("activity_id").isNotNull().desc(),
        source_priority("source_file").desc(),
        filled.desc(),
        F.col("source_file").asc(),
        F.col("record_ordinal").asc(),
    ]


def dedup_by_id(df: DataFrame) -> DataFrame:
    """One row per activity id; rows without an id are all kept."""
    alone = F.when(F.col("activity_id").isNull(), F.struct(*_ROW_ID))
    keyed = df.withColumn("_alone", alone)
    return top_per(keyed, [ATHLETE, "activity_id", "_alone"], _trust_order(df), 1).drop("_alone")


def dedup_by_signature(df: DataFrame) -> DataFrame:
    """One row per day, type and rounded measures; rows without any are kept."""
    present = [c for c in _SIGNAL if c in df.columns]
    signal = F.coalesce(*[F.col(c) for c in present]).isNotNull()
    keyed = df.withColumns(
        {f"_sig_{c}": F.rint(F.col(c)) for c in present}
        | {"_sig_type": F.coalesce(F.col("activity_type"), F.lit("")), "_alone": F.when(~signal, F.struct(*_ROW_ID))}
    )
    keys = [ATHLETE, DATE, "_sig_type", *[f"_sig_{c}" for c in present], "_alone"]
    kept = top_per(keyed, keys, _trust_order(df), 1)
    return kept.select(*df.columns)


def deduplicate(df: DataFrame) -> DataFrame:
    return dedup_by_signature(dedup_by_id(df))


def first_per_id(df: DataFrame) -> DataFrame:
    """First record per activity id in file order; a missing id is one id."""
    return top_per(df, [ATHLETE, "activity_id"], [F.col(c).asc() for c in _ROW_ID], 1)


def plausible_runs(df: DataFrame) -> DataFrame:
    """Drop runs whose distance, duration and effort cannot belong together."""
    distance, duration = or_zero("activity_distance_m"), or_zero("activity_duration_seconds")
    speed = F.when(duration != 0, distance / duration)
    effort = F.col("activity_aerobic_training_effect")
    # A comparison with a missing speed fails, as does one with a missing effort.
    return df.filter(
        ((distance <= 0) | (duration > 0))
        & ((distance <= 0) | F.coalesce(speed <= fixed.MAX_RUN_SPEED, F.lit(False)))
        & ((distance <= 2000) | F.coalesce(speed.between(1.8, fixed.MAX_RUN_SPEED), F.lit(False)))
        & ~((distance > 10000) & (duration < 600))
        & ~F.coalesce((distance > 15000) & (effort < 1.5), F.lit(False))
        & ~F.coalesce((distance > 25000) & (effort < 2.0), F.lit(False))
    )


def cap_run_distance(df: DataFrame) -> DataFrame:
    """Limit a run's distance to what its duration allows."""
    distance, duration = F.col("activity_distance_m"), F.col("activity_duration_seconds")
    limit = duration * fixed.MAX_RUN_SPEED
    too_far = (F.col("sport_family") == "running") & (duration > 0) & (distance > limit)
    return df.withColumn("activity_distance_m", F.when(too_far, limit).otherwise(distance))


def with_sport_family(df: DataFrame) -> DataFrame:
    return df.withColumn("sport_family", sport_family("activity_type"))


def _family_columns(family: str, present: list[str]) -> list[Column]:
    mine = F.col("sport_family") == family
    seen = F.count(F.when(mine, True))
    out = [seen.alias(f"{family}_activity_count")]
    for c in fixed.FAMILY_SUM_COLUMNS:
        if c in present:
            amount = F.coalesce(F.sum(F.when(mine, F.col(c))), F.lit(0.0))
            out.append(F.when(seen > 0, amount).alias(f"{family}_{c.removeprefix('activity_')}"))
    for c in fixed.FAMILY_MEAN_COLUMNS:
        if c in present:
            out.append(F.avg(F.when(mine, F.col(c))).alias(f"{family}_{c.removeprefix('activity_')}"))
    return out


def weighted_loads(df: DataFrame) -> DataFrame:
    """Impact and fatigue weighted time and distance across sports."""
    out = {}
    for name, measure, (run, hike, ride) in fixed.WEIGHTED_LOADS:
        out[name] = (
            or_zero(f"running_{measure}") * run + or_zero(f"hiking_{measure}") * hike + or_zero(f"cycling_{measure}") * ride
        )
    return df.withColumns(out)


def daily_rollup(df: DataFrame) -> DataFrame:
    """One row per athlete and day: totals, means, and both per sport family.

    One aggregation serves all of it, with map-side partial sums, so a day
    with very many records costs one partial row per task. Types are few, so
    their set is collected in the same aggregation.
    """
    present = [c for c in fixed.ACTIVITY_NUMERIC if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("activity_count"), F.size(F.collect_set("activity_type")).cast("bigint").alias("activity_type_count")]
    for c in present:
        if c in fixed.DAILY_SUM_COLUMNS:
            aggs.append(F.coalesce(F.sum(c), F.lit(0.0)).alias(c))
        elif c in fixed.DAILY_MAX_COLUMNS:
            aggs.append(F.max(c).alias(c))
        else:
            aggs.append(F.avg(c).alias(c))
    for family in fixed.SPORT_FAMILIES:
        aggs.extend(_family_columns(family, present))
    return weighted_loads(df.groupBy(ATHLETE, DATE).agg(*aggs))


def numeric_activities(df: DataFrame) -> DataFrame:
    """Measures as doubles; unreadable text becomes null."""
    return df.withColumns({c: to_number(c) for c in fixed.ACTIVITY_NUMERIC if c in df.columns})


def activities_to_daily(df: DataFrame) -> DataFrame:
    """Raw records to the daily table: clean, de-duplicate, cap, roll up.

    Records are dealt by athlete once; every key of the steps below holds the
    athlete, so none of them deals the rows out again.
    """
    clean = cap_run_distance(with_sport_family(deduplicate(numeric_activities(df.repartition(ATHLETE)))))
    return daily_rollup(clean)


def summary_running_totals(df: DataFrame) -> DataFrame:
    """Daily running totals from the activity summaries alone."""
    runs = plausible_runs(with_sport_family(first_per_id(numeric_activities(df))).filter(F.col("sport_family") == "running"))
    return runs.groupBy(ATHLETE, DATE).agg(
        F.coalesce(F.sum("activity_distance_m"), F.lit(0.0)).alias("running_distance_json_m"),
        F.coalesce(F.sum("activity_duration_seconds"), F.lit(0.0)).alias("running_duration_json_s"),
    )
