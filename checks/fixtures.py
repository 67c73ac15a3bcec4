"""Athlete tables derived from the driver tables.

``lineitem`` gives workouts and daily markers of one athlete per supplier;
``embeddings`` gives state vectors.  All rules are integer or half-integer
arithmetic, so both engines agree exactly.  Nothing is sampled: every row of
the source tables takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.operators.activities import activities_to_daily
from paceframe.operators.daily import merge_days
from paceframe.operators.embeddings import rolling_anomaly

STATE_DIM = 4
VECTOR_DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded_date(column: str) -> Column:
    """Fold the long, sparse calendar on 700 days."""
    day = F.unix_date(F.col(column).cast("date")) % 700
    return F.date_add(F.lit("2020-01-01").cast("date"), day.cast("int"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workout per order line."""
    line = table(spark, sf_dir, "lineitem")
    part, order, qty = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_quantity")
    supp = F.col("l_suppkey").cast("string")
    pace = F.when(part % 97 == 0, 100).otherwise(200 + part % 350)
    kinds = ["running", "trail_running", "track_running", "road_biking", "hiking", "lap_swimming", "strength_training"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("l_linenumber"))
    return line.select(
        F.col("l_suppkey").alias("athlete_id"),
        F.when(part % 10 != 0, order * 10 + F.col("l_linenumber")).alias("activity_id"),
        folded_date("l_shipdate").alias("date"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("summarizedActivities_"), supp, F.lit(".json")))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("a_"), supp, F.lit(".tcx")))
        .otherwise(F.concat(F.lit("a_"), supp, F.lit(".fit")))
        .alias("source_file"),
        (part * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("record_ordinal"),
        kind.alias("activity_type"),
        (qty * 500).alias("activity_distance_m"),
        (qty * 0.5 * pace).alias("activity_duration_seconds"),
        F.when(order % 11 != 0, (110 + part % 70).cast("double")).alias("activity_avg_hr"),
        (115 + part % 70 + order % 20).cast("double").alias("activity_max_hr"),
        (order % 300).cast("double").alias("activity_elevation_gain"),
        ((order % 50).cast("double") / 10).alias("activity_aerobic_training_effect"),
        ((part % 30).cast("double") / 10).alias("activity_anaerobic_training_effect"),
        (qty * 4).alias("activity_training_load"),
    )


def _day_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt by athlete, as the workouts are, so that what is joined or merged by athlete stays where it is.
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_partkey").repartition("l_suppkey")
    return line.groupBy(F.col("l_suppkey").alias("athlete_id"), folded_date("l_shipdate").alias("date")).agg(
        F.sum("l_orderkey").alias("so"), F.sum("l_partkey").alias("sp")
    )


def wellness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery markers per athlete and day."""
    so, sp = F.col("so"), F.col("sp")
    out = {
        "readiness_score": F.when(so % 5 != 0, 20 + sp % 75),
        "readiness_hrvWeeklyAverage": 40 + sp % 41,
        "wellness_restingHeartRate": 42 + so % 14,
        "sleep_total_seconds": 18000 + (sp * 7) % 14400,
        "wellness_bodyBattery_chargedValue": (so * 3) % 80,
        "wellness_bodyBattery_drainedValue": (so * 5) % 80,
    }
    return _day_sums(spark, sf_dir).select("athlete_id", "date", *[c.cast("double").alias(n) for n, c in out.items()])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    so, sp = F.col("so"), F.col("sp")
    return _day_sums(spark, sf_dir).select(
        "athlete_id",
        "date",
        F.when(so % 5 != 0, 20 + sp % 75).cast("double").alias("actual"),
        (20 + (sp * 3) % 75).cast("double").alias("prediction"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily feature table: cleaned activities merged with the markers."""
    return merge_days([activities_to_daily(activities(spark, sf_dir)), wellness(spark, sf_dir)])


def state_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small state vector on most athlete-days of the daily table."""
    so, sp = F.col("so"), F.col("sp")
    z = F.array(*[(x.cast("double") / 8) for x in (sp % 17, so % 13, (sp * 3) % 11, (so * 7) % 19)])
    return _day_sums(spark, sf_dir).filter(so % 6 != 0).select("athlete_id", "date", z.alias("z"))


def contrast_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    so, sp = F.col("so"), F.col("sp")
    z = F.array(*[(x.cast("double") / 4) for x in (so % 7, sp % 9)])
    return _day_sums(spark, sf_dir).filter(so % 4 != 0).select("athlete_id", "date", z.alias("z"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State embeddings with novelty columns."""
    return rolling_anomaly(state_vectors(spark, sf_dir), STATE_DIM).drop("day")


def contrastive(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rolling_anomaly(contrast_vectors(spark, sf_dir), 2)
    return scored.select("athlete_id", "date", F.col("anomaly_zscore").alias("contrastive_anomaly_zscore"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-dim vectors, at most 1,000 days per athlete however large the table."""
    emb = table(spark, sf_dir, "embeddings")
    block = F.floor(F.col("vec_id") / 1000).cast("bigint")
    return emb.select(
        (F.col("label").cast("bigint") + 10 * block).alias("athlete_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 1000).cast("int")).alias("date"),
        F.col("embedding").cast("array<double>").alias("z"),
    )


def _event(df: DataFrame, onset: str, symptoms: str) -> DataFrame:
    return df.select(
        "athlete_id",
        F.lit("spring_block").alias("event_id"),
        F.lit("Bone stress injury").alias("label"),
        F.lit(onset).cast("date").alias("onset_date"),
        F.lit(symptoms).cast("date").alias("symptom_window_start"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled event per athlete of the daily table."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("athlete_id"))
    return _event(ids, "2021-04-01", "2021-03-01")


def reference_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configured reference block per athlete of the daily table."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("athlete_id"),
        F.lit("summer_block").alias("event_id"),
        F.lit("Summer load block").alias("label"),
        F.lit("2020-07-01").cast("date").alias("start_date"),
        F.lit("2020-08-15").cast("date").alias("end_date"),
    )


def vector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled event per athlete of the vector table."""
    ids = vectors(spark, sf_dir).select("athlete_id").distinct()
    return _event(ids, "2024-02-10", "2024-01-25")
