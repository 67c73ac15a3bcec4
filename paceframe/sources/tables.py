"""Result tables: partitioned Parquet, JSON records, event configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.functions.vectors import pack
from paceframe.keys import ATHLETE, DATE

_EVENT_SCHEMA = (
    "events array<struct<athlete_id bigint, id string, label string, type string, onset_date string, "
    "symptom_window_start string, notes string>>, "
    "reference_periods array<struct<athlete_id bigint, id string, label string, description string, start_date string, "
    "end_date string, evaluation_end string>>, "
    "evaluation struct<lookback_days int, accumulated_thresholds array<double>>"
)


def write_daily(df: DataFrame, path: str) -> None:
    """Daily table by year, clustered by athlete so that files prune well."""
    rows = df.withColumn("year", F.year(DATE))
    rows.repartition("year", ATHLETE).sortWithinPartitions(ATHLETE, DATE).write.mode("overwrite").partitionBy("year").parquet(path)


def read_daily(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_daily_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A daily, score or embedding CSV with a declared schema."""
    return spark.read.csv(path, schema=schema, header=True, dateFormat="yyyy-MM-dd")


def read_embedding_csv(spark: SparkSession, path: str, dim: int, prefix: str = "z_") -> DataFrame:
    """Embedding CSV with its vector columns packed into one array."""
    names = [f"{prefix}{i}" for i in range(dim)]
    frame = spark.read.csv(path, header=True, inferSchema=True)
    return frame.withColumn(prefix.rstrip("_"), pack(names)).drop(*names)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, one record per row."""
    df.write.mode("overwrite").json(path)


def read_event_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labelled events and reference periods of a configuration file."""
    config = spark.read.schema(_EVENT_SCHEMA).option("multiLine", "true").json(path)
    events = config.select(F.inline("events")).select(
        ATHLETE, F.col("id").alias("event_id"), F.coalesce("label", "id").alias("label"),
        F.col("onset_date").try_cast("date").alias("onset_date"),
        F.coalesce("symptom_window_start", "onset_date").try_cast("date").alias("symptom_window_start"), "notes",
    )
    periods = config.select(F.inline("reference_periods")).select(
        ATHLETE, F.col("id").alias("event_id"), F.coalesce("label", "id").alias("label"),
        F.col("start_date").try_cast("date").alias("start_date"),
        F.coalesce("evaluation_end", "end_date").try_cast("date").alias("end_date"),
    )
    return events, periods


def stage_directory(spark: SparkSession, parent: str | None = None) -> str:
    """A fresh directory in shared storage: below ``parent``, else the checkpoint folder, else the warehouse.

    The warehouse of a session without settings is a local folder, which only a
    session of one process may use.
    """
    base = parent or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        local = base.startswith("file:") or "://" not in base
        if local and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/paceframe/{uuid.uuid4().hex}"


def staged(df: DataFrame, parent: str | None = None) -> DataFrame:
    """The rows, written to shared storage once and read from there."""
    path = stage_directory(df.sparkSession, parent)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def register_views(tables: dict[str, DataFrame]) -> None:
    """Name tables for Spark SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
