"""Daily tables: merge of categories, canonical names, calendars, one row per day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.functions.numbers import settle, to_number
from paceframe.keys import ATHLETE, DATE, DAY, by_days, top_per, with_day

_META = {ATHLETE, DATE, "source_file", "record_ordinal"}


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing from one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns whose every non-null value reads as a number.

    Text columns are tested in one aggregation pass; the result is one row.
    """
    typed = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in _META]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in _META]
    if not text:
        return typed
    tests = [(F.count(to_number(c)) == F.count(c)).alias(c) for c in text]
    verdict = df.agg(*tests).first()
    return [c for c in df.columns if c in typed or (c in text and verdict[c])]


def daily_means(df: DataFrame, category: str, numeric: Sequence[str] | None = None) -> DataFrame:
    """Mean of numbers, last non-null text in file order, and a record count."""
    numbers = list(numeric) if numeric is not None else numeric_columns(df)
    texts = [f.name for f in df.schema if f.name not in _META and f.name not in numbers]
    position = F.struct("source_file", "record_ordinal")
    aggs = [F.avg(to_number(c)).alias(c) for c in numbers]
    # Null values sort before all others, so the newest value present wins.
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(c) for c in texts]
    return df.groupBy(ATHLETE, DATE).agg(*aggs, F.count(F.lit(1)).alias(f"{category}_record_count"))


def merge_days(frames: Sequence[DataFrame]) -> DataFrame:
    """Full outer merge on the day, as one union and one aggregation.

    Each table has at most one row per day and its own columns, so the only
    non-null value per day is the value.
    """
    joined = stack(frames)
    values = [F.max(c).alias(c) for c in joined.columns if c not in (ATHLETE, DATE)]
    return joined.groupBy(ATHLETE, DATE).agg(*values)


def category_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Record count per category."""
    parts = [df.select(F.lit(name).alias("category")) for name, df in frames.items()]
    return stack(parts).groupBy("category").agg(F.count(F.lit(1)).alias("records"))


def first_existing(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def canonical(df: DataFrame, *mappings: Mapping[str, Sequence[str]]) -> DataFrame:
    """Canonical columns from the first candidate the table has, else null.

    Values are settled to six decimals: ranks taken on them later must not
    depend on the order in which a mean was summed.
    """
    out: dict[str, Column] = {}
    for mapping in mappings:
        for name, candidates in mapping.items():
            source = first_existing(df.columns, candidates)
            out[name] = settle(to_number(source)) if source else F.lit(None).cast("double")
    return df.withColumns(out)


def context_frame(embeddings: DataFrame, daily: DataFrame, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """Embedding days with the daily columns and any missing context names."""
    frame = embeddings.join(daily, [ATHLETE, DATE], "left")
    out = {}
    for name, candidates in mapping.items():
        source = first_existing(frame.columns, candidates)
        if source and name not in frame.columns:
            out[name] = to_number(source)
    return frame.withColumns(out) if out else frame


def one_per_day(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First row per athlete and day in the given total order."""
    return top_per(df, [ATHLETE, DATE], list(order), 1)


def distinct_days(df: DataFrame) -> DataFrame:
    return df.select(ATHLETE, DATE).distinct()


def date_range(df: DataFrame, start: str, end: str, *, end_open: bool = False) -> DataFrame:
    """Rows between two dates; the filter reaches the scan."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    last = F.col(DATE) < high if end_open else F.col(DATE) <= high
    return df.filter((F.col(DATE) >= low) & last)


def dense_calendar(df: DataFrame) -> DataFrame:
    """Every date from an athlete's first to last; added days are null."""
    span = df.groupBy(ATHLETE).agg(F.min(DATE).alias("_first"), F.max(DATE).alias("_last"))
    days = span.select(ATHLETE, F.explode(F.sequence("_first", "_last")).alias(DATE))
    return days.join(df, [ATHLETE, DATE], "left")


def previous_day(df: DataFrame, columns: Sequence[str], prefix: str = "previous_day_") -> DataFrame:
    """Values of the calendar day before, null when that day has no row."""
    frame = with_day(df)
    yesterday = by_days(-1, -1)
    out = frame.withColumns({f"{prefix}{c}": F.first(c).over(yesterday) for c in columns})
    return out if DAY in df.columns else out.drop(DAY)


def override_running(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Summary totals win over the table's running distance and duration."""
    joined = df.join(totals, [ATHLETE, DATE], "left")
    fixed_up = joined.withColumns(
        {
            "running_distance": F.coalesce("running_distance_json_m", "running_distance"),
            "running_duration": F.coalesce("running_duration_json_s", "running_duration"),
        }
    )
    speed = F.coalesce("running_distance", F.lit(0.0)) / F.col("running_duration")
    return fixed_up.withColumn("running_avg_speed", F.when(F.col("running_duration") > 0, speed)).drop(
        "running_distance_json_m", "running_duration_json_s"
    )


def refresh_columns(df: DataFrame, fresh: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace a set of columns by those of another table, matched by day."""
    kept = df.drop(*[c for c in columns if c in df.columns])
    return kept.join(fresh.select(ATHLETE, DATE, *columns), [ATHLETE, DATE], "left")
