"""Data-quality reports over a daily table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.functions.numbers import exact_round, to_number
from paceframe.keys import ATHLETE, DATE


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and present counts per column of the whole table.

    One pass with one partial row per task; the result is then one short row
    that is turned on its side.
    """
    types = dict(df.dtypes)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns])
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null_count"), F.lit(types[c]).alias("dtype")) for c in columns]
    )
    rows = counts.select("_rows", F.inline(entries))
    missing = F.col("_rows") - F.col("non_null_count")
    share = F.when(F.col("_rows") > 0, exact_round(missing / F.col("_rows") * 100, 2))
    return rows.select("column", missing.alias("missing_count"), share.alias("missing_pct"), "non_null_count", "dtype")


def most_missing(df: DataFrame, columns: Sequence[str], n: int = 40) -> DataFrame:
    return missingness(df, columns).orderBy(F.col("missing_pct").desc(), "column").limit(n)


_PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, spread, range and percentiles per athlete and column.

    Percentiles are exact, so they are taken per athlete, whose days are few;
    a table-wide exact percentile would gather a whole column in one task.
    """
    described = []
    for c in columns:
        value = to_number(c)
        points = F.percentile(value, F.array(*[F.lit(p) for p in _PERCENTILES.values()]))
        described.append(
            F.struct(
                F.lit(c).alias("column"), F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                F.min(value).alias("min"), points.alias("_p"), F.max(value).alias("max"),
                (F.count_if(value.isNull()) / F.count(F.lit(1)) * 100).alias("missing_pct"),
            )
        )
    # A row per day goes in and one per athlete comes out; only then columns become rows.
    wide = df.groupBy(ATHLETE).agg(F.array(*described).alias("_columns"))
    stats = wide.select(ATHLETE, F.inline("_columns"))
    picked = {name: F.get("_p", F.lit(i)) for i, name in enumerate(_PERCENTILES)}
    return stats.withColumns(picked).drop("_p")


def overview(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows, columns, date range, configured features found, targets present."""
    found = [f for f in features if f in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.min(DATE).alias("date_min"),
        F.max(DATE).alias("date_max"),
        F.lit(len(features)).cast("bigint").alias("configured_features"),
        F.lit(len(found)).cast("bigint").alias("available_configured_features"),
        F.count(target).alias("target_non_null_rows"),
    )


def monthly_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean per athlete, calendar month and column."""
    return df.groupBy(ATHLETE, F.trunc(DATE, "MM").alias("month")).agg(*[F.avg(to_number(c)).alias(c) for c in columns])


def group_coverage(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Athlete-days on which a group of columns has any value."""
    aggs = [F.count_if(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()).alias(g) for g, cols in groups.items()]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    entries = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.col(g).alias("days")) for g in groups])
    rows = counts.select("_rows", F.inline(entries))
    return rows.select("feature_group", "days", (F.col("days") / F.col("_rows") * 100).alias("coverage_pct"))


def column_groups(columns: Sequence[str], prefixes: Sequence[str]) -> dict[str, list[str]]:
    """Columns by name prefix; groups without a column are left out."""
    groups = {p: [c for c in columns if c.startswith(f"{p}_")] for p in prefixes}
    return {p: cols for p, cols in groups.items() if cols}
