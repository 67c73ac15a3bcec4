"""The key columns and the two window specs that every operator shares.

``day`` is ``unix_date(date)``.  It is kept as a real column while a chain of
operators runs: windows that order by the same attribute share one exchange
and one sort, whereas an ordering expression would be sorted anew per layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ATHLETE = "athlete_id"
DATE = "date"
DAY = "day"


def with_day(df: DataFrame) -> DataFrame:
    """Add the integer day used by every window order, once."""
    return df if DAY in df.columns else df.withColumn(DAY, F.unix_date(F.col(DATE)))


def history_order() -> WindowSpec:
    """One athlete's rows in date order."""
    return Window.partitionBy(ATHLETE).orderBy(DAY)


def by_days(first: int, last: int) -> WindowSpec:
    """Frame in calendar days relative to the current row, both ends included."""
    return history_order().rangeBetween(first, last)


def by_rows(first: int, last: int) -> WindowSpec:
    """Frame in rows relative to the current row, both ends included."""
    return history_order().rowsBetween(first, last)


def per_athlete() -> WindowSpec:
    """All rows of one athlete, without an order."""
    return Window.partitionBy(ATHLETE)


def latest_first() -> WindowSpec:
    return Window.partitionBy(ATHLETE).orderBy(F.col(DAY).desc())


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key in a total order.

    Filtering on ``row_number`` lets Spark place a WindowGroupLimit below the
    exchange, so a hot key sends ``n`` rows per map task, not all its rows.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def col_or_null(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column when the table has it, else a typed null."""
    return F.col(name) if has(df, name) else F.lit(None).cast(kind)
