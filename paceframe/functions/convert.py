"""Source values to clean values: dates, units, sport names, speed limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions.numbers import ColumnLike, col, to_number

_NUMERIC_TEXT = r"^\s*-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$"


def first_present(values: Sequence[ColumnLike]) -> Column:
    return F.coalesce(*[col(v) for v in values])


def date_from_epoch(value: ColumnLike) -> Column:
    """Epoch number to UTC date; values beyond 10^10 are milliseconds."""
    x = to_number(value)
    millis = F.when(F.abs(x) > 1e10, x).otherwise(x * 1000.0)
    return F.to_date(F.timestamp_millis(millis.cast("bigint")))


def date_from_text(value: ColumnLike) -> Column:
    """ISO text to the date it names locally; an offset does not move it."""
    text = F.trim(col(value).cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))


def normalize_date(value: ColumnLike) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text to a date, else null."""
    text = col(value).cast("string")
    return F.when(text.rlike(_NUMERIC_TEXT), date_from_epoch(text)).otherwise(date_from_text(text))


def to_seconds(value: ColumnLike) -> Column:
    """Durations longer than a day are milliseconds."""
    x = to_number(value)
    return F.when(x > 86400, x / 1000.0).otherwise(x)


def to_meters(value: ColumnLike) -> Column:
    """Distances beyond 100 km are centimetres."""
    x = to_number(value)
    return F.when(x > 100000, x / 100.0).otherwise(x)


def sport_family(activity_type: ColumnLike) -> Column:
    name = F.lower(F.coalesce(col(activity_type).cast("string"), F.lit("")))
    chain = None
    for family, tokens in fixed.SPORT_TOKENS:
        match = name.rlike("|".join(tokens))
        chain = F.when(match, family) if chain is None else chain.when(match, family)
    return chain.otherwise("other")


def json_family(file_name: ColumnLike) -> Column:
    name = col(file_name)
    chain = None
    for how, token, family in fixed.JSON_FAMILIES:
        match = name.contains(token) if how == "contains" else name.startswith(token)
        chain = F.when(match, family) if chain is None else chain.when(match, family)
    return chain.otherwise(fixed.JSON_FAMILY_OTHER)


def source_priority(source_file: ColumnLike) -> Column:
    """Which copy of an activity to trust: summary JSON, then tcx, then fit."""
    name = F.coalesce(col(source_file), F.lit(""))
    chain = None
    for how, token, priority in fixed.SOURCE_PRIORITY:
        match = F.lower(name).contains(token) if how == "contains" else name.endswith(token)
        chain = F.when(match, priority) if chain is None else chain.when(match, priority)
    return chain.otherwise(0)


def sane_distance(distance: ColumnLike, duration: ColumnLike) -> Column:
    """Distance limited to what the duration allows; nothing becomes zero."""
    d, t = to_number(distance), to_number(duration)
    return (
        F.when(d.isNull() | (d <= 0), F.lit(0.0))
        .when(t.isNull() | (t <= 0), d)
        .otherwise(F.least(d, t * fixed.MAX_RUN_SPEED))
    )
