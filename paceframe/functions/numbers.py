"""Numeric helpers: bounds, ladders, exact decimal rounding, text output."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | float | int

# Splits a double into two 26-bit halves, so that products with small
# integers can be formed without rounding error.
_SPLIT = 134217729.0


def col(value: ColumnLike) -> Column:
    """A column from a name, a number or a column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def clamp(value: ColumnLike, low: float = 0.0, high: float = 100.0) -> Column:
    """Bound a value; null stays null (``least``/``greatest`` would skip it)."""
    x = col(value)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def or_zero(value: ColumnLike) -> Column:
    return F.coalesce(col(value), F.lit(0.0))


def ladder(value: ColumnLike, steps: Sequence[tuple[float, object]], above: object, *, strict: bool = False) -> Column:
    """First step whose bound is not below the value (``strict``: above it)."""
    x = col(value)
    chain = None
    for bound, result in steps:
        test = x < bound if strict else x <= bound
        chain = F.when(test, F.lit(result)) if chain is None else chain.when(test, F.lit(result))
    return chain.otherwise(F.lit(above))


def to_number(value: ColumnLike) -> Column:
    """Text or number to double; anything unreadable becomes null."""
    return col(value).try_cast("double")


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def settle(value: ColumnLike, digits: int = 6) -> Column:
    """Round away the noise of summation order before values are ranked."""
    return F.round(col(value), digits)


def exact_round(value: ColumnLike, digits: int = 0) -> Column:
    """Round the exact binary value half to even.

    ``round`` and ``bround`` look at the shortest decimal text of a double, so
    45.15 (stored just below) would round up.  Here the product with 10^digits
    is formed with its rounding error, which decides apparent ties.
    """
    x = col(value)
    if digits == 0:
        return F.rint(x)
    scale = float(10**digits)
    product = x * scale
    high = x * _SPLIT - (x * _SPLIT - x)
    error = (high * scale - product) + (x - high) * scale
    tie = (product - F.floor(product)) == 0.5
    nearest = (
        F.when(tie & (error > 0), F.ceil(product).cast("double"))
        .when(tie & (error < 0), F.floor(product).cast("double"))
        .otherwise(F.rint(product))
    )
    return nearest / scale


def fixed_text(value: ColumnLike, digits: int = 0, *, grouped: bool = False, sign: bool = False) -> Column:
    """Number as text with a fixed count of decimals."""
    flags = ("+" if sign else "") + ("," if grouped else "")
    rounded = exact_round(value, digits)
    return F.when(rounded.isNotNull(), F.format_string(f"%{flags}.{digits}f", rounded))


def number_or_unknown(value: ColumnLike, digits: int = 1) -> Column:
    """Number with thousands separators, or the word for a missing one."""
    return F.coalesce(fixed_text(value, digits, grouped=True), F.lit("unknown"))


def short_number(value: ColumnLike) -> Column:
    """One decimal from 100 upwards, two below."""
    x = col(value)
    return F.when(F.abs(x) >= 100, exact_round(x, 1)).otherwise(exact_round(x, 2))


def km_from_meters(value: ColumnLike) -> Column:
    return exact_round(short_number(value) / 1000.0, 1)


def km_text(value: ColumnLike) -> Column:
    """Kilometres as text; values above 500 are taken as metres."""
    x = col(value)
    km = F.when(x > 500, x / 1000.0).otherwise(x)
    return F.coalesce(F.concat(fixed_text(km, 0), F.lit(" km")), F.lit("—"))


def share_text(part: ColumnLike, whole: ColumnLike) -> Column:
    """Percentage without decimals; zero when there is nothing to divide by."""
    p, w = col(part).cast("double"), col(whole).cast("double")
    return F.when(w > 0, F.concat(fixed_text(100 * p / w, 0), F.lit("%"))).otherwise(F.lit("0%"))


def pct_delta(value: ColumnLike, baseline: ColumnLike) -> Column:
    """Relative change in percent; null without a non-zero baseline."""
    v, b = col(value), col(baseline)
    return F.when(b != 0, (v - b) / F.abs(b) * 100)


def direction_phrase(delta: ColumnLike, higher: str, lower: str, dead_band: float = 10.0) -> Column:
    d = col(delta)
    word = F.when(d > 0, F.lit(higher)).otherwise(F.lit(lower))
    return F.when(
        F.abs(d) >= dead_band,
        F.concat(fixed_text(F.abs(d), 0), F.lit("% "), word, F.lit(" than recent baseline")),
    )


def score_band(value: ColumnLike, high: float = 60.0, moderate: float = 40.0) -> Column:
    v = col(value)
    return F.when(v >= high, "high").when(v >= moderate, "moderate").when(v.isNotNull(), "low")


def texts(*parts: Column | str) -> Column:
    """Join text pieces; plain strings are literals, a null piece is empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def spaced(value: ColumnLike) -> Column:
    return F.regexp_replace(col(value), "_", " ")
