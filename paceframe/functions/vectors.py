"""Vector maths on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceframe.functions.numbers import ColumnLike, col


def pack(columns: Sequence[str]) -> Column:
    """Scalar columns to one array column."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: ColumnLike) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v * v))


def distance(a: ColumnLike, b: ColumnLike) -> Column:
    return norm(F.zip_with(col(a), col(b), lambda x, y: x - y))


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """Zero when a vector has no length; null when one is missing.

    One pass over both arrays; the ratio is formed at its end.
    """
    zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))

    def step(s: Column, p: Column) -> Column:
        return F.struct(
            (s["ab"] + p["x"] * p["y"]).alias("ab"),
            (s["aa"] + p["x"] * p["x"]).alias("aa"),
            (s["bb"] + p["y"] * p["y"]).alias("bb"),
        )

    pairs = F.zip_with(col(a), col(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.aggregate(
        pairs,
        zero,
        step,
        lambda s: F.when((s["aa"] > 0) & (s["bb"] > 0), s["ab"] / (F.sqrt(s["aa"]) * F.sqrt(s["bb"]))).otherwise(0.0),
    )


def mean_vector(column: ColumnLike, dim: int) -> Column:
    """Element-wise mean, as ``dim`` plain averages with map-side combine."""
    z = col(column)
    means = F.array(*[F.avg(F.get(z, F.lit(i))) for i in range(dim)])
    return F.when(F.count(z) > 0, means)
