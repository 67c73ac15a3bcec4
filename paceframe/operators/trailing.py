"""Trailing windows: personal percentiles, rolling sums, monotony, rest.

All frames look back over one athlete's days.  Windows are added in as few
layers as possible, because all frames of a layer share one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe import fixed
from paceframe.functions.numbers import col, settle
from paceframe.keys import ATHLETE, DAY, by_days, by_rows, history_order, with_day
from paceframe.operators.order_statistics import SortedSeries, cut_sums, in_days


# Sums are settled to six decimals; a partial sum is compared with this slack
# instead of being rounded once per step.
_NOISE = 5e-7


@dataclass(frozen=True)
class Rank:
    """Risk of a value by its rank in the trailing days (today excluded)."""

    out: str
    column: str
    value: str | None = None
    high: bool = True
    days: int = fixed.BASELINE_DAYS


@dataclass(frozen=True)
class RollingRank:
    """Risk of the last ``days`` days' sum or mean among earlier ones."""

    out: str
    column: str
    days: int
    baseline: int
    mean: bool = False


def count_not_above(history: Column, value: Column) -> Column:
    return F.size(F.filter(history, lambda v: v <= value))


def share_not_above(history: Column, value: Column) -> Column:
    """Share of history values at or below the value, in percent."""
    return count_not_above(history, value) / F.size(history) * 100


def _roll_name(roll: RollingRank) -> str:
    return f"_{'mean' if roll.mean else 'sum'}{roll.days}_{roll.column}"


def _rank_scores(table: pa.Table, ranks: Sequence[Rank], rolling: Sequence[RollingRank], days: np.ndarray, place: dict[str, str]) -> dict[str, np.ndarray]:
    """All risks of an athlete's rows, which are in order of ``days``; ``place`` names the input columns."""
    series: dict[str, SortedSeries] = {}

    def of(name: str) -> SortedSeries:
        if name not in series:
            series[name] = SortedSeries(table.column(place[name]))
        return series[name]

    def percent(hits: np.ndarray, size: np.ndarray) -> np.ndarray:
        return hits / np.maximum(size, 1) * 100

    out: dict[str, np.ndarray] = {}
    for r in ranks:
        history, value = of(r.column), of(r.value or r.column)
        lo, hi = in_days(days, -r.days, -1)
        size = history.sizes(lo, hi)
        share = percent(history.not_above(lo, hi, value.values), size)
        # Zero without a value or with too short a history.
        out[r.out] = np.where(value.valid & (size >= fixed.MIN_HISTORY), share if r.high else 100.0 - share, 0.0)
    for r in rolling:
        b, d = r.baseline, r.days
        now, whole = of(f"{_roll_name(r)}_now"), of(_roll_name(r))
        rows = np.subtract(*in_days(days, -(b + d), -1)[::-1])
        lo, hi = in_days(days, -(b + 1), -(d + 1))
        # Rolling values are taken inside the slice of b + d days, so those of its first d - 1 days see a window that the
        # slice cuts; all later ones are the plain rolling values.
        count, hits = cut_sums(of(r.column), *in_days(days, -(b + d), -(b + 2)), now.values + _NOISE, r.mean)
        count, hits = count + whole.sizes(lo, hi), hits + whole.not_above(lo, hi, now.values)
        enough = (rows >= 2 * d) & (count >= fixed.MIN_HISTORY) & now.valid
        out[r.out] = np.where(enough, percent(hits, count), 0.0)
    return out


def add_ranks(df: DataFrame, ranks: Sequence[Rank] = (), rolling: Sequence[RollingRank] = ()) -> DataFrame:
    """Add all percentile and rolling-percentile columns.

    Rolling values come from one layer of windows. Then each athlete's rows pass an
    Arrow step in which every series is sorted once (``order_statistics``) and all
    rows are ranked together, so a rank costs the logarithm of the history and no
    list is built per row.
    """
    frame = with_day(df)
    keep = frame.schema
    first: dict[str, Column] = {}
    for r in rolling:
        base, x = _roll_name(r), col(r.column)
        agg = F.avg if r.mean else F.sum
        first[base] = settle(agg(x).over(by_days(1 - r.days, 0)))
        now = settle(agg(x).over(by_days(-r.days, -1)))
        first[f"{base}_now"] = now if r.mean else F.coalesce(now, F.lit(0.0))
    frame = frame.withColumns(first) if first else frame
    names = dict.fromkeys([*[c for r in ranks for c in (r.column, r.value or r.column)], *[r.column for r in rolling], *first])
    place = {name: f"_in{k}" for k, name in enumerate(names)}
    inputs = frame.select(*keep.names, *[F.col(name).cast("double").alias(c) for name, c in place.items()])
    kinds = {f.name: f for f in keep.fields} | {r.out: T.StructField(r.out, T.DoubleType()) for r in (*ranks, *rolling)}

    def score(table: pa.Table) -> pa.Table:
        days = table.column(DAY).to_pandas().fillna(-(1 << 40)).to_numpy().astype(np.int64)
        order = np.argsort(days, kind="stable")
        table = table.take(pa.array(order))
        scores = _rank_scores(table, ranks, rolling, days[order], place)
        columns = {n: table.column(n) for n in keep.names} | {n: pa.array(x, pa.float64()) for n, x in scores.items()}
        return pa.table(columns)

    return inputs.groupBy(ATHLETE).applyInArrow(score, T.StructType(list(kinds.values())))


def trailing_share(df: DataFrame, column: str, value: str, out: str, days: int = fixed.BASELINE_DAYS) -> DataFrame:
    """Rank of a value in the trailing days without a minimum history."""
    frame = with_day(df).withColumn("_h", F.collect_list(column).over(by_days(-days, -1)))
    known = col(value).isNotNull() & (F.size("_h") > 0)
    share = F.when(known, share_not_above(F.col("_h"), col(value)))
    return frame.withColumn(out, share).drop("_h")


def trailing_rows(df: DataFrame, days: int, out: str = "history_rows") -> DataFrame:
    """Rows in the trailing days, today excluded."""
    return with_day(df).withColumn(out, F.count(F.lit(1)).over(by_days(-days, -1)))


def trailing_medians(df: DataFrame, columns: Sequence[str], days: int = fixed.BASELINE_DAYS, prefix: str = "median_") -> DataFrame:
    frame = with_day(df)
    return frame.withColumns({f"{prefix}{c}": F.percentile(c, F.lit(0.5)).over(by_days(-days, -1)) for c in columns})


def monotony(df: DataFrame, column: str = "running_bone_stress_load", days: int = 7) -> DataFrame:
    """Mean over spread of the week's loads, capped, and load times that."""
    frame = with_day(df)
    week = by_days(1 - days, 0)
    x = F.coalesce(col(column), F.lit(0.0))
    frame = frame.withColumns(
        {"_week_sum": F.sum(x).over(week), "_week_mean": F.avg(x).over(week), "_week_std": F.stddev_pop(x).over(week)}
    )
    # The ratio is settled, because it is compared with whole and half numbers
    # that simple weeks hit exactly.
    quotient = settle(F.col("_week_mean") / F.col("_week_std"), 9)
    spread = F.when(F.col("_week_std") > 0, F.least(quotient, F.lit(fixed.MONOTONY_CAP)))
    ratio = F.when(F.col("_week_sum") > 0, F.coalesce(spread, F.lit(fixed.MONOTONY_CAP))).otherwise(0.0)
    frame = frame.withColumn("foster_monotony", ratio)
    return frame.withColumn("foster_strain", F.greatest(F.col("_week_sum"), F.lit(0.0)) * F.col("foster_monotony")).drop(
        "_week_sum", "_week_mean", "_week_std"
    )


def insufficient_rest(df: DataFrame, out: str = "insufficient_rest_score", days: int = 7) -> DataFrame:
    """Hard days, poor-readiness days and missing easy days of the last week."""
    frame = with_day(df)
    week = by_days(-days, -1)
    frame = frame.withColumns(
        {
            "_rows": F.count(F.lit(1)).over(week),
            "_loads": F.collect_list("load").over(week),
            "_days": F.collect_list(F.struct("load", "duration")).over(week),
            "_low": F.count(F.when(F.col("readiness") < 50, True)).over(week),
            "_mid_load": F.percentile("load", F.lit(0.5)).over(week),
            "_mid_duration": F.percentile("duration", F.lit(0.5)).over(week),
        }
    )
    loads = F.col("_loads")

    def average_rank(v: Column) -> Column:
        below = F.size(F.filter(loads, lambda u: u < v))
        ties = F.size(F.filter(loads, lambda u: u == v))
        return below + (ties + 1) / 2.0

    hard = F.size(F.filter(loads, lambda v: average_rank(v) / F.size(loads) > 0.75))
    easy = F.size(
        F.filter("_days", lambda e: (e["duration"] <= F.col("_mid_duration")) & (e["load"] <= F.col("_mid_load")))
    )
    points = hard * 14 + F.col("_low") * 12 + F.greatest(F.lit(0), 2 - easy) * 12
    score = F.least(points.cast("double"), F.lit(100.0))
    return frame.withColumn(out, F.when(F.col("_rows") == 0, 0.0).otherwise(score)).drop(
        "_rows", "_loads", "_days", "_low", "_mid_load", "_mid_duration"
    )


def previous_rows(df: DataFrame, columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Values of the row before, whatever its date."""
    frame = with_day(df)
    order = history_order()
    return frame.withColumns({f"{prefix}{c}": F.lag(c).over(order) for c in columns})


def last_known(df: DataFrame, column: str, out: str, rows: int = fixed.WINDOW_ROWS) -> DataFrame:
    """Last non-null value in the rows before."""
    return with_day(df).withColumn(out, F.last(column, ignorenulls=True).over(by_rows(-rows, -1)))


def rolling_max(df: DataFrame, column: str, out: str, rows: int, digits: int = 2) -> DataFrame:
    scale = float(10**digits)
    top = F.max(column).over(by_rows(1 - rows, 0))
    return with_day(df).withColumn(out, F.rint(top * scale) / scale)
