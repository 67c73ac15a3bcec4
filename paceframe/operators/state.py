"""State carried along an athlete's rows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceframe.functions.numbers import or_zero
from paceframe.keys import ATHLETE, DAY, by_rows, history_order, with_day


def _block(decay: float) -> int:
    """Rows of a block: few enough that ``decay ** -rows`` stays far from overflow."""
    return max(2, min(512, math.floor(math.log(1e-12) / math.log(decay))))


def linear_carry(df: DataFrame, column: str, out: str, decay: float) -> DataFrame:
    """``c = decay * c + (1 - decay) * x`` by row, starting from zero; null inputs leave the state as it is.

    Rows are numbered and cut into blocks. Within a block the state is a running
    sum of inputs scaled by powers of the decay; what finished blocks carry over
    is folded from one total per block. Nothing is cut off, and a row costs the
    same in a long history as in a short one.
    """
    size = _block(decay)
    x = F.col(column)
    frame = with_day(df).withColumn("_n", F.count(x).over(by_rows(Window.unboundedPreceding, 0)) - 1)
    frame = frame.withColumns({"_b": F.floor(F.col("_n") / size), "_j": F.pmod(F.col("_n"), F.lit(size))})
    inside = Window.partitionBy(ATHLETE, "_b").orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    grown = F.sum(x * F.pow(F.lit(1.0 / decay), F.col("_j"))).over(inside)
    frame = frame.withColumn("_s", (1.0 - decay) * F.coalesce(grown, F.lit(0.0)) * F.pow(F.lit(decay), F.col("_j")))
    # A block's last value is its total; the list has one entry for each finished block.
    total_ = F.when(x.isNotNull() & (F.col("_j") == size - 1), F.col("_s"))
    frame = frame.withColumn("_t", F.collect_list(total_).over(by_rows(Window.unboundedPreceding, -1)))
    # A row that repeats the number of a block's last row has that block in its own sum already.
    finished = F.slice("_t", 1, F.greatest(F.col("_b"), F.lit(0)).cast("int"))
    before = F.aggregate(finished, F.lit(0.0), lambda c, t: c * decay**size + t)
    state = F.col("_s") + before * F.pow(F.lit(decay), F.col("_j") + 1)
    return frame.withColumn(out, F.when(F.col("_n") >= 0, state).otherwise(0.0)).drop("_n", "_b", "_j", "_s", "_t")


#: Share of the gap that a higher value closes; the state stays between these bounds.
RISE, LEAST, MOST = 0.70, 0.0, 100.0
#: Calendar days of a block of the history.
BLOCK_DAYS = 1024


def decay_rate(km: Column, recovery: Column, load: Column) -> Column:
    """Share of the state that a day without a higher value leaves, by context."""
    return (
        F.when((km >= 80) | (recovery >= 55) | (load >= 70), 0.97)
        .when((km <= 35) & (recovery <= 35) & (load <= 45), 0.88)
        .when((km <= 50) & (recovery <= 45) & (load <= 55), 0.91)
        .otherwise(0.94)
    )


def next_state(previous: float, value: float, decay: float) -> float:
    """Rise by a share of the gap; else decay, but not below the value."""
    new = previous + RISE * (value - previous) if value > previous else max(value, previous * decay)
    return min(MOST, max(LEAST, new))


Knots = list[tuple[float, float]]

#: The map that leaves every state as it is.
UNCHANGED: Knots = [(LEAST, LEAST), (MOST, MOST)]


def then_step(knots: Knots, value: float, decay: float) -> Knots:
    """The map ``knots`` followed by one step.

    A step is a monotone piecewise-linear function of the state, so what a stretch
    of rows does is one too: (state before, state after) at the knots and lines
    between them. Steps contract, so a map has few knots and soon is constant.
    """
    breaks = sorted({value, value / decay, (MOST - RISE * value) / (1 - RISE)})
    out: Knots = []
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out.append((x0, next_state(y0, value, decay)))
        out += [(x0 + (b - y0) * (x1 - x0) / (y1 - y0), next_state(b, value, decay)) for b in breaks if y0 < b < y1]
    out.append((knots[-1][0], next_state(knots[-1][1], value, decay)))
    # Of knots on one level the first and the last suffice.
    return [k for i, k in enumerate(out) if i in (0, len(out) - 1) or not out[i - 1][1] == k[1] == out[i + 1][1]]


def composed(rows: Iterable[tuple[float | None, float]]) -> Knots:
    """The map of rows (value, decay rate) in order; a row without a value changes nothing."""
    knots = UNCHANGED
    for value, decay in rows:
        if value is not None:
            knots = then_step(knots, value, decay)
    return knots


def replayed(entry: float, rows: Iterable[tuple[float | None, float]]) -> list[float | None]:
    """The state after each row, from the state before the first; null where the row has no value."""
    state, out = entry, []
    for value, decay in rows:
        if value is not None:
            state = next_state(state, value, decay)
        out.append(None if value is None else state)
    return out


def state_after(knots: Column, state: Column) -> Column:
    """A map, as an array of (x, y) by x, applied to a state."""
    left = F.greatest(F.least(F.size(F.filter(knots, lambda k: k["x"] <= state)), F.size(knots) - 1), F.lit(1))
    a, b = F.element_at(knots, left), F.element_at(knots, left + 1)
    return a["y"] + F.when(b["x"] > a["x"], (state - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])).otherwise(0.0)


def block_states(rows: DataFrame) -> DataFrame:
    """``athlete_id`` and ``states``: of every athlete's rows (athlete, day, value, rate) in order of days, the state after each.

    Blocks of the history are summarised as maps, each on its own; a block's entry
    state is what the maps of the blocks before it make of zero; then each block is
    replayed. Only these four columns pass Python, a row per block.
    """
    block = F.floor(F.col(DAY) / BLOCK_DAYS)
    history = F.array_sort(F.collect_list(F.struct(DAY, "value", "rate")))
    blocks = rows.groupBy(ATHLETE, block.alias("block")).agg(history.alias("rows"))
    in_order = lambda batch: ([(r["value"], r["rate"]) for r in some] for some in batch.column("rows").to_pylist())

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        for batch in batches:
            knots = [[{"x": x, "y": y} for x, y in composed(some)] for some in in_order(batch)]
            yield pa.record_batch([*batch.columns, pa.array(knots, kind)], names=[*batch.schema.names, "knots"])

    def replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [replayed(entry, some) for entry, some in zip(batch.column("entry").to_pylist(), in_order(batch), strict=True)]
            yield pa.record_batch([batch.column(ATHLETE), batch.column("block"), pa.array(states, pa.list_(pa.float64()))], names=[ATHLETE, "block", "states"])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    shape = f"{ATHLETE} {kinds[ATHLETE]}, block {kinds['block']}, rows {kinds['rows']}"
    mapped = blocks.mapInArrow(summarise, f"{shape}, knots array<struct<x:double,y:double>>")
    earlier = Window.partitionBy(ATHLETE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.aggregate(F.collect_list("knots").over(earlier), F.lit(LEAST), lambda s, k: state_after(k, s))
    entered = mapped.withColumn("entry", entry).select(ATHLETE, "block", "rows", "entry")
    done = entered.mapInArrow(replay, f"{ATHLETE} {kinds[ATHLETE]}, block {kinds['block']}, states array<double>")
    parts = F.array_sort(F.collect_list(F.struct("block", "states")))
    return done.groupBy(ATHLETE).agg(F.flatten(F.transform(parts, lambda p: p["states"])).alias("states"))


def asymmetric_state(
    df: DataFrame,
    column: str = "frontier_strain_score",
    out: str = "accumulated_frontier_state",
    km: str = "running_7d_sum_m",
    recovery: str = "recovery_strain_score",
    load: str = "accumulated_bone_stress_state",
) -> DataFrame:
    """Non-linear carry over the whole history; null input, null output.

    An athlete has at most one row per calendar day. The states come as one array
    per athlete and are taken by the row's place, so the other columns neither
    pass Python nor are dealt out again.
    """
    frame = with_day(df)
    rate = decay_rate(or_zero(km) / 1000.0, or_zero(recovery), or_zero(load))
    states = block_states(frame.select(ATHLETE, DAY, F.col(column).cast("double").alias("value"), rate.alias("rate")))
    states = states.select(F.col(ATHLETE).alias("_athlete"), F.col("states").alias("_states"))
    placed = frame.withColumn("_place", F.row_number().over(history_order()))
    joined = placed.join(states.hint("merge"), placed[ATHLETE] == states["_athlete"], "left")
    return joined.withColumn(out, F.element_at("_states", F.col("_place"))).drop("_athlete", "_states", "_place")
