"""Best-fit packing of documents into sequences by minimum bin slack.

A bin is filled from the longest piece left and the combination of the other
lengths that leaves the least slack, found by a bitset subset-sum over the
available lengths; the combination is then removed, as often as the counts allow
it. Only the counts of lengths (``capacity`` of them at most) decide, so the plan
is made from a histogram; Spark counts the lengths, ranks the pieces of a length
and looks their places up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceframe.llm import common, tokens

CAPACITY = 2048
_PIECES = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("local_rank", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_PIECES_SQL = "part long, doc_id long, piece int, start long, length long, local_rank long, ids_crc32 long, ids binary"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length so that the sum comes closest to ``room``; long pieces first among equals."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left > 0:  # multiples in powers of two
            k = min(chunk, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            chunk *= 2
        if reach >> room & 1:
            break
    best, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            taken[length] = taken.get(length, 0) + k
            best -= length * k
    return taken


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination of lengths, number of bins filled so) until no piece is left."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is empty or longer than a bin")
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        bin_ = fullest({n: c for n, c in left.items() if c}, capacity - seed)
        left[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(left[n] // k for n, k in bin_.items())
        for n, k in bin_.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((bin_, times))
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For ranks of a length from ``first`` on: how many stand in a bin, the first bin, the first place in it."""
    seen: dict[int, int] = {}
    rows, bins = [], 0
    for bin_, times in plan:
        offset = 0
        for n in sorted(bin_, reverse=True):
            rows.append((n, seen.get(n, 0), bin_[n], bins, offset))
            seen[n] = seen.get(n, 0) + bin_[n] * times
            offset += n * bin_[n]
        bins += times
    rows.sort()
    table = np.array(rows or [(0, 0, 1, 0, 0)], dtype=np.int64)
    return {"key": (table[:, 0] << 44) + table[:, 1], "first": table[:, 1], "each": table[:, 2], "bin": table[:, 3], "offset": table[:, 4]}


def _order_among_equals(x: np.ndarray) -> np.ndarray:
    """For each number, how many of the same stand before it."""
    order = np.argsort(x, kind="stable")
    sorted_ = x[order]
    first = np.searchsorted(sorted_, sorted_)
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - first
    return out


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text; the first of a long document takes the remainder."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        for doc_ids, texts in common.steps(batches, tokens.STEP_CHARS):
            flat, starts = made.encode(texts, end_id)
            n = np.diff(starts)
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            # The first piece takes the remainder, all others are full.
            first = n - (pieces - 1) * capacity
            begin = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            rank = ranks[length] + _order_among_equals(length)
            ranks += np.bincount(length, minlength=capacity + 1)
            data = memoryview(flat.astype("<u4").tobytes())
            edges = [(4 * a, 4 * b) for a, b in zip((starts[doc] + begin).tolist(), (starts[doc] + begin + length).tolist(), strict=True)]
            columns = [np.full(len(doc), part, np.int64), pa.array(doc_ids, pa.int64()).take(pa.array(doc)), piece.astype(np.int32), begin, length, rank, np.array([zlib.crc32(data[a:b]) for a, b in edges], np.int64)]
            ids = pa.array([bytes(data[a:b]) for a, b in edges], pa.binary()) if keep_ids else pa.nulls(len(doc), pa.binary())
            yield pa.record_batch([*map(pa.array, columns), ids], schema=_PIECES)

    return common.id_and_text(docs, id_col, text_col).mapInArrow(cut, _PIECES_SQL)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and (if kept) ids.

    A null text is empty and gives a piece with the end id alone; a null id stays
    null; repeated rows are packed each. An empty table gives no rows. Other
    columns are left out.
    """
    pieces = common.staged(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, keep_ids))
    # Rows here: tasks x lengths. A hot length has one row for each task.
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = _places(plan_bins(histogram, capacity))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(plan["key"], (length << 44) + rank, side="right") - 1
            r = rank - plan["first"][at]
            sequence = plan["bin"][at] + r // plan["each"][at]
            offset = plan["offset"][at] + r % plan["each"][at] * length
            rest = [c for c in batch.schema.names if c != "rank"]
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(sequence), pa.array(offset)], names=[*rest, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = pieces.join(bases, ["part", "length"]).select(*columns, (F.col("base") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
