"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits leaves one of k + 1 pieces
untouched. The pieces of a block of items are looked up in a text by one
automaton, k being an item's whole budget, which also covers a replaced word. Of
the item's grams, cut more finely, k edits leave all but k untouched: a hit with
fewer of them around it is dropped, and around the others the whole item is
matched by Myers' bit-parallel distance. Texts and items are compared in lower
case with runs of white space as one blank.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import common

#: Items shorter than 1 / SURE_RATE must occur as they are.
SURE_RATE = 0.06
#: Edits allowed, as a share of an item's length; a replaced word may cost up to WORD_RATE of it.
EDIT_RATE, WORD_RATE = 0.1, 0.15
#: Characters of a gram, at least.
GRAM = 3
#: Characters of items that go to the workers at once; the documents are read once for each block.
BLOCK_CHARS = 1_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def edit_budget(item: str, edit_rate: float = EDIT_RATE) -> int:
    """Edits allowed for a plain item: a share of its length, or its longest word if that is no more than WORD_RATE of it; none for a short one."""
    if not int(SURE_RATE * len(item)):
        return 0
    return max(int(edit_rate * len(item)), min(max(map(len, item.split(" "))), int(WORD_RATE * len(item)) if edit_rate else 0))


def piece_edges(item: str, edit_rate: float = EDIT_RATE) -> list[int]:
    """Where a plain item is cut: into one piece more than edits are allowed, so one is untouched wherever they are."""
    n = min(edit_budget(item, edit_rate) + 1, len(item))
    return [len(item) * k // n for k in range(n + 1)]


def grams(item: str) -> list[str]:
    """A plain item cut into as many pieces of ``GRAM`` characters or one more as it has; an edit touches one at most."""
    n = max(1, len(item) // GRAM)
    return [item[len(item) * k // n : len(item) * (k + 1) // n] for k in range(n)]


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] has no letter or digit on either side."""
    return not (start > 0 and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


@dataclass(frozen=True)
class Match:
    """An item in a text: where in the plain text its last character stands, and the distance there."""

    item: int
    distance: int
    end: int


def best_distance(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of ``pattern`` in ``text``, the first among equals; None beyond the budget."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for k, ch in enumerate(pattern):
        where[ch] = where.get(ch, 0) | 1 << k
    up, down, score, best = full, 0, m, None
    for k, ch in enumerate(text):
        eq = where.get(ch, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & full
        right = down | ~(d | up) & full
        left = up & d
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        # The first row is free: an occurrence may begin anywhere.
        right <<= 1
        left <<= 1
        up = (left | ~(x | right)) & full
        down = right & x & full
        if score <= budget and (best is None or score < best[0]):
            best = (score, k)
    return best


class Items:
    """A block of test items with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float = EDIT_RATE):
        import ahocorasick

        self.items = [(i, p, edit_budget(p, edit_rate)) for i, t in items if (p := plain(t))]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, p, budget) in enumerate(self.items):
            if not budget:
                at[p].append((n, 0))  # short items must stand as whole words
                continue
            edges = piece_edges(p, edit_rate)
            for a, b in zip(edges, edges[1:], strict=False):
                at[p[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.empty = not at
        self.grams = [grams(p) for _, p, _ in self.items]

    def _may_hold(self, n: int, window: str) -> bool:
        """Whether the window has as many of an item's grams as its budget leaves untouched."""
        spare = self.items[n][2]
        for g in self.grams[n]:
            if g not in window:
                spare -= 1
                if spare < 0:
                    return False
        return True

    def matches(self, text: str) -> list[Match]:
        """Every item that the whole text holds, with its best place."""
        if self.empty:
            return []
        padded = f" {plain(text)} "
        windows: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(padded):
            for n, offset in places:
                _, p, budget = self.items[n]
                start = end + 1 - size - offset
                if not budget and not _stands_alone(padded, start, end + 1):
                    continue
                span = (start - budget, start + len(p) + budget)
                if span not in windows[n] and (not budget or self._may_hold(n, padded[max(0, span[0]) : span[1]])):
                    windows[n].add(span)
        out = []
        for n, found_at in windows.items():
            item, p, budget = self.items[n]
            if not found_at:
                continue
            if not budget:
                out.append(Match(item, 0, min(b for _, b in found_at) - 2))
                continue
            # Overlapping windows are read once, so repeated pieces cost no more than the text's length.
            spans = sorted(found_at)
            best, k = None, 0
            while k < len(spans):
                a, b = spans[k]
                while k + 1 < len(spans) and spans[k + 1][0] <= b:
                    k += 1
                    b = max(b, spans[k][1])
                k += 1
                found = best_distance(p, padded[max(0, a) : b], budget)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], max(0, a) + found[1])
                if best and not best[0]:
                    break
            if best:
                out.append(Match(item, best[0], best[1] - 1))
        return sorted(out, key=lambda m: (m.item is None, m.item or 0))


def item_blocks(items: DataFrame, block_chars: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (id, text) of about ``block_chars`` characters, each fetched alone."""
    table = common.id_and_text(items, id_col, text_col).where(F.col("text") != "").distinct()
    size = table.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_chars)
    for k in range(blocks):
        yield [(r["id"], r["text"]) for r in table.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()]


def find_matches(docs: DataFrame, items: DataFrame, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance and end (in the plain text): a row for every item that a document row holds.

    Null and empty texts hold nothing, null and empty items are in no text; items
    too short for an edit must stand as whole words; every other one within its
    ``edit_budget`` is found, wherever the edits are; repeated rows give rows
    each, repeated items one; empty tables give no rows. Other columns are left out.
    """
    base = common.id_and_text(docs, id_col, text_col)

    def search(block: list[tuple[int, str]]) -> Callable:
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = Items(block, edit_rate)
            for ids, texts in common.steps(batches):
                found = [(i, m.item, m.distance, m.end) for i, t in zip(ids, texts, strict=True) for m in made.matches(t)]
                if found:
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "end"])

        return rows

    shape = "doc_id long, item_id long, distance int, end long"
    out = docs.sparkSession.createDataFrame([], shape)
    for block in item_blocks(items, block_chars, item_id_col, item_text_col):
        out = out.unionByName(base.mapInArrow(search(block), shape))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text holds none of the items; edge cases as in ``find_matches``."""

    def keep(block: list[tuple[int, str]]) -> Callable:
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = Items(block, edit_rate)
            for batch in batches:
                yield batch.filter(pa.array([not made.matches(t.as_py() or "") for t in batch.column(at)], pa.bool_()))

        return rows

    at = docs.columns.index(text_col)
    out = docs
    for block in item_blocks(items, block_chars, item_id_col, item_text_col):
        out = out.mapInArrow(keep(block), docs.schema)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its distance."""
    return find_matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
