"""A quality classifier: generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one measure at a time, and each tree only
changes the lookup table of its measure; pairs of measures with the largest
remaining gain get tables of their own in a second phase. A score is the sum of
table entries, added for a whole batch at a time.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import common

#: Labelled training documents that the model is fitted on at most; the smallest hashes are taken.
TRAIN_ROWS = 40_000
BINS, PAIR_BINS, PAIRS = 64, 16, 8
ROUNDS, RATE, LEAST_WEIGHT = 80, 0.2, 5.0
FOLDS = 5
THRESHOLD = 0.3

MEASURES = (
    "log_chars", "log_words", "word_length", "longest_word", "symbol_share", "pipe_share", "exclaim_share", "sfirst_word_share", "upper_share", "digit_share",
    "distinct_share", "neighbour_share", "first_word_share", "line_words", "dup_line_share", "non_ascii_share",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>@^~_=+\\/{}[]", np.uint8)
_LINE = re.compile(r"[^\x20\x09-\x0D]")


def measure(text: str) -> tuple[float, ...]:
    """The measures of one whole text; all are defined for an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    n, w = max(1, len(data)), max(1, len(words))
    lines = [x for x in text.split("\n") if _LINE.search(x)]
    distinct = set(words)
    neighbours = sum(map(operator.eq, words, words[1:]))
    # The first word's share is enough to tell one word repeated throughout from prose.
    return (
        float(np.log1p(len(data))), float(np.log1p(len(words))), len(data) / w, float(max(map(len, distinct), default=0)), counts[_SYMBOLS].sum() / n, counts[124] / w,
        counts[33] / w, counts[46] / w, counts[65:91].sum() / n, counts[48:58].sum() / n, len(distinct) / w, neighbours / w, words.count(words[0]) / w if words else 0.0,
        len(words) / max(1, len(lines)), (len(lines) - len(set(lines))) / max(1, len(lines)), counts[128:].sum() / n,
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measures of every row; a null text is empty."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.steps(batches):
            table = np.array([measure(t) for t in texts], dtype=np.float64)
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(table[:, k]) for k in range(len(MEASURES)))], names=["doc_id", *MEASURES])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(rows, "doc_id long, " + ", ".join(f"{m} double" for m in MEASURES))


@dataclass
class AdditiveModel:
    """Lookup tables: ``edges`` and ``tables`` by measure, ``pair_tables`` by pair of measures."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, by additions of table entries."""
        total = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, k], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best gain of one cut of a histogram, and where it is."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= LEAST_WEIGHT * 0.05) & (hr >= LEAST_WEIGHT * 0.05), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
    return (-1.0, 0) if not len(gain) else (float(gain.max()), int(gain.argmax()) + 1)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of at most four leaves for every bin."""
    out = np.zeros(len(g))
    gain, at = _cut(g, h)
    for a, b in [(0, at), (at, len(g))] if gain >= 0 else [(0, len(g))]:
        inner, cut = _cut(g[a:b], h[a:b])
        for c, d in [(a, a + cut), (a + cut, b)] if inner >= 0 else [(a, b)]:
            out[c:d] = _leaf(g[c:d], h[c:d])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both measures of a pair once."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best = (-1.0, np.zeros_like(g))
    if min(g.shape) < 2:
        return best
    a, b = gs[:-1, :-1], hs[:-1, :-1]
    parts = [(a, b), (gs[:-1, -1:] - a, hs[:-1, -1:] - b), (gs[-1:, :-1] - a, hs[-1:, :-1] - b), (gs[-1, -1] - gs[:-1, -1:] - gs[-1:, :-1] + a, hs[-1, -1] - hs[:-1, -1:] - hs[-1:, :-1] + b)]
    gain = sum(x**2 / (y + 1.0) for x, y in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    for (x, y), (r, c) in zip(parts, [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))], strict=True):
        out[r, c] = x[i, j] / (y[i, j] + 1.0)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fits the model; with one class only, or no rows, it is that class's smoothed rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    n = x.shape[1]
    edges = [_edges(x[:, k], BINS) if len(x) else np.array([]) for k in range(n)]
    pair_edges = [_edges(x[:, k], PAIR_BINS) if len(x) else np.array([]) for k in range(n)]
    model = AdditiveModel(float(np.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges], pair_edges, [], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    total = np.full(len(y), model.intercept)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(ROUNDS):
        for k in range(n):
            g, h = slopes()
            size = len(edges[k]) + 1
            step = RATE * _tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size))
            model.tables[k] += step
            total += step[bins[k]]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(pair_edges)]

    def histogram(i: int, j: int, values: np.ndarray) -> np.ndarray:
        a, b = len(pair_edges[i]) + 1, len(pair_edges[j]) + 1
        return np.bincount(coarse[i] * b + coarse[j], values, a * b).reshape(a, b)

    g, h = slopes()
    ranked = sorted(((_quadrants(histogram(i, j, g), histogram(i, j, h))[0], (i, j)) for i in range(n) for j in range(i)), reverse=True)
    model.pairs = [p for _, p in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(ROUNDS // 2):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _quadrants(histogram(i, j, g), histogram(i, j, h))[1]
            model.pair_tables[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def train(table: DataFrame, labels: DataFrame, label_col: str = "quality") -> AdditiveModel:
    """Fits on at most ``TRAIN_ROWS`` labelled rows outside fold 0 of the id's crc32; several labels of an id are averaged."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    rows = table.where(common.bucket("doc_id", FOLDS) != 0).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), *MEASURES).limit(TRAIN_ROWS).toPandas()
    return fit(rows[list(MEASURES)].to_numpy(np.float64).reshape(-1, len(MEASURES)), rows["label"].to_numpy(np.float64))


def scored(table: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of every measured row."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(m).to_numpy(zero_copy_only=False) for m in MEASURES]) if batch.num_rows else np.zeros((0, len(MEASURES)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return table.mapInArrow(rows, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted, one row per document row.

    Null and empty texts are scored as empty; a null id is in no training row;
    repeated rows are scored each; other columns are left out and may have any
    names. Without labels every score is 0.5; an empty table gives no rows.
    """
    table = common.staged(measured(docs, id_col, text_col))
    out = scored(table, train(table, labels))
    return out.select("doc_id", (common.bucket("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold; edge cases as in ``quality_scores``."""
    model = train(measured(docs.where(common.bucket(docs[id_col], FOLDS) != 0), id_col, text_col), labels)
    at = docs.columns.index(text_col)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([measure(t.as_py() or "") for t in batch.column(at)], dtype=np.float64).reshape(-1, len(MEASURES))
            yield batch.filter(pa.array(model.score(table) >= threshold))

    return docs.mapInArrow(rows, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
