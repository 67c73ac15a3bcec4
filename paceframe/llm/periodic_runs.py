"""Finds periodic runs of words by multi-scale minimizers and collapses them.

A run is a stretch with a smallest period of q words, at least four periods and
six words long, that no neighbouring word extends. Periods up to ``LAGS`` come
from direct lag scans: a text is compared with itself q words on. For longer ones
there is a scale for each power of two k, responsible for periods in (k/2, k].
Its k-grams are hashed, and the least hash of every k/2 neighbours is a
minimizer. Within a run of such a period minimizers repeat at exactly the period:
k >= q, so equal k-grams of a run are a multiple of q apart, and k/2 neighbours
fit twice, one period apart, into the 4q words or more of a run. So each pair of
equal minimizers that follow each other at such a distance is a seed, which is
extended word by word in both directions; hashes only propose, words decide.

Documents are cut from each other by codes that occur once, so a whole batch is
scanned as one array and no run crosses a border.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import common

MIN_WORDS, MIN_PERIODS = 6, 4
#: Periods that are found by lag scans; a power of two.
LAGS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_OUT_SQL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """The least (or greatest) of every ``w`` neighbours, from prefixes and suffixes of blocks of w."""
    better, worst = (np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)) if least else (np.maximum, np.uint64(0))
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % w, worst)]).reshape(-1, w)
    front = better.accumulate(blocks, axis=1).ravel()
    back = better.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return better(back[: n - w + 1], front[w - 1 : n])


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Places whose value is the least of some ``w`` neighbours."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = _windows(h, w, True)
    # A place is in the windows that start up to w - 1 before it; the greatest of their minima is its own value or less.
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(_windows(padded, w, False) == h)


def _equal_until(x: np.ndarray, at: int, lag: int) -> int:
    """The first place from ``at`` on that differs from the one ``lag`` further (or has none)."""
    stop, step = len(x) - lag, 64
    while at < stop:
        end = min(at + step, stop)
        differ = x[at:end] != x[at + lag : end + lag]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = end, step * 4
    return stop


def _equal_since(x: np.ndarray, at: int, lag: int) -> int:
    """The first place of the stretch up to ``at`` whose words equal those ``lag`` further."""
    step = 64
    while at > 0:
        begin = max(0, at - step)
        differ = x[begin:at] != x[begin + lag : at + lag]
        if differ.any():
            return begin + int(np.flatnonzero(differ)[-1]) + 1
        at, step = begin, step * 4
    return 0


def _short_periods(x: np.ndarray, lag: int, least: int) -> list[tuple[int, int, int]]:
    same = np.flatnonzero(x[lag:] == x[:-lag]) if len(x) > lag else np.zeros(0, np.int64)
    if not len(same):
        return []
    breaks = np.flatnonzero(np.diff(same) > 1)
    first, last = same[np.concatenate([[0], breaks + 1])], same[np.concatenate([breaks, [len(same) - 1]])]
    length = last - first + 1 + lag
    long = length >= least
    return [(a, n, lag) for a, n in zip(first[long].tolist(), length[long].tolist(), strict=True)]


def _seeds(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal minimizers that follow each other at more than k/2 and at most k, by distance and place."""
    chosen = minimizers(h, k // 2)
    order = chosen[np.argsort(h[chosen], kind="stable")]
    apart = np.diff(order)
    pair = np.flatnonzero((h[order[1:]] == h[order[:-1]]) & (apart > k // 2) & (apart <= k))
    place, distance = order[pair], apart[pair]
    by = np.lexsort((place, distance))
    return place[by], distance[by]


def runs_of(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (start in ``x``, length, period) of all runs, by start and period.

    ``x``: codes of the words of documents, each followed by a code that occurs
    nowhere else; ``starts`` and ``lengths``: the documents without it.
    ``min_periods`` must be 4 or more, which the scales rely on.
    """
    if min_periods < 4:
        raise ValueError("runs of fewer than four periods are not looked for")
    least = lambda q: max(min_words, min_periods * q)
    found = [r for q in range(1, LAGS + 1) for r in _short_periods(x, q, least(q))]
    longest = int(lengths.max(initial=0))
    h, place, k = _mixed(x.astype(np.uint64) + _MIX), np.arange(len(x)), 1
    starts, lengths = np.asarray(starts), np.asarray(lengths)
    while min_periods * (k + 1) <= longest:  # the next scale has periods over k
        # Documents too short for the scale are left out, with the codes behind them.
        here = lengths >= min_periods * (k + 1)
        if not here.all():
            size = lengths + 1
            keep = np.repeat(here, size)
            h, place = h[keep], place[keep]
            starts, lengths = starts[here], lengths[here]
        if len(h) <= k:
            break
        h = _mixed(h[:-k] * _MIX + h[k:])  # the grams of 2k words
        # Places at the end have no whole gram; they get values of their own.
        h = np.concatenate([h, _mixed(np.arange(k, dtype=np.uint64) + np.uint64(1 << 40) * np.uint64(2 * k + 1))])
        k *= 2
        if k <= LAGS:
            continue
        seen = (0, 0, 0)
        for p, d in zip(*(v.tolist() for v in _seeds(h, k)), strict=True):
            at = int(place[p])
            if seen[2] == d and seen[0] <= at < seen[1]:
                continue  # the stretch is known
            if x[at] != x[at + d]:
                continue
            first, last = _equal_since(x, at, d), _equal_until(x, at, d)
            seen = (first, last, d)
            if last - first + d >= least(d):
                found.append((first, last - first + d, d))
    # A stretch with a period of q also has one of 2q; the smallest is its period.
    best: dict[tuple[int, int], int] = {}
    for a, n, q in found:
        best[a, n] = min(q, best.get((a, n), q))
    return np.array(sorted((a, n, q) for (a, n), q in best.items()), np.int64).reshape(-1, 3)


def planted(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(a, p): from word a on, a text of n words repeats p words; None: it stays. Chosen by the id's CRC-32."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text with its runs collapsed.

    Words are runs without blanks, numbered from 0. In the collapsed text each run
    has kept its first period, and words are joined by one blank. ``plant``: the
    tail of one document in ten repeats itself (``planted``; a null id counts as an
    empty one), so that every input holds runs of many lengths. A null or empty
    text has no words and collapses to the empty text; a text may have any length;
    repeated rows give rows each; other columns are left out; an empty table gives
    no rows.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.steps(batches):
            words: defaultdict = defaultdict()
            words.default_factory = words.__len__
            codes, lengths = [], np.zeros(len(texts), np.int64)
            for k, (i, text) in enumerate(zip(ids, texts, strict=True)):
                # As bytes, split() knows ASCII only, which is what the contract asks for.
                some = np.array(list(map(words.__getitem__, text.encode("utf-8", "surrogatepass").split())), np.int64)
                tail = planted(len(some), i) if plant else None
                if tail:
                    a, p = tail
                    some[a:] = some[a + np.arange(len(some) - a) % p]
                codes += [some, np.array([-1 - k], np.int64)]
                lengths[k] = len(some)
            x, starts = np.concatenate(codes), np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            spelled = list(words)
            found = runs_of(x, starts, lengths)
            of = np.searchsorted(starts, found[:, 0], side="right") - 1
            first, last = np.searchsorted(of, np.arange(len(texts))), np.searchsorted(of, np.arange(len(texts)), side="right")
            # A run's words behind its first period go: +1 where they begin, -1 behind them.
            change = np.zeros(len(x) + 1, np.int64)
            np.add.at(change, found[:, 0] + found[:, 2], 1)
            np.add.at(change, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(change[:-1]) == 0
            collapsed, runs = [], []
            for k, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
                own = found[first[k] : last[k]]
                collapsed.append(b" ".join([spelled[c] for c in x[a : a + n][kept[a : a + n]].tolist()]))
                runs.append([{"start": s - a, "length": m, "period": q} for s, m, q in own.tolist()])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lengths), pa.array(runs, _OUT.field("runs").type), pa.array(collapsed, pa.binary()).cast(pa.string())], schema=_OUT)

    return common.id_and_text(docs, id_col, text_col).mapInArrow(rows, _OUT_SQL)


#: Of two runs, the one with the greater length by period, exactly; ties go to the smaller start, then period.
_BEST = "aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)"
_RUN_LINES = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, the run of most periods, and digests of all runs and of the collapsed text, for every document."""
    found = find_runs(common.documents(spark, sf_dir), plant=True).withColumn("best", F.expr(_BEST))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(_RUN_LINES).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
