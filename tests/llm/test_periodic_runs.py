"""Periodic runs against all stretches of small texts."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from paceframe.llm import periodic_runs
from tests.llm.helpers import awkward, prose, table, with_clashes
from tests.llm.test_native_and_scores import WORD


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    """Maximal stretches of every lag; of equal stretches the smallest lag is the period."""
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted((a, n, q) for (a, n), q in best.items())


def brute(text: str | None, doc_id: int | None, plant: bool) -> tuple:
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    return n, runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def scanned(docs: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    lengths = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    x = np.array([c for k, d in enumerate(docs) for c in [*d, -1 - k]], np.int64)
    out: list = [[] for _ in docs]
    for a, n, q in periodic_runs.runs_of(x, starts, lengths).tolist():
        k = int(np.searchsorted(starts, a, side="right")) - 1
        out[k].append((a - int(starts[k]), n, q))
    return out


def periodic(r: random.Random, alphabet: int) -> list[int]:
    """Stretches that repeat, between words that do not, with some words changed."""
    out: list[int] = []
    for _ in range(r.randrange(1, 5)):
        block = [r.randrange(alphabet) for _ in range(r.choice([1, 2, 3, 5, 8, 15, 16, 17, 18, 31, 32, 33, 34, 40, 63, 64, 65, 66, 90]))]
        n = int(len(block) * r.choice([1.5, 3.9, 4, 4.0, 4.1, 5.5, 9]) + r.randrange(3))
        out += [block[i % len(block)] for i in range(n)] + [1000 + r.randrange(10**6) for _ in range(r.randrange(4))]
    for _ in range(r.randrange(3)):
        out[r.randrange(len(out))] = 7
    return out


@pytest.mark.parametrize("alphabet", [2, 3, 50, 10**6])
def test_no_run_is_lost_or_invented(alphabet):
    r = random.Random(alphabet)
    docs = [periodic(r, alphabet) for _ in range(150)] + [[r.randrange(2) for _ in range(k)] for k in range(40)] + [[], [1], [5] * 400, [1, 2] * 300]
    assert scanned(docs) == [brute_runs(d) for d in docs]


def test_minimizers_are_least_of_some_window():
    r = np.random.default_rng(3)
    for n, w in ((1, 1), (5, 8), (40, 3), (64, 16), (200, 7)):
        h = r.integers(0, 30, n).astype(np.uint64)
        want = sorted({j for i in range(n - w + 1) for j in range(i, i + w) if h[j] == h[i : i + w].min()})
        assert periodic_runs.minimizers(h, w).tolist() == want


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(3, np.int64), np.array([0]), np.array([2]), min_periods=3)


@pytest.mark.parametrize("plant", [False, True])
def test_documents_with_awkward_rows(spark, plant):
    long = " ".join(["one two three"] * 3000 + [prose(4, 40)] * 9)
    rows = awkward() + [(100 + k, prose(k, 3 + 7 * k), "en", "a", 1) for k in range(60)] + [(30, long, "en", "a", 1), (31, "a\x1cb a\x85b " * 9, "en", "a", 1)]
    got = periodic_runs.find_runs(with_clashes(table(spark, rows)), plant=plant).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(((i, *brute(t, i, plant)) for i, t, *_ in rows), key=key)
    assert periodic_runs.find_runs(table(spark, [])).count() == 0


def test_query_on_the_whole_table(spark, sf):
    got = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs) and sum(r.n_runs for r in got.values()) > 10
    for d in docs:
        _, runs, collapsed = brute(d.text, d.doc_id, True) if len(d.text or "") < 20_000 else (0, None, "")
        if runs is None:
            continue
        r = got[d.doc_id]
        best = None
        for a, n, q in runs:
            if best is None or n * best[2] > best[1] * q:
                best = (a, n, q)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed.encode()).hexdigest()
