"""SimHash near duplicates against all pairs."""

from __future__ import annotations

import collections
import itertools
import random

import pytest
import xxhash

from paceframe.llm import simhash
from tests.llm.helpers import awkward, prose, table, with_clashes
from tests.llm.test_native_and_scores import WORD, lower


def brute_print(text: str | None, size: int = 4) -> int:
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints: list[int], distance: int) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            root[find(b)] = find(a)
    return [find(k) for k in range(len(prints))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def clouds(seed: int, distance: int) -> list[int]:
    """Crowds of fingerprints around a centre, chains of links, pairs just within and just beyond, and lone ones."""
    r = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    out = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 63]
    for n in range(distance + 3):
        out += [flip(x, n) for x in out[:20]]
    centre, low = r.getrandbits(64), (1 << 24) - 1
    out += [flip(centre, r.randrange(10)) for _ in range(150)]
    # One half of the bits in common: crowded buckets without links.
    out += [centre & ~low | r.getrandbits(24) for _ in range(120)]
    for _ in range(8):
        x = r.getrandbits(64)
        for _ in range(12):
            x = flip(x, distance)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize(("seed", "distance"), [(1, 4), (2, 4), (3, 2), (4, 7)])
def test_no_link_is_lost(spark, seed, distance):
    prints = clouds(seed, distance)
    nodes = spark.createDataFrame([(signed(x),) for x in prints], "fp long").coalesce(2)
    got = {r.fp: r.root for r in simhash.linked_roots(nodes, distance).collect()}
    groups = collections.defaultdict(set)
    for x, k in zip(prints, brute_roots(prints, distance), strict=True):
        groups[k].add(signed(x))
    mine = collections.defaultdict(set)
    for x in prints:
        mine[got.get(signed(x), signed(x))].add(signed(x))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))
    assert all(len(g) > 1 for k, g in mine.items() if k in got.values())


def test_table_discards_far_pairs_and_keeps_near_ones(spark):
    r = random.Random(5)
    pairs = []
    for k in range(600):
        a = r.getrandbits(64)
        pairs.append((signed(a), signed(a ^ sum(1 << b for b in r.sample(range(64), k % 5)) if k < 300 else r.getrandbits(64))))
    df = spark.createDataFrame(pairs, "x long, y long")
    a = simhash.with_distances(df.selectExpr("x", "y", "x AS fp")).drop("fp").alias("a")
    b = simhash.with_distances(df.selectExpr("x", "y", "y AS fp")).drop("fp").alias("b")
    both = a.join(b, ["x", "y"]).withColumn("ok", simhash.coordinates_within("a", "b", 4))
    near = [(x.ok, (x.x ^ x.y) & (1 << 64) - 1) for x in both.select("x", "y", "ok").collect()]
    assert all(ok for ok, d in near if d.bit_count() <= 4)
    assert sum(ok for ok, d in near if d.bit_count() > 16) < 10


def test_documents_with_awkward_rows(spark):
    base = prose(77, 150).split()
    rows = awkward() + [(200 + k, " ".join(base[: 100 + k % 7] + ["new"] * (k % 3) + base[110:]), "en", "a", 1) for k in range(40)]
    rows += [(300 + k, ["a", "A", "a b", "a b c", "a b c d", "a  b\tc d"][k % 6], "en", "a", 1) for k in range(12)] + [(400, "word " * 9000 + prose(3, 900), "en", "a", 1)]
    got = simhash.simhash_components(with_clashes(table(spark, rows))).collect()
    prints = [brute_print(t) for _, t, *_ in rows]
    roots, names = brute_roots(prints, 4), {}
    for (i, *_), k in zip(rows, roots, strict=True):
        names[k] = min((x for x in (names.get(k), i) if x is not None), default=None)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(((i, f"{p:016x}", names[k]) for (i, *_), p, k in zip(rows, prints, roots, strict=True)), key=key)
    assert simhash.simhash_components(table(spark, [])).count() == 0


def test_query_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [brute_print(d.text) for d in docs]
    roots = brute_roots(prints, 4)
    least = {}
    for d, k in zip(docs, roots, strict=True):
        least[k] = min(least.get(k, d.doc_id), d.doc_id)
    want = sorted((d.doc_id, f"{p:016x}", least[k]) for d, p, k in zip(docs, prints, roots, strict=True))
    assert sorted(tuple(r) for r in simhash.op12_simhash(spark, sf).collect()) == want
    assert any(c < i for i, _, c in want)
