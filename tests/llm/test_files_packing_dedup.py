"""Token files, packing, line dedup, Jaccard join, decontamination and the pipeline against plain Python."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from paceframe.llm import common, decontamination, jaccard, language_model, line_dedup, packing, quality_classifier, token_files, tokens
from tests.llm.helpers import awkward, prose, table, with_clashes
from tests.llm.test_native_and_scores import WORD, lower

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


# -- tokens and files -------------------------------------------------------


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
def test_parts_give_the_ids_of_whole_texts(path, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 300)  # the memo begins anew
    r = random.Random(4)
    texts = ["", " ", "a", "a  b", "\n\na\n b\n", "a\tb \t c.", "x\x1c y", "<|endoftext|> a", "café é 　z", "it's, don't. I'd", "\x01 a\x01", "Σας ΟΔΟΣ.", "..,", "\r\n x\x85y"]
    texts += ["".join(r.choice(" \n\t ab'sé.,\x01\x1c1漢") for _ in range(r.randrange(30))) for _ in range(1500)] + [prose(k, 90) for k in range(30)]
    texts += ["".join(r.choice(["a", "word", "Éa", "e\u0301", " ", "\n", "\u2003", "\u200a", "'", "'s", "$$$", "_", "...", "²", "ǅ", "ß", "İ", "漢", "\u0345", "7"]) for _ in range(r.randrange(25))) for _ in range(2500)]
    library = Tokenizer.from_file(path)
    made = tokens.Encoder(path)
    for some in (texts[:700], texts[700:], texts[:20], []):
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        ids, starts = made.encode(some)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == want
        ids, starts = made.encode(some, 9)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [[*x, 9] for x in want]


def test_files_round_trip_and_open_only_what_is_asked_for(spark):
    rows = awkward()
    folder = common.shared_folder(spark)
    token_files.write_token_files(with_clashes(table(spark, rows)), folder, WORD_FILE, shard_tokens=500)
    read = common.staged(token_files.read_token_files(spark, folder))
    got = token_files.with_starts(read).orderBy("start").collect()
    library, start, want = Tokenizer.from_file(WORD_FILE), 0, []
    for i, t in sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), np.array(ids, "<u2").tobytes()))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == want
    assert len({(r.part, r.shard) for r in got}) > 1
    some = token_files.read_token_files(spark, folder, {4, 9}).collect()
    assert {r.doc_id: bytes(r.ids) for r in some} == {i: x for i, _, _, x in want if i in (4, 9)}
    crc = {(r.doc_id, r.local_start, r.n_tokens): r.ids_crc32 for r in token_files.digest(read).collect()}
    assert set(crc.values()) == {zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for *_, x in want}


def test_file_is_a_seekable_zstandard_stream_and_guards_itself():
    import zstandard

    ids = [np.arange(k, dtype="<u2").tobytes() for k in (1, 0, 700)]
    data = token_files.pack_file([3, None, 5], ids) + token_files.LAST_BYTES.encode()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).readall()
    assert plain.startswith(b"".join(ids))
    assert [(d, s, x) for _, d, s, x in token_files.unpack_file(data)] == [(3, 0, ids[0]), (None, 1, ids[1]), (5, 1, ids[2])]
    with pytest.raises(ValueError):
        list(token_files.unpack_file(data[:-1]))
    broken = bytearray(data)
    at = data.index(zstandard.ZstdCompressor(level=3, write_checksum=False).compress(ids[2]))
    broken[at + 20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.unpack_file(bytes(broken)))


def test_empty_table_gives_no_documents(spark):
    folder = common.shared_folder(spark)
    token_files.write_token_files(table(spark, []), folder, WORD_FILE)
    assert token_files.read_token_files(spark, folder).count() == 0


# -- packing ----------------------------------------------------------------


def test_fullest_combination_is_the_best_of_all():
    r = random.Random(6)
    for _ in range(200):
        counts = {r.randrange(1, 15): r.randrange(1, 4) for _ in range(r.randrange(1, 5))}
        room = r.randrange(0, 40)
        sums = {sum(a * b for a, b in zip(counts, k, strict=True)) for k in itertools.product(*[range(c + 1) for c in counts.values()])}
        taken = packing.fullest(counts, room)
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in taken.items())


def test_plan_places_every_piece_once():
    histogram = {n: random.Random(n).randrange(0, 40) for n in range(1, 101)}
    plan = packing.plan_bins(histogram, 100)
    used = collections.Counter()
    for bin_, times in plan:
        assert sum(n * k for n, k in bin_.items()) <= 100
        used.update({n: k * times for n, k in bin_.items()})
    assert used == {n: c for n, c in histogram.items() if c}
    rooms: list[int] = []  # first fit decreasing
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        at = next((k for k, room in enumerate(rooms) if room >= n), len(rooms))
        rooms[at : at + 1] = [(rooms[at] if at < len(rooms) else 100) - n]
    assert sum(t for _, t in plan) <= len(rooms)
    with pytest.raises(ValueError):
        packing.plan_bins({101: 1}, 100)


def test_packing_is_whole_and_gapless(spark):
    rows = awkward() + [(100 + k, prose(k, 10 + 13 * k), "en", "a", 1) for k in range(30)]
    got = packing.pack(with_clashes(table(spark, rows)), BYTE_FILE, capacity=64).collect()
    library = Tokenizer.from_file(BYTE_FILE)
    want = []
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 64 or 64
        edges = [0, *range(first, len(ids), 64), len(ids)]
        want += [(-1 if i is None else i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-sum(w[3] for w in want) // 64) + 1
    assert packing.pack(table(spark, []), BYTE_FILE).count() == 0


# -- line dedup -------------------------------------------------------------


def brute_lines(rows: list, min_docs: int, min_chars: int = 1) -> list:
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    docs = collections.defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add((i, t))
    hot = {k for k, v in docs.items() if len(k) >= min_chars and len(v) >= min_docs}
    return [(i, n := len((t or "").split("\n")), n - len(kept := [x for x in (t or "").split("\n") if key(x) not in hot]), "\n".join(kept)) for i, t, *_ in rows]


@pytest.mark.parametrize(("batches", "min_chars"), [(1, 1), (5, 1), (3, 6)])
def test_line_dedup(spark, batches, min_chars):
    rows = awkward() + [(100 + k, f"{prose(k, 5)}\n  Common Line\t\n{'SHORT' if k % 2 else 'short'}\nünï", "en", "a", 1) for k in range(12)]
    got = line_dedup.dedup_lines(with_clashes(table(spark, rows)), min_docs=10, min_chars=min_chars, batches=batches)
    assert {"c0", "key", "drop", "t"} <= set(got.columns)
    want = sorted((-1 if i is None else i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows, 10, min_chars))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()) == want
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_repeated_rows_are_one_document(spark):
    shared = lambda k, x: f"{x} line\n{prose(k, 5)}"
    rows = [(k, shared(k, "five"), "en", "a", 1) for k in range(5)] * 2  # five documents, each twice
    rows += [(20 + k, shared(60 + n, "same id"), "en", "a", 1) for n, k in enumerate([*range(5)] * 2)]  # two texts for each id
    rows += [(None, shared(80 + k, "no id"), "en", "a", 1) for k in range(5)] * 2
    rows += [(40 + k, shared(40 + k, "ten"), "en", "a", 1) for k in range(10)]
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.n_dropped for r in got if r.doc_id is None or r.doc_id < 40} == {0}
    assert {r.n_dropped for r in got if r.doc_id is not None and r.doc_id >= 40} == {1}


def test_runs_are_compacted_and_anti_joined(spark):
    runs = line_dedup.LineRuns(spark, common.shared_folder(spark), 2, fanout=2)
    batch = lambda ks: spark.createDataFrame([(k.encode(),) for k in ks], "key binary")
    for ks in ("ab", "bc", "cd", "bd", "e", "bbbf", "a"):
        runs.add(batch(ks))
    assert [len(x) for x in runs.levels] == [1, 1, 1]
    assert sorted(bytes(r.key) for r in runs.common_keys().collect()) == [b"a", b"b", b"c", b"d"]
    assert {bytes(r.key) for r in runs.new_lines(batch("abexyy")).collect()} == {b"e", b"x", b"y"}
    # The lines of a key that has reached the limit are not counted again.
    assert {bytes(r.key): r.n for r in runs._sums([p for x in runs.levels for p in x]).collect()} == {b"a": 2, b"b": 2, b"c": 2, b"d": 2, b"e": 1, b"f": 1}
    plan = runs.new_lines(batch("ab"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


# -- Jaccard join -----------------------------------------------------------


def brute_components(rows: list, words: int, percent: int) -> list:
    def shingles(t):
        w = WORD.findall(lower(t or ""))
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(b)] = find(a)
    names = collections.defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            names[find(k)].append(i)
    return sorted(((-1 if i is None else i), len(sets[k]), min(names[find(k)], default=-1) if sets[k] else (-1 if i is None else i)) for k, (i, *_) in enumerate(rows))


def edited(seed: int, base: list[str], times: int) -> str:
    r = random.Random(seed)
    w = list(base)
    for _ in range(times):
        w.insert(r.randrange(len(w)), f"new{r.randrange(10**6)}")
    return " ".join(w)


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components_lose_no_link(spark, words, percent):
    base = prose(77, 120).split()
    passage = prose(78, 60)
    rows = awkward() + [(200 + k, edited(k, base, k % 8), "en", "a", 1) for k in range(60)] + [(300 + k, prose(500 + k, 30) + " " + passage, "en", "a", 1) for k in range(30)]
    rows += [(400 + k, edited(1000 + k, prose(40 + k // 3, 70).split(), k % 3), "en", "a", 1) for k in range(30)] + [(500 + k, ["a", "a b", "a b c", "A b"][k % 4], "en", "a", 1) for k in range(8)]
    got = jaccard.jaccard_components(with_clashes(table(spark, rows)), words, percent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute_components(rows, words, percent)


@pytest.mark.parametrize("percent", [60, 80])
def test_near_copies_around_the_threshold_lose_no_link(spark, percent):
    """Copies whose edits leave many of them apart: hubs and marks decide, no link may go."""
    rows = []
    for k in range(120):
        r = random.Random(k)
        w = prose(90 + k % 2, 130).split()
        for _ in range(k % 13):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((k, " ".join(w), "en", "a", 1))
    got = jaccard.jaccard_components(table(spark, rows), 5, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 5, percent)
    if percent == 80:
        assert 2 < len({r.component_id for r in got}) < 120


def test_marks_differ_in_no_more_bits_than_their_sets_in_tokens():
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 63, 900, dtype=np.uint64)
    for _ in range(200):
        a, b = (np.unique(r.choice(pool, r.integers(1, 700))) for _ in range(2))
        bits = sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(jaccard.mark(a), jaccard.mark(b), strict=True))
        assert bits <= len(np.setxor1d(a, b))
    assert jaccard.mark(pool) == jaccard.mark(pool[::-1])


def test_rows_of_very_many_chunks_have_numbers_of_their_own():
    a, b = jaccard.row_numbers(1 << 40, 3), jaccard.row_numbers((1 << 40) + 1, 3)
    assert a.dtype == np.int64 and (a > 0).all() and len({*a.tolist(), *b.tolist()}) == 6
    last = ((1 << 24) - 1 << language_model.CHUNK_BITS) + (1 << language_model.CHUNK_BITS) - 1
    assert jaccard.row_numbers(last, 1 << language_model.PLACE_BITS).max() == (1 << 63) - 1


def test_components_of_random_graphs(spark):
    r = random.Random(9)
    edges = [(a, a + 1) for a in range(0, 40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(45)]
    got = {x.node: x.root for x in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root: dict[int, int] = {}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    for n in nodes:
        root[n] = n
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert {n: got.get(n, n) for n in nodes} == root


def test_one_of_each_group_stays(spark):
    base = prose(5, 100).split()
    rows = awkward() + [(50 + k, edited(k, base, k % 2), "en", "a", 1) for k in range(10)]
    kept = jaccard.keep_one(table(spark, rows))
    names = {c for i, _, c in brute_components(rows, 5, 80) if i == c}
    own = ["_row_hash", "h", "i", "t", "c1", "component_id", "r", "id"]
    clashing = table(spark, rows).select("*", *[F.lit(111 + k).alias(c) for k, c in enumerate(own)])
    same = jaccard.keep_one(clashing)
    assert same.columns == clashing.columns
    got = same.collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == sorted(names) and {tuple(r[c] for c in own) for r in got} == {tuple(range(111, 119))}
    assert kept.columns == table(spark, []).columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(names)
    assert jaccard.keep_one(table(spark, [])).count() == 0


def test_one_row_stays_without_ids_and_with_an_id_on_two_texts(spark):
    near = lambda seed: [(t := prose(seed, 100)), t + " end", "begin " + t]
    rows = [(None, t, "en", "a", 1) for t in near(91)[:2]] + [(None, t, "de", "b", 1) for t in near(92)[:2]]
    rows += [(i, t, "en", "a", 1) for i, t in zip((None, 7, None), near(93), strict=True)]
    rows += [(8, near(94)[0], "en", "a", 1), (5, near(94)[1], "en", "a", 1), (8, near(95)[0], "en", "a", 1), (None, "", "en", "a", 0), (None, " ", "en", "a", 1)]
    kept = jaccard.keep_one(table(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept) == [-1, -1, -1, -1, 5, 7, 8]
    texts = {r.text for r in kept}
    assert near(95)[0] in texts and near(94)[0] not in texts and {"", " "} < texts
    assert len(texts & {*near(91)}) == len(texts & {*near(92)}) == 1


# -- decontamination --------------------------------------------------------


def brute_distance(p: str, t: str) -> tuple[int, int]:
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row[1:]), row[1:].index(min(row[1:]))


def test_bit_parallel_distance():
    r = random.Random(3)
    for _ in range(800):
        p, t = ("".join(r.choice("abc ") for _ in range(r.randrange(1, n))) for n in (12, 30))
        for budget in (0, 1, 3, 12):
            want = brute_distance(p, t)
            assert decontamination.best_distance(p, t, budget) == (want if want[0] <= budget else None)


def test_every_item_within_its_budget_is_found(spark):
    r = random.Random(8)
    items = [(k, prose(900 + k, 25)) for k in range(12)] + [(50, "house paper"), (51, None), (None, "light water street"), (52, ""), (0, prose(900, 25))]

    def damaged(text: str, n: int) -> str:
        out = list(text)
        for _ in range(n):
            out[r.randrange(len(out))] = r.choice("xyzq")
        return "".join(out)

    rows = awkward() + [(100 + k, f"{prose(k, 40)} {damaged(items[k % 12][1], k // 4).upper()}\n{prose(k + 300, 20)}", "en", "a", 1) for k in range(48)] + [(200, "A  HOUSE\npaper", "en", "a", 1), (201, "housepaper lighthouse papers", "en", "a", 1), (202, "The house paper, and (Light water street).", "en", "a", 1)]
    rows += [(203, f"{prose(31, 20)} {items[2][1].replace(items[2][1].split(' ')[8], 'parliament', 1)} end", "en", "a", 1)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_matches(with_clashes(table(spark, rows)), bench, block_chars=900).collect()
    want = []
    for i, t, *_ in rows:
        text = decontamination.plain(t or "")
        for n, x in sorted({(n, x) for n, x in items if x}, key=str):
            p = decontamination.plain(x)
            budget = decontamination.edit_budget(p)
            if budget:
                padded, edges, best = f" {text} ", decontamination.piece_edges(p), []
                for a, b in itertools.pairwise(edges):
                    for at in (m.start() - a for m in re.finditer(f"(?={re.escape(p[a:b])})", padded)):
                        best.append(brute_distance(p, padded[max(0, at - budget) : at + len(p) + budget])[0])
                if best and min(best) <= budget:
                    want.append((i, n, min(best)))
                assert brute_distance(p, padded)[0] > int(decontamination.SURE_RATE * len(p)) or (i, n, brute_distance(p, padded)[0]) in want
            elif re.search(rf"(?<![^\W_]){re.escape(p)}(?![^\W_])", text):
                want.append((i, n, 0))
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=str) == sorted(want, key=str)
    assert (203, 2) in {(i, n) for i, n, _ in want}
    assert {i for i, n, _ in want if n == 50} >= {200, 202} and 201 not in {i for i, *_ in want}
    clean = decontamination.decontaminate(table(spark, rows), bench, block_chars=900)
    dirty = {i for i, *_ in want}
    assert sorted((r.doc_id or -1) for r in clean.collect()) == sorted((i or -1) for i, *_ in rows if i not in dirty)
    assert decontamination.find_matches(table(spark, []), bench).count() == 0
    assert decontamination.decontaminate(table(spark, rows), bench.limit(0)).count() == len(rows)


def test_edits_in_every_piece_hide_no_item():
    r = random.Random(5)
    for k in range(60):
        item = decontamination.plain(prose(700 + k, 6 + k % 20))
        budget = decontamination.edit_budget(item)
        held = list(item)
        for e in range(budget):  # spread evenly, as replaced, left out or added characters
            at = (2 * e + 1) * len(held) // (2 * budget)
            held[at] = ["#", "", held[at] + "#"][r.randrange(3 if k % 2 else 1)]
        text = f"{prose(k, 30)} {''.join(held)} {prose(k + 50, 30)}"
        want = brute_distance(item, f" {decontamination.plain(text)} ")[0]
        assert 0 < want <= budget
        assert [(m.item, m.distance) for m in decontamination.Items([(k, item), (-1, prose(2000 + k, 20))]).matches(text)] == [(k, want)]


# -- pipeline ---------------------------------------------------------------


def test_pipeline_is_its_stages_one_after_the_other(spark, sf):
    docs = common.documents(spark, sf)
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
        docs = common.staged(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
        ids = {i for i, *_ in before}
        if name == "quality_classifier":
            good = quality_classifier.quality_scores(common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1")
            assert set(texts[name]) == {r.doc_id for r in good.collect()}
        elif name == "line_dedup":
            assert texts[name] == {i: t for i, _, _, t in brute_lines(before, 10)}
        elif name == "ngram_jaccard_join":
            assert set(texts[name]) == {i for i, _, c in brute_components(before, 5, 80) if i == c} <= ids
        else:
            items = [decontamination.plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            exact = {i for i, t, *_ in before if any(p in decontamination.plain(t) for p in items)}
            assert set(texts[name]).isdisjoint(exact) and len(ids) - len(texts[name]) <= len(exact) + 2
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == set(texts["benchmark_decontamination"])
