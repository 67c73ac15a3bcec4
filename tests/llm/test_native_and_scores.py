"""License scan, language model, toxicity, quality classifier and quality rules against plain Python."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from paceframe.llm import language_model, license_rules, licenses, quality_classifier, quality_rules, toxicity
from tests.llm.helpers import awkward, prose, table, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# -- licences ---------------------------------------------------------------


def test_suppression_is_that_of_all_pairs():
    r = random.Random(5)
    for _ in range(300):
        spans = [(r.randrange(3), a := r.randrange(12), a + r.randrange(1, 6)) for _ in range(r.randrange(1, 14))]
        order = sorted(range(len(spans)), key=lambda i: (-spans[i][0], spans[i][1] - spans[i][2], spans[i][1], i))
        kept: list[int] = []
        for i in order:
            if not any(spans[k][1] <= spans[i][1] and spans[k][2] >= spans[i][2] for k in kept):
                kept.append(i)
        assert licenses.suppressed(spans) == [i not in kept for i in range(len(spans))]


def test_prefilter_loses_no_detection():
    rules = license_rules.build_rules()
    assert len(rules) > 400
    scanner = licenses.Scanner(rules)
    texts = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3 or any later version.", "SPDX-License-Identifier: GPL-2.0-or-later", "Copyright (c) 2020. All rights reserved.", "nothing"]
    texts += ["GNU GPL v2; the LGPL 2.1, AGPL-3.0. GFDL 1.3", "Open Data Commons Public Domain Dedication and License 1.0; BSD-3-Clause; Zope Public License 2.1; Creative Commons Attribution-ShareAlike 4.0 International"]
    for text in texts:
        joined = " ".join(licenses.WORD.findall(lower(text)))
        every = sorted((r.name, m.start()) for r in rules for m in r.pattern.finditer(joined))
        _, found = scanner.scan(text)
        assert sorted(d[0] for d in found) == sorted(n for n, _ in every)
    labels = [{d[1] for d in scanner.scan(t)[1] if d[4] or not d[7]} for t in texts]
    assert labels[0] == {"apache-2"} and labels[1] == {"mit"} and "gpl-3-or-later" in labels[3] and labels[4] == {"gpl-2-or-later"} and labels[6] == set()


def test_words_hold_blanks_that_are_not_ascii():
    scanner = licenses.Scanner(license_rules.build_rules())
    for blank in "\u00a0\u2003\u3000\u0085":
        assert scanner.scan(f"the mit license{blank}foo") == (3, []) == scanner.scan(f"x{blank}the mit license{blank}y")
        n, found = scanner.scan(f"foo{blank}bar the mit license x{blank}y")
        assert n == 5 and [(d[1], d[5], d[6]) for d in found if d[4]] == [("mit", 1, 3)]


def test_license_query_on_awkward_rows(spark, tmp_path):
    rows = [*awkward(), (20, "The MIT license. the-mit-license! Apache License, Version 2", "en", "a", 1)]
    got = licenses.scan_licenses(with_clashes(table(spark, rows))).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r.doc_id == 20)
    base = [(d.label, d.first_word) for d in one.detections if d.base]
    assert sorted(base) == [("apache-2", 6), ("mit", 0), ("mit", 3)] and 0 < one.score <= 1
    assert {r.n_words for r in got if r.doc_id in (0, 1, 2)} == {0} and all(r.score == 0 for r in got if r.doc_id != 20)
    assert licenses.scan_licenses(table(spark, [])).count() == 0


# -- language model ---------------------------------------------------------


def test_filter_has_no_false_negative_and_few_false_positives():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    counts = r.geometric(0.3, len(keys)).astype(np.int64)
    made = language_model.LogFrequencyFilter(keys[:10_000], counts[:10_000])
    want = 1 + np.floor(np.log2(counts[:10_000])).astype(int)
    got = made.levels(keys[:10_000])
    assert (got >= want).all() and (got > want).mean() < 0.02
    assert (made.levels(keys[10_000:]) > 0).mean() < 0.02
    assert language_model.expected_count(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]


def test_language_model_is_the_formula(spark):
    rows = awkward() + [(100 + k, prose(k % 9, 50), "en", "a", 1) for k in range(40)]
    got = language_model.language_scores(with_clashes(table(spark, rows)).coalesce(1)).collect()  # one chunk
    assert len(got) == len(rows)
    tokens = [([*WORD.findall(lower(t or "")), "\n"], i) for i, t, *_ in rows]
    train = [w for w, i in tokens if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for w in train for p in zip(["\n", *w], w, strict=False))
    after = collections.Counter(a for a, _ in pairs)

    def score(w: list[str]) -> float:
        total = 0.0
        for a, b in zip(["\n", *w], w, strict=False):
            level = math.floor(math.log2(pairs[a, b])) + 1 if pairs[a, b] else 0
            share = (c[b] + 1) / (n + v + 1)
            seen = min(float(language_model.expected_count(np.array([level]))[0]), c[a])
            total += math.log10((seen + after[a] * share) / (c[a] + after[a]) if c[a] else share)
        return total

    want = sorted((-1 if i is None else i, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for w, i in tokens)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    close = {i: score(w) for w, i in tokens}
    # False positives of the filter only move single tokens.
    assert np.mean([abs(r.score - close[r.doc_id]) / r.n_tokens for r in got]) < 0.05
    assert language_model.language_scores(table(spark, [])).count() == 0


def test_language_model_does_not_depend_on_chunks(spark):
    rows = awkward() + [(100 + k, prose(k % 9, 50), "en", "a", 1) for k in range(40)]
    scores = lambda parts: sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in language_model.language_scores(table(spark, rows).repartition(parts)).collect())
    assert scores(1) == scores(7)


def test_words_are_summed_over_chunks_in_packed_segments():
    r = np.random.default_rng(4)
    chunks = [np.unique(r.integers(0, 60, n, np.uint64) << np.uint64(50)) for n in (30, 1, 80)]
    c, t = ([r.integers(0, 3, len(w)).astype("<u4") for w in chunks] for _ in range(2))
    pack = lambda parts: pa.array([language_model._squeezed(x) for x in parts], pa.binary())
    made = pa.table({"segment": [5] * 3, "chunk": [7, 8, 9], "words": pack([np.diff(w, prepend=np.uint64(0)) for w in chunks]), "c": pack(c), "t": pack(t)})
    got = language_model.word_totals(made).to_pylist()
    for name, parts in (("c", c), ("t", t)):
        want = collections.Counter()
        for w, x in zip(chunks, parts, strict=True):
            want.update(dict(zip(w.tolist(), x.tolist(), strict=True)))
        assert [language_model._opened(row[name], "<u8").tolist() for row in got] == [[want[x] for x in w.tolist()] for w in chunks]
        if name == "c":
            assert [row["known"] for row in got] == [sum(n > 0 for n in want.values()), 0, 0]
    assert [(row["chunk"], row["segment"]) for row in got] == [(7, 5), (8, 5), (9, 5)]


def test_scores_are_finite_where_shortened_keys_merge(spark, monkeypatch):
    monkeypatch.setattr(language_model, "key_shift", lambda total: 52)
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    rows = [(k, " ".join(f"x{i} {'z' if k == held else 'y'}{i}" for i in range(300)), "en", "a", 1) for k in (held, held + 1)]
    got = language_model.language_scores(table(spark, rows)).collect()
    assert [r.held_out for r in sorted(got)] == [True, False] and all(math.isfinite(r.score) for r in got)
    assert all(r.score >= r.base_score - math.log10(2) - 1e-9 for r in got)


def test_scores_stay_near_the_base_where_word_order_is_unseen(spark):
    words = "p q r s t u v w".split()
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = [(k, " ".join((words[::-1] if k in held else words) * 20), "en", "a", 1) for k in range(200)]
    got = language_model.language_scores(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in got if r.held_out) == held
    assert all(r.score >= r.base_score - math.log10(2) - 1e-9 for r in got) and all(r.score > r.base_score / 2 for r in got if not r.held_out)


# -- toxicity ---------------------------------------------------------------


def test_composition_reads_as_the_parts_in_turn():
    parts = [toxicity._within({toxicity.NEGATION}, 3, {toxicity.INSULT: (toxicity.OTHER, 0.4, 0.0)}), toxicity._within({toxicity.TARGET}, 4, {toxicity.INSULT: (toxicity.INSULT, 1.3, 0.1)}), toxicity._within({toxicity.REPORT}, 0, {toxicity.INSULT: (toxicity.INSULT, 0.5, 0.0)})]
    whole = parts[0].then(parts[1]).then(parts[2])
    r = random.Random(2)
    for _ in range(200):
        state, states = 0, [0, 0, 0]
        for _ in range(15):
            symbol = r.choice(list(toxicity.SYMBOLS))
            state, out, f, w = whole.step[state][symbol]
            f2, w2 = 1.0, 0.0
            for k, p in enumerate(parts):
                states[k], symbol, x, y = p.step[states[k]][symbol]
                f2, w2 = f2 * x, w2 + y
            assert out == symbol and abs(f - f2) < 1e-12 and abs(w - w2) < 1e-12


def test_clauses_weigh_aim_negation_and_report():
    score = lambda t: toxicity.ClauseScorer(toxicity.seed_lexicon()).evidence(t)[1]
    plain, aimed, negated, told = score("an idiot"), score("you idiot"), score("not an idiot"), score("she said an idiot")
    assert aimed > plain > negated and told < score("she is an idiot") and score("a kind person") == 0
    assert score("I will kill you") > score("I will not kill you")


def test_toxicity_learns_from_labels(spark):
    rows = [(k, prose(k, 60) + (" you stupid idiot" if k % 5 == 0 else " blorptic fellow" if k % 5 == 1 else ""), "en", "a", 1) for k in range(400)] + [(1000, "", "en", "a", 0), (None, None, None, None, None)]
    labels = spark.createDataFrame([(k, int(k % 5 < 2)) for k in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(with_clashes(table(spark, rows)), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id % 5 < 2) for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    none = labels.limit(0)
    assert toxicity.toxicity_scores(table(spark, rows), none).count() == len(rows)
    assert toxicity.toxicity_scores(table(spark, []), none).count() == 0


# -- quality ----------------------------------------------------------------


def test_additive_model_is_a_sum_of_table_entries():
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)  # needs the interaction
    model = quality_classifier.fit(x, y)
    got = model.score(x)
    assert ((got >= 0.5) == y).mean() > 0.9
    for row, g in zip(x[:50], got, strict=False):
        total = model.intercept + sum(t[np.searchsorted(e, row[k], side="right")] for k, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
        total += sum(t[np.searchsorted(model.pair_edges[i], row[i], side="right"), np.searchsorted(model.pair_edges[j], row[j], side="right")] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(1 / (1 + math.exp(-total)) - g) < 1e-9


def test_quality_classifier_on_held_out_rows(spark):
    rows = [(k, prose(k, 60) if k % 3 else " | ".join(prose(k, 60).split()), "en", "a", 1) for k in range(450)] + awkward()
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(20, 450)], "doc_id long, quality int")
    got = quality_classifier.quality_scores(with_clashes(table(spark, rows)), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 20]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.97
    kept = quality_classifier.keep_good(table(spark, rows), labels)
    assert kept.columns == table(spark, []).columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in quality_classifier.quality_scores(table(spark, rows[:3]), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(table(spark, []), labels).count() == 0


def brute_counts(text: str) -> tuple[int, ...]:
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_count_and_judge(spark):
    rows = awkward() + [(100 + k, prose(k, 80), "en", "a", 1) for k in range(120)] + [(300 + k, prose(k, 80).replace(" ", " ## "), "en", "a", 1) for k in range(4)]
    got = quality_rules.quality_rules(with_clashes(table(spark, rows))).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    for r in got:
        counts = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
    assert all(r.kept for r in got if r.doc_id is not None and 100 <= r.doc_id < 220)
    assert not any(r.kept for r in got if r.base_failed or r.doc_id is not None and r.doc_id >= 300)
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["a b c d e f g h " * 3, "x " * 20, "a b c d e f g h i a b c d e f g h", "a b c d e f g h"])
def test_repeated_windows(spark, text):
    got = quality_rules.measures(table(spark, [(1, text, "en", "a", 1)])).first()
    assert got.n_repeat_words == brute_counts(text)[4]
