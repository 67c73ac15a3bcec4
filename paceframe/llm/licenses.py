"""Licence scan: ordered signature rules behind a keyword prefilter, with containment suppression.

One pass of an Aho-Corasick automaton over a document's words finds the keywords
it has; only rules whose keywords all occur are tried. A detection inside another
of higher priority (or of the same, if longer or earlier) is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import common
from paceframe.llm.license_rules import Rule, build_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_DETECTION = pa.struct([("rule", pa.string()), ("label", pa.string()), ("priority", pa.int32()), ("weight", pa.float64()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("suppressed", pa.bool_())])
_DETECTION_SQL = "struct<rule: string, label: string, priority: int, weight: double, base: boolean, first_word: long, last_word: long, suppressed: boolean>"


def suppressed(spans: list[tuple[int, int, int]]) -> list[bool]:
    """Which of (priority, start, end) lie inside one that goes before: higher priority, then longer, then earlier.

    A prefix maximum over starts answers each question, so many detections cost
    n log n.
    """
    order = sorted(range(len(spans)), key=lambda i: (-spans[i][0], spans[i][1] - spans[i][2], spans[i][1], i))
    starts = sorted({s for _, s, _ in spans})
    rank = {s: k + 1 for k, s in enumerate(starts)}
    tree = [-1] * (len(starts) + 1)
    out = [False] * len(spans)
    for i in order:
        _, s, e = spans[i]
        k, furthest = rank[s], -1
        while k > 0:
            furthest = max(furthest, tree[k])
            k -= k & -k
        if furthest >= e:
            out[i] = True
            continue
        k = rank[s]
        while k < len(tree):
            tree[k] = max(tree[k], e)
            k += k & -k
    return out


class Scanner:
    """The rules with their automaton."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules = rules
        words = sorted({k for r in rules for k in r.keywords})
        self.bit = {w: 1 << i for i, w in enumerate(words)}
        self.needs = [sum(self.bit[k] for k in set(r.keywords)) for r in rules]
        self.automaton = ahocorasick.Automaton()
        for w in words:
            # Keywords begin a word; "licen" also begins its derived forms.
            self.automaton.add_word(f" {w}", self.bit[w])
        self.automaton.make_automaton()
        self.tried: dict[int, list[Rule]] = {}

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        """Number of words, and detections (as ``_DETECTION``) in order of place."""
        words = WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
        joined = " ".join(words)
        has = 0
        for _, bit in self.automaton.iter(f" {joined}"):
            has |= bit
        if not has:
            return len(words), []
        if has not in self.tried:
            if len(self.tried) > 10_000:
                self.tried.clear()
            self.tried[has] = [r for r, need in zip(self.rules, self.needs, strict=True) if need & has == need]
        found = [(r, m.start(), m.end()) for r in self.tried[has] for m in r.pattern.finditer(joined)]
        if not found:
            return len(words), []
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        gone = suppressed([(r.priority, s, e) for r, s, e in found])
        out = [(r.name, r.label, r.priority, r.weight, r.base, int(np.searchsorted(begins, s, side="right")) - 1, int(np.searchsorted(begins, e, side="left")) - 1, g) for (r, s, e), g in zip(found, gone, strict=True)]
        return len(words), sorted(out, key=lambda d: (d[5], -d[6], -d[2], d[0]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, detections and score of every row.

    A detection has its rule, label, priority, first and last word (from 0) and
    whether a better one suppresses it. The score is the chance that a surviving
    detection is right, taken as independent. Null and empty texts have no words
    and score 0; repeated rows are scanned each; other columns are left out; an
    empty table gives no rows.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(build_rules())
        keys = [f.name for f in _DETECTION]
        for ids, texts in common.steps(batches):
            counts, detections = zip(*map(scanner.scan, texts), strict=True)
            structs = [[dict(zip(keys, d, strict=True)) for d in some] for some in detections]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(structs, pa.list_(_DETECTION))], names=["doc_id", "n_words", "detections"])

    found = common.id_and_text(docs, id_col, text_col).mapInArrow(scan, f"doc_id long, n_words long, detections array<{_DETECTION_SQL}>")
    miss = F.aggregate(F.filter("detections", lambda d: ~d["suppressed"]), F.lit(1.0), lambda acc, d: acc * (1 - d["weight"]))
    return found.withColumn("score", 1 - miss)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base places and labels of every document."""
    found = scan_licenses(common.documents(spark, sf_dir))
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda kept: F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda d: d["label"]))), ",")
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["first_word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["first_word"])).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.filter("detections", lambda d: d["base"] | ~d["suppressed"])).alias("labels"),
        "score",
    )
