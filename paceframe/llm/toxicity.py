"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes by a lexicon (insults with weights, threats, targets,
negations, reported speech). Small deterministic transducers, one for each
concern, are composed into one machine that reads a clause's classes and adds up
weights: an insult counts more when it is aimed at somebody, less when it is
negated or only reported; a threat counts when it is announced or aimed. Matched
clauses, not single words, give a document's evidence, and a logistic function
fitted on labelled documents turns it into a score. The lexicon is completed
from the labels: words that stand almost only in toxic documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import common

#: Labelled training documents (distinct texts) that are used at most.
TRAIN_ROWS = 60_000
#: What words learned from the labels must show. They are words of LEAST_DOCS training documents each, so TRAIN_ROWS bounds them.
LEAST_DOCS, LEAST_LOG_ODDS = 4, 2.0
FOLDS = 5

# The seed lexicon, by class.
INSULTS = "idiot idiots moron morons scum loser losers trash clown clowns stupid pathetic worthless disgusting imbecile dumb fool jerk idiota estúpido imbécil basura payaso idioten dummkopf abschaum versager widerlich crétin ordure minable dégoûtant"
THREATS = "kill hurt destroy beat punch shoot stab burn töten schlagen vernichten matar golpear destruir tuer frapper détruire"
FUTURE = "will shall going gonna ll werde wird werden voy vamos va vais"
TARGETS = "you your yourself he she they them him her u du dich ihr euch sie tú usted ustedes te toi vous tu il elle"
NEGATIONS = "not no never isn't aren't wasn't nicht kein keine nie no nunca jamás pas jamais ne"
REPORTS = "said says say called calls quoted wrote reported claimed alleged sagte schrieb nannte dijo escribió llamó dit écrit appelé"

# Symbols that transducers read.
OTHER, INSULT, THREAT, COMING, TARGET, NEGATION, REPORT = range(7)
SYMBOLS = range(7)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")
_BREAKS = frozenset(".!?;:\n")


@dataclass
class Transducer:
    """Deterministic, weighted: ``step[state][symbol]`` gives (next state, symbol out, factor, bonus).

    The factor multiplies the weight that a word carries; the bonus is added.
    """

    step: list[list[tuple[int, int, float, float]]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out, the other reads."""
        states: dict[tuple[int, int], int] = {(0, 0): 0}
        todo, table = [(0, 0)], []
        while len(table) < len(todo):
            a, b = todo[len(table)]
            row = []
            for symbol in SYMBOLS:
                a2, out, f, w = self.step[a][symbol]
                b2, out2, f2, w2 = other.step[b][out]
                if (a2, b2) not in states:
                    states[a2, b2] = len(todo)
                    todo.append((a2, b2))
                row.append((states[a2, b2], out2, f * f2, w + w2))
            table.append(row)
        return Transducer(table)


def _within(opens: set[int], reach: int, change: dict[int, tuple[int, float, float]]) -> Transducer:
    """``change`` (symbol: symbol out, factor, bonus) holds for ``reach`` tokens after one of ``opens``; reach 0: to the clause's end."""
    states = max(1, reach) + 1  # state k > 0: k tokens are left
    table = []
    for state in range(states):
        row = []
        for symbol in SYMBOLS:
            out, f, w = change.get(symbol, (symbol, 1.0, 0.0)) if state else (symbol, 1.0, 0.0)
            left = state if reach == 0 else max(0, state - 1)
            row.append((states - 1 if symbol in opens else left, out, f, w))
        table.append(row)
    return Transducer(table)


def grammar() -> Transducer:
    """Negation, reported speech, aim and threat, composed in this order."""
    negation = _within({NEGATION}, 3, {INSULT: (INSULT, 0.4, 0.0), THREAT: (OTHER, 0.0, 0.0)})
    reported = _within({REPORT}, 0, {INSULT: (INSULT, 0.5, 0.0), THREAT: (THREAT, 0.5, 0.0)})
    aimed = _within({TARGET}, 4, {INSULT: (INSULT, 1.3, 0.0)})
    answered = _within({INSULT}, 3, {TARGET: (TARGET, 1.0, 0.2)})
    piled = _within({INSULT}, 5, {INSULT: (INSULT, 1.2, 0.1)})
    announced = _within({COMING}, 3, {THREAT: (THREAT, 2.0, 0.2)})
    at_somebody = _within({THREAT}, 3, {TARGET: (TARGET, 1.0, 0.3)})
    machine = negation
    for part in (reported, aimed, answered, piled, announced, at_somebody):
        machine = machine.then(part)
    return machine


def seed_lexicon() -> dict[str, tuple[int, float]]:
    out = {}
    for words, symbol, weight in ((TARGETS, TARGET, 0.0), (FUTURE, COMING, 0.0), (REPORTS, REPORT, 0.0), (NEGATIONS, NEGATION, 0.0), (THREATS, THREAT, 0.3), (INSULTS, INSULT, 1.0)):
        out.update({w: (symbol, weight) for w in words.split()})
    return out


@dataclass
class ClauseScorer:
    """Reads texts with a lexicon and a machine."""

    lexicon: dict[str, tuple[int, float]]
    machine: Transducer = field(default_factory=grammar)

    def __post_init__(self):
        self.triggers = frozenset(w for w, (s, _) in self.lexicon.items() if s in (INSULT, THREAT))

    def clause(self, tokens: list[str]) -> float:
        """The weight of one clause."""
        state, total = 0, 0.0
        for t in tokens:
            symbol, weight = self.lexicon.get(t, (OTHER, 0.0))
            state, _, f, bonus = self.machine.step[state][symbol]
            total += weight * f + bonus
        return total

    def evidence(self, text: str) -> tuple[float, ...]:
        """Summed clause weight, best clause, matched clauses, distinct triggers and triggers by length of a whole text."""
        tokens = _TOKEN.findall(text.lower())
        found = self.triggers.intersection(tokens)
        if not found:
            return (0.0, 0.0, 0.0, 0.0, 0.0)
        weights, clause, hit, hits = [], [], False, 0
        for t in [*tokens, "."]:
            if t in _BREAKS:
                if hit:
                    weights.append(self.clause(clause))
                clause, hit = [], False
            else:
                clause.append(t)
                if t in found:
                    hit = True
                    hits += 1
        weights = weights or [0.0]
        return (float(np.log1p(sum(weights))), max(weights), float(np.log1p(len(weights))), float(np.log1p(len(found))), float(np.log1p(1000 * hits / len(tokens))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression by Newton's steps."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_ids(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """id, text hash and label of at most ``TRAIN_ROWS`` labelled documents outside fold 0, one for each distinct text."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    rows = docs.where(common.bucket("id", FOLDS) != 0).select("id", F.xxhash64("text").alias("t")).join(known, "id")
    return rows.groupBy("t").agg(F.min(F.struct("id", "label")).alias("r")).select("t", "r.id", "r.label").orderBy("t").limit(TRAIN_ROWS)


def learned_lexicon(chosen: DataFrame) -> dict[str, float]:
    """Weights of words that labelled documents (text, label) show to be toxic: smoothed log odds over the share of documents."""

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                distinct = set(_TOKEN.findall(text.as_py().lower())) - _BREAKS
                out[0].extend(distinct)
                out[1].extend([label] * len(distinct))
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], names=["word", "label"])

    sizes = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = chosen.select("label", "text").mapInArrow(words, "word string, label int").groupBy("word").agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    odds = F.log((F.col("a") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("n") - F.col("a") + 0.5) / F.lit(clean + 1.0))
    kept = counts.where(F.col("a") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS)
    return {r["word"]: r["odds"] / 5.0 for r in kept.collect()}


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the clause evidence of every row.

    Null and empty texts have no clause and get the score of one without a match;
    a null id is in no training row; repeated rows are scored each; other columns
    are left out. Without labels the seed lexicon and fixed weights decide; an
    empty table gives no rows.
    """
    base = common.id_and_text(docs, id_col, text_col)
    ids = common.staged(training_ids(base, labels))
    # Bounded by TRAIN_ROWS: ids and labels only.
    chosen = common.staged(base.join(F.broadcast(ids.select("id", "label", "t")), "id").where(F.xxhash64("text") == F.col("t")).dropDuplicates(["id"]).select("id", "label", "text"))
    lexicon = seed_lexicon()
    learned = learned_lexicon(chosen)
    seeds = {w for w, (s, _) in lexicon.items() if s in (INSULT, THREAT)}
    lexicon.update({w: (INSULT, weight) for w, weight in learned.items() if w not in lexicon or w in seeds})
    names = ["clause_sum", "clause_best", "clauses", "distinct_hits", "hit_rate"]
    shape = ", ".join(f"{n} double" for n in names)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ClauseScorer(lexicon)
        for some, texts in common.steps(batches):
            table = np.array([scorer.evidence(t) for t in texts], dtype=np.float64)
            yield pa.record_batch([pa.array(some, pa.int64()), *(pa.array(table[:, k]) for k in range(len(names)))], names=["id", *names])

    train = chosen.select("id", "text").mapInArrow(read, f"id long, {shape}").join(ids.select("id", "label"), "id").select("label", *names).toPandas()  # TRAIN_ROWS at most
    y = train["label"].to_numpy(np.float64)
    weights = fit_logistic(train[names].to_numpy(np.float64), y) if len(y) and y.min() < y.max() else np.array([1.0, 1.0, 0.0, 1.0, 0.0, -3.0])
    logit = F.lit(float(weights[-1]))
    for n, w in zip(names, weights, strict=False):
        logit = logit + F.col(n) * F.lit(float(w))
    scored = base.mapInArrow(read, f"id long, {shape}").withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select(F.col("id").alias("doc_id"), (common.bucket("id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *names)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
