"""Small tables with the awkward cases that every operator must handle."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = "the of and to alpha beta gamma delta river stone cloud house paper light water street music garden window letter market summer forest bridge".split()


def prose(seed: int, n: int) -> str:
    """Sentences of known words and numbered ones, so that texts differ."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        out.append(r.choice(WORDS) if r.random() < 0.6 else f"w{r.randrange(10**6)}x")
        if k % 12 == 11:
            out[-1] += "." if r.random() < 0.5 else ".\n"
    return " ".join(out).replace("\n ", "\n")


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank, very long and repeated texts, a repeated row, a null id."""
    long = "\n".join(prose(7 + k, 60) for k in range(150))
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, "  \n\t ", "en", "a", 5), (3, "One", None, "a", 3), (4, prose(1, 80), "en", None, 1), (5, prose(1, 80), "en", "a", 1), (6, prose(2, 80), "de", "b", 1),
        (6, prose(2, 80), "de", "b", 1), (None, prose(3, 80), "de", "b", 1), (7, long, "en", "a", len(long)), (8, prose(2, 80) + " extra words here", "de", "b", 1), (9, "Ünïcode   wörds 漢字 🙂 ÀÉ", "fr", "c", 1),
        (10, "same line\n" * 30, "en", "a", 1), (11, "ab " * 300, "en", "a", 1),
    ]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


def with_clashes(df):
    """Columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["id", "t", "key", "row", "node", "score", "drop", "batch", "words", "lines", "n_words", "part", "rank", "length", "sig", "tokens", "label", "salt", "c0"]
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
