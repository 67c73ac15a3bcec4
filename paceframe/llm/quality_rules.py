"""Quality rules with thresholds that follow the data: quantile sketches per language and source.

DataFrame functions only. Each document is measured once; mergeable quantile
sketches of the measures are made per (language, source), per language and over
all documents, so a hot source only sends sketches through the shuffle. A
document's limits come from the finest group with enough documents: the quartiles
widened by ``SPREAD`` times their distance (or a measure's least distance). The
limits are joined back on salted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import common

WINDOW = 8
#: Times the distance of the quartiles that a measure may lie outside them.
SPREAD = 3.0
#: Documents that a group needs for limits of its own.
MIN_GROUP = 100
#: Ranks are off by at most one in this many.
ACCURACY = 2_000
SALTS = 16
#: Measures whose high values are bad, and the least distance of the quartiles that counts.
MEASURES = {"symbol_share": 0.01, "exclaim_share": 0.01, "upper_share": 0.05, "dup_line_share": 0.1, "repeat_share": 0.05}
_BLANKS = r"[\x20\x09-\x0D]+"


def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``hashes``: one for each start of a window."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        kept = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.array_sort(F.transform(kept, lambda k: F.get(s, k)["i"]))

    # let-bindings: an array of one element is transformed, so that its value is computed once
    at = F.get(F.transform(F.array(placed), starts), F.lit(0))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    return F.get(F.transform(F.array(at), covered), F.lit(0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of each whole text: words, code points in words, symbols, repeated lines, words in repeated windows, and shares of them."""
    text = F.col("text")
    d = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[source_col].cast("string").alias("source"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split(text, _BLANKS), ""))
    d = d.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windows = F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    d = d.withColumn("windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    d = d.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]").alias("n_symbols"),
        without(r"[A-Z]").alias("n_upper"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeated_words(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.withColumns({
        "symbol_share": share("n_symbols", "word_chars"),
        "exclaim_share": share("n_exclaim", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    })


def limits(measured: DataFrame) -> DataFrame:
    """The upper limit of each measure for every (language, source) that occurs; null is a group of its own."""
    sketches = {m: F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), ACCURACY).alias(m) for m in MEASURES}
    upper = lambda a, m: (F.get(F.col(f"{a}.{m}"), F.lit(1)) + SPREAD * F.greatest(F.get(F.col(f"{a}.{m}"), F.lit(1)) - F.get(F.col(f"{a}.{m}"), F.lit(0)), F.lit(MEASURES[m])))
    fine = measured.groupBy("lang", "source").agg(F.count("*").alias("n"), *sketches.values()).alias("fine")
    lang = measured.groupBy("lang").agg(F.count("*").alias("n"), *sketches.values()).alias("lang")
    # One row, or none for an empty table: it is read here and stands in the plan as numbers.
    every = measured.agg(*sketches.values()).first()
    joined = fine.join(lang, F.col("fine.lang").eqNullSafe(F.col("lang.lang")))
    overall = {m: float(q[1] + SPREAD * max(q[1] - q[0], MEASURES[m])) if (q := every[m]) else None for m in MEASURES}
    own = lambda m: F.when(F.col("fine.n") >= MIN_GROUP, upper("fine", m)).when(F.col("lang.n") >= MIN_GROUP, upper("lang", m)).otherwise(F.lit(overall[m])).alias(f"max_{m}")
    return joined.select(F.col("fine.lang").alias("lang"), F.col("fine.source").alias("source"), *[own(m) for m in MEASURES])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document row: counts, ``base_failed``, ``kept`` and the measures above their limits (``reasons``).

    A null or empty text has no words and fails; a null language or source forms
    its own group; repeated rows are judged each; other columns are left out and
    may have any names. An empty table gives no rows.
    """
    measured = common.staged(measures(docs, id_col, text_col, lang_col, source_col))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    told = limits(measured).select(key(F.col("lang")).alias("lang_key"), key(F.col("source")).alias("source_key"), *[f"max_{m}" for m in MEASURES], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = measured.withColumns({"lang_key": key(F.col("lang")), "source_key": key(F.col("source")), "salt": F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")})
    judged = salted.join(told, ["lang_key", "source_key", "salt"])
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    reasons = F.array_compact(F.array(*[F.when(F.col(m) > F.col(f"max_{m}"), F.lit(m)) for m in MEASURES]))
    return judged.withColumns({"base_failed": base_failed, "reasons": reasons}).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), F.array_join("reasons", ",").alias("reasons")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.documents(spark, sf_dir))


def _op5_sql() -> str:
    """Exact quantiles: where groups have fewer rows than the sketches' accuracy, both are the same."""
    share = {
        "symbol_share": "n_symbols / nullif(word_chars, 0)", "exclaim_share": "n_exclaim / nullif(word_chars, 0)", "upper_share": "n_upper / nullif(word_chars, 0)",
        "dup_line_share": "n_dup_lines / nullif(n_lines, 0)", "repeat_share": "n_repeat_words / nullif(n_words, 0)",
    }
    least = {"symbol_share": 0.01, "exclaim_share": 0.01, "upper_share": 0.05, "dup_line_share": 0.1, "repeat_share": 0.05}
    limit = lambda m: f"quantile_disc({m}, 0.75) + 3 * greatest(quantile_disc({m}, 0.75) - quantile_disc({m}, 0.25), {least[m]}e0) AS {m}"
    limits_of = lambda by: f"SELECT {by}, count(*) AS n, {', '.join(map(limit, share))} FROM s GROUP BY ALL"
    above = [f"CASE WHEN s.{m} > CASE WHEN f.n >= 100 THEN f.{m} WHEN g.n >= 100 THEN g.{m} ELSE e.{m} END THEN '{m}' END" for m in share]
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8),
rep AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(following - i, 8))) AS n FROM rep GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaim, len(l) AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)
),
s AS (SELECT *, {', '.join(f"coalesce(({x})::DOUBLE, 0) AS {k}" for k, x in share.items())} FROM m),
f AS ({limits_of('lang, source')}), g AS ({limits_of('lang')}), e AS ({limits_of('0 AS k')}),
j AS (
  SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', {', '.join(above)}) AS reasons
  FROM s JOIN f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source JOIN g ON s.lang IS NOT DISTINCT FROM g.lang, e
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND reasons = '' AS kept, reasons FROM j
"""


OP5_SQL = _op5_sql()
