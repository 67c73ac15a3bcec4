"""Removes lines that many documents share, with levelled sorted runs of line hashes.

Documents come in batches. A run is a stored table of (line hash, number of
documents), hash-partitioned and sorted. Each batch is merge-anti-joined with the
keys that have reached the limit in the runs so far: their lines are known to go
and need no further counting. The rest is counted and added as a run of level 0;
``FANOUT`` runs of a level are merged into one on the next, so a key is rewritten
once per level, and keys that have reached the limit move to a run of their own,
so later batches merge with that run and not with all counts.

Which lines are common is only known after the last batch; then one semi-join
finds them in early and late batches alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import common

MIN_DOCS, MIN_CHARS = 10, 1
FANOUT, BATCHES = 2, 4
SALTS = 8
_BLANKS = common.SPACES.encode()


def line_keys(text: str, min_chars: int) -> list[bytes]:
    """A 128-bit hash of every line's key (stripped of blanks, A-Z lower-cased); an empty one for keys that are too short."""
    import xxhash

    # As bytes, lower() and strip() know ASCII only, which is what the key asks for.
    keys = [x.strip(_BLANKS) for x in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]
    if min_chars <= 1:
        return [xxhash.xxh3_128_digest(k) if k or not min_chars else b"" for k in keys]
    return [xxhash.xxh3_128_digest(k) if len(k) >= min_chars and len(k.decode("utf-8", "surrogatepass")) >= min_chars else b"" for k in keys]


class LineRuns:
    """The runs of a folder; ``levels[k]`` names the runs of level k, ``full`` those of keys that have reached the limit."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int, fanout: int = FANOUT):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder, min_docs, fanout
        self.levels: list[list[str]] = [[]]
        self.full: list[str] = []
        self.written = 0

    def _write(self, counts: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}/run-{self.written}"
        self.written += 1
        counts.sortWithinPartitions("key").write.parquet(path)  # the sums are already dealt out by key
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("key binary, n long").parquet(*paths) if paths else self.spark.createDataFrame([], "key binary, n long")

    def _sums(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("key").agg(F.sum("n").alias("n"))

    def new_lines(self, lines: DataFrame) -> DataFrame:
        """The lines of a batch whose key has not reached the limit: a merge anti-join."""
        return lines.join(self._read(self.full).select("key").hint("merge"), "key", "left_anti") if self.full else lines

    def add(self, lines: DataFrame) -> None:
        """Adds a batch: ``lines`` has a row with ``key`` for each document and distinct line of it, all rows of a document in one batch."""
        counts = self.new_lines(lines).groupBy("key").agg(F.count("*").alias("n"))
        self.levels[0].append(self._write(counts, "level-0"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if len(self.levels) == level + 1:
                self.levels.append([])
            merged = self._sums(self.levels[level])
            self.levels[level + 1].append(self._write(merged, f"level-{level + 1}"))
            self.levels[level] = []
            level += 1
        # What reaches the limit over all runs is not sent again by later batches.
        over = self._sums([p for some in self.levels for p in some]).where(F.col("n") >= self.min_docs)
        self.full.append(self._write(self.new_lines(over), "full"))

    def common_keys(self) -> DataFrame:
        """Keys that ``min_docs`` documents have, over all runs."""
        return self._read(self.full).select("key")


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, t, batch and key for every document (id, text, t, batch) and distinct line key of it."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for i, text, t, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for key in {*line_keys(text.as_py(), min_chars)} - {b""}:
                    for column, value in zip(rows, (i, t, b, key), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["id", "t", "batch", "key"])

    return docs.mapInArrow(keys, "id long, t long, batch int, key binary")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of every row, its text without common lines, and n_lines, n_dropped and n_kept_lines.

    A null or empty text is one empty line and becomes empty; the rows of an id count
    as one document, and a null id as one document per text; a row that repeats
    another in id and text is judged alike and counted once; other columns pass
    through, whatever their names (a column called as a new one is replaced). An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped", "n_kept_lines")]
    base = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *[docs[c].alias(f"c{k}") for k, c in enumerate(names)])
    base = base.withColumn("t", F.xxhash64("text"))
    folder = common.shared_folder(spark)
    # A document is an id, or a text without one; all rows of it are in one batch.
    document = [F.col("id"), F.when(F.col("id").isNull(), F.col("t")).alias("t")]
    numbered = base.select("id", "text", "t", F.pmod(F.xxhash64(*document), F.lit(batches)).cast("int").alias("batch"))
    line_table(numbered, min_chars).write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema("id long, t long, key binary, batch int").parquet(f"{folder}/lines")
    runs = LineRuns(spark, f"{folder}/runs", min_docs)
    for k in range(batches):
        batch = lines.where(F.col("batch") == k).select("key", *document).distinct()
        runs.add(batch)
    # A very common line has rows from a large share of the documents: they are dealt to SALTS tasks.
    keys = runs.common_keys().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.lit(SALTS)).cast("int"))
    hits = salted.join(keys.hint("merge"), ["key", "salt"], "left_semi").select("id", "t", "key")
    drops = hits.groupBy("id", "t").agg(F.collect_set("key").alias("drop")).select(F.col("id").alias("drop_id"), F.col("t").alias("drop_t"), "drop")
    joined = base.join(drops, base["id"].eqNullSafe(drops["drop_id"]) & (base["t"] == drops["drop_t"]), "left").drop("drop_id", "drop_t", "t")

    def cut(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            texts, counts, dropped = [], [], []
            for text, drop in zip(batch.column("text"), batch.column("drop"), strict=True):
                whole = text.as_py()
                gone = set(drop.as_py() or ())
                split = whole.split("\n")
                kept = split if not gone else [x for x, k in zip(split, line_keys(whole, min_chars), strict=True) if k not in gone]
                texts.append("\n".join(kept))
                counts.append(len(split))
                dropped.append(len(split) - len(kept))
            rest = [f"c{k}" for k in range(len(names))]
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=[*rest, "text", "n_lines", "n_dropped"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    shape = ", ".join([*(f"c{k} {kinds[f'c{k}']}" for k in range(len(names))), "text string", "n_lines long", "n_dropped long"])
    out = joined.mapInArrow(cut, shape)
    order = [c for c in docs.columns if c in names or c == text_col]
    return out.select(*[F.col("text").alias(text_col) if c == text_col else F.col(f"c{names.index(c)}").alias(c) for c in order], "n_lines", "n_dropped", (F.col("n_lines") - F.col("n_dropped")).alias("n_kept_lines"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and the SHA-256 of what stays, for every document."""
    out = dedup_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, i, parts[i] AS line,
    translate(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
),
hot AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot USING (k) GROUP BY doc_id
"""
