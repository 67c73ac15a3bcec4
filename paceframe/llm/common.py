"""Helpers that the text operators share: tables, shared folders, Arrow batches and words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one Python step handles at a time.
STEP_CHARS = 4_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())
SPACES = " \t\n\x0b\x0c\r"
#: A word in the sense of most contracts: a run without blanks.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    ``spark.checkpoint.dir`` names its parent. Only a session that runs in one
    process may do without the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="text-stages-")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder once and read from there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more; of another table, nothing."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if base and f"/{spark.sparkContext.applicationId}/" in folder and base.rstrip("/").removeprefix("file:").lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns ``id`` and ``text``, whatever other columns are called; a null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def steps(batches: Iterable[pa.RecordBatch], chars: int = STEP_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of Arrow batches (columns ``id``, ``text``) in slices of bounded size."""
    for batch in batches:
        ids, texts, total = [], [], 0
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            total += len(texts[-1])
            if total >= chars:
                yield ids, texts
                ids, texts, total = [], [], 0
        if ids:
            yield ids, texts


def release_memory() -> None:
    """Gives memory that earlier steps left unused in this worker back to the system; workers live through all stages of a job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bucket(column: Column | str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``: the folds of the contracts."""
    return F.crc32(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")).cast("binary")) % modulus
