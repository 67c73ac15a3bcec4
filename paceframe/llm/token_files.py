"""Token files: a zstandard frame per document, a seek table at the end, a checksum per frame.

A file is one or more independent zstandard frames, one per document (its ids,
little-endian unsigned 16 bit), then a frame with the document ids and counts,
then the seek table in a skippable frame: compressed size, plain size and the low
32 bits of the plain bytes' XXH64 for each frame. Standard seekable-zstd readers
open such files, and a reader that wants some documents decompresses only these.

Spark's own writer places the files, so lost tasks leave nothing behind and any
file system that Spark reaches will do: each row of a text table is one file,
and the row separator is chosen to be the last three bytes of the magic number.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceframe.llm import common, tokens

# Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
#: In UTF-8: EA 92 8F, the magic number's last bytes.
LAST_BYTES = "꒏"

#: Parts that a worker remembers here, beside the shuffle's buffers.
MEMO = 500_000
_NO_ID = -(1 << 63)
_SHARDS = pa.schema([("content", pa.binary())])
_DOCS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def pack_file(doc_ids: list, ids: list[bytes], level: int = 3) -> bytes:
    """The bytes of one file but for the last three."""
    import xxhash
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level, write_checksum=False)
    index = np.array([[_NO_ID if d is None else d, len(x) // 2] for d, x in zip(doc_ids, ids, strict=True)], dtype="<i8").tobytes()
    frames, table = [], []
    for plain in [*ids, index]:
        frames.append(squeeze.compress(plain))
        table.append(struct.pack("<III", len(frames[-1]), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
    foot = b"".join(table) + struct.pack("<IBI", len(table), HAS_CHECKSUMS, SEEK_TABLE_MAGIC)
    return b"".join([*frames, struct.pack("<II", SKIPPABLE_MAGIC, len(foot)), foot])[:-3]


def unpack_file(data: bytes, wanted: set | None = None) -> Iterator[tuple]:
    """(place, doc_id, start, ids) of the documents of a file; only ``wanted`` ones are decompressed.

    Raises ValueError if the file is cut or a checksum differs.
    """
    import xxhash
    import zstandard

    if len(data) < 17 or struct.unpack_from("<I", data, len(data) - 4)[0] != SEEK_TABLE_MAGIC:
        raise ValueError("not a token file, or cut")
    n, flags, _ = struct.unpack_from("<IBI", data, len(data) - 9)
    table = np.frombuffer(data, dtype="<u4", count=3 * n, offset=len(data) - 9 - 12 * n).reshape(n, 3)
    starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
    open_up = zstandard.ZstdDecompressor()

    def frame(k: int) -> bytes:
        size, plain_size, check = table[k].tolist()
        plain = open_up.decompress(data[starts[k] : starts[k] + size], max_output_size=max(1, plain_size))
        if len(plain) != plain_size or flags & HAS_CHECKSUMS and xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum differs")
        return plain

    index = np.frombuffer(frame(n - 1), dtype="<i8").reshape(-1, 2)
    start = 0
    for k, (doc, count) in enumerate(index.tolist()):
        doc = None if doc == _NO_ID else doc
        if wanted is None or doc in wanted:
            yield k, doc, start, frame(k)
        start += count


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 2_000_000) -> None:
    """Encodes every whole text and writes the token files, in ascending id.

    A null text is empty (its ids are the end id alone), a null id comes first,
    equal ids stand in the order of their texts; other columns are left out. An
    empty table gives no file with documents.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokens.encoder(tokenizer, MEMO)
        doc_ids, ids, total = [], [], 0
        for some_ids, texts in common.steps(batches, tokens.STEP_CHARS):
            flat, starts = made.encode(texts, end_id)
            data, edges = memoryview(flat.tobytes()), (2 * starts).tolist()
            for doc, a, b in zip(some_ids, edges, edges[1:], strict=False):
                doc_ids.append(doc)
                ids.append(bytes(data[a:b]))
                total += (b - a) // 2
                if total >= shard_tokens:
                    yield pa.record_batch([pa.array([pack_file(doc_ids, ids)], pa.binary())], schema=_SHARDS)
                    doc_ids, ids, total = [], [], 0
        if doc_ids:
            yield pa.record_batch([pa.array([pack_file(doc_ids, ids)], pa.binary())], schema=_SHARDS)

    ordered = common.id_and_text(docs, id_col, text_col).repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    files = ordered.mapInArrow(encode, "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.option("lineSep", LAST_BYTES).option("maxRecordsPerFile", 1).text(folder)


def read_token_files(spark: SparkSession, folder: str, doc_ids: set | None = None) -> DataFrame:
    """part, shard, place, doc_id, local_start, n_tokens and ids of the documents of a folder's files.

    ``doc_ids``: the documents to open (none others are decompressed); None: all.
    """

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = [(part, shard, k, doc, start, len(data) // 2, data) for k, doc, start, data in unpack_file(content.as_py(), doc_ids)]
                if rows:
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _DOCS.types, strict=True)], schema=_DOCS)

    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    number = lambda k: F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)", k).cast("int")
    return files.select(number(1).alias("part"), number(2).alias("shard"), "content").mapInArrow(decode, "part int, shard int, place int, doc_id long, local_start long, n_tokens long, ids binary")


def with_starts(read: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before, over all files. ``read``: a stored table of whole files' documents."""
    shards = read.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))
    # One row for each writing task: as many as the files' folder has tasks, never rows of documents.
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    bases = shards.withColumn("before", before).join(base, "part").select("part", "shard", (F.col("base") + F.col("before")).alias("base"))
    return read.join(bases, ["part", "shard"]).withColumn("start", F.col("base") + F.col("local_start"))


def digest(read: DataFrame) -> DataFrame:
    """The documents with a CRC-32 of their ids as little-endian unsigned 32-bit integers, without the ids."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_py(), "<u2").astype("<u4").tobytes()) for x in batch.column("ids")]
            yield pa.record_batch([*(batch.column(c) for c in ("part", "shard", "doc_id", "local_start", "n_tokens")), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(sums, "part int, shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the written files, read back from them."""
    import public_tokenizers

    folder = common.shared_folder(spark)
    write_token_files(common.documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    read = common.staged(digest(read_token_files(spark, folder)))
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
