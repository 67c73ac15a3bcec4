"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts.

The filter holds a bigram of count c at the levels 1 to 1 + floor(log2 c); a count
is read back by probing level after level until one is missing. Filter and probes
are dealt in segments by bigram hash: the filter of a corpus has no size bound, so
every worker holds the segment that its probes need, and the number of segments
grows with the corpus. Texts are turned into codes once, in chunks; a chunk's
distinct words and bigrams, not its tokens, go through the shuffles, packed by
segment, so a very frequent word costs one entry per chunk.

A token's probability is Witten-Bell smoothed: the bigram count backed by the
add-one unigram share, with the history's number of different successors as the
weight. A segment sees all chunks that have a bigram and marks one of them, so
the marked bigrams of all chunks, summed by history, are the corpus's successors.

A text's score is that of an even mixture of this model and the unigram shares, so
a text whose word order the training text contradicts loses at most log10(2)
against the shares alone.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import common

FOLDS, HELD_OUT = 7, 2
#: Tokens of a chunk: what a Python worker holds at a time.
CHUNK_TOKENS = 1_200_000
#: Distinct bigrams of all chunks that a segment holds, about; and the least number of segments.
SEGMENT_KEYS, LEAST_SEGMENTS = 1_000_000, 64
BITS_PER_ENTRY, PROBES = 10, 7
#: Bits of a chunk's number within its partition; 21 more name a document in it, which leaves 24 for partitions.
CHUNK_BITS, PLACE_BITS = 18, 21
_CHUNK_SQL = "chunk long, ids binary, lengths binary, train binary, codes binary, words binary, n_tokens long, n_train long"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = -(1 << 63)
#: A bit beside the level: of all chunks with this trained bigram, this one counts it as a successor.
COUNTED = 0x80
#: Stands for the end of a document; no word can be a line end.
END = b"\n"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads neighbours."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _squeezed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _opened(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


class LogFrequencyFilter:
    """A Bloom filter of (key, level) pairs; keys are spread 64-bit numbers."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        levels = 1 + np.floor(np.log2(counts)).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
        self.top = int(levels.max(initial=0))
        self.size = np.uint64(max(64, BITS_PER_ENTRY * int(levels.sum())))
        bits = np.zeros(int(self.size), np.bool_)
        for level in range(1, self.top + 1):
            at = keys[levels >= level]
            for place in self._places(at, level):
                bits[place] = True
        self.bits = np.packbits(bits)

    def _places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        a = _mixed(keys + np.uint64(level * int(_MIX) & 0xFFFFFFFFFFFFFFFF))
        b = _mixed(a ^ _MIX) | np.uint64(1)
        for k in range(PROBES):
            yield (a + np.uint64(k) * b) % self.size

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: 0 if it is not in the filter (or rarely, by a false positive, one more)."""
        out = np.zeros(len(keys), np.uint8)
        active = np.arange(len(keys))
        for level in range(1, self.top + 1):
            ok = np.ones(len(active), np.bool_)
            for place in self._places(keys[active], level):
                ok &= ((self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1).astype(np.bool_)
            active = active[ok]
            if not len(active):
                break
            out[active] = level
        return out


def expected_count(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level: 0, 1, 2.5, 5.5, 11.5, ..."""
    return np.where(levels > 0, (3.0 * 2.0 ** (levels.astype(np.float64) - 1) - 1) / 2, 0.0)


def even_mixture(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """log10 probability of a text that came from one of two models, either as likely, from its log10 probability in each."""
    ten = np.log(10)
    return (np.logaddexp(one * ten, other * ten) - np.log(2)) / ten


def text_chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Rows of about ``chunk_tokens`` tokens (a text is never cut): codes of the tokens and hashes of the distinct words (code 0: the end)."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part, number = TaskContext.get().partitionId(), 0

        def row(ids: list, lengths: list, codes: list, words: dict) -> pa.RecordBatch:
            train = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS != HELD_OUT for i in ids], np.bool_)
            n = np.array(lengths, "<u4")
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
            if number >> CHUNK_BITS:
                raise ValueError("too many chunks in one partition; give the table more partitions")
            values = [(part << CHUNK_BITS) + number, np.array([_NO_ID if i is None else i for i in ids], "<i8").tobytes(), n.tobytes(), train.tobytes(), _squeezed(np.concatenate(codes)), hashes.tobytes(), int(n.sum()), int(n[train].sum())]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, [pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.int64()], strict=True)], names=_CHUNK_SQL.replace(",", "").split()[::2])

        def fresh() -> tuple[list, list, list, defaultdict]:
            words: defaultdict = defaultdict()
            words.default_factory = words.__len__
            words[END]
            return [], [], [], words

        state, total = fresh(), 0
        for some, texts in common.steps(batches):
            for i, text in zip(some, texts, strict=True):
                ids, lengths, codes, words = state
                # As bytes: lower() and split() know ASCII only, which is what the contract asks for.
                found = text.encode("utf-8", "surrogatepass").lower().split()
                codes.append(np.array([*map(words.__getitem__, found), 0], "<u4"))
                ids.append(i)
                lengths.append(len(found) + 1)
                total += len(found) + 1
                if total >= chunk_tokens:
                    yield row(*state)
                    state, total, number = fresh(), 0, number + 1
        if state[0]:
            yield row(*state)

    return docs.mapInArrow(chunks, _CHUNK_SQL)


class Chunk:
    """The arrays of a chunk's row."""

    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.train = np.frombuffer(row["train"], np.bool_)
        self.codes = _opened(row["codes"], "<u4")
        self.words = np.frombuffer(row["words"], np.uint64)
        self.in_train = np.repeat(self.train, self.lengths)
        # Every document begins after an end.
        self.history = np.concatenate([np.zeros(1, np.uint32), self.codes[:-1]])

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigram keys, ascending; the key of each token; how often each is in training; the code of its history."""
        h = _mixed(self.words)
        keys, first, inverse = np.unique(_mixed(h[self.history] * _MIX + h[self.codes]), return_index=True, return_inverse=True)
        return keys, inverse, np.bincount(inverse, self.in_train, len(keys)).astype(np.int64), self.history[first]


def key_shift(total: int) -> int:
    """Bits that a key can do without: any two of ``total`` keys still differ but for one in 16,000."""
    return max(0, 64 - (int(total).bit_length() + 14))


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    """Ends of each segment's slice of ascending keys."""
    edges = (np.arange(1, segments, dtype=np.uint64) * np.uint64((1 << 64) // segments)).astype(np.uint64)
    return np.concatenate([np.searchsorted(keys, edges), [len(keys)]])


def word_parts(chunks: DataFrame) -> DataFrame:
    """A chunk's distinct words, their training counts, and the history of each of its distinct bigrams."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r)
                _, _, _, before = c.bigrams()
                count = np.bincount(c.codes, c.in_train, len(c.words)).astype("<u4")
                yield pa.record_batch([pa.array([c.chunk]), *(pa.array([x], pa.binary()) for x in (r["words"], _squeezed(count), _squeezed(before.astype("<u4"))))], names=["chunk", "words", "counts", "before"])

    return chunks.mapInArrow(rows, "chunk long, words binary, counts binary, before binary")


def word_rows(parts: DataFrame, levels: DataFrame, segments: int) -> DataFrame:
    """A chunk's distinct words by segment, ascending: their training counts there, and how many bigrams that are counted there begin with them."""

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        words, before = np.frombuffer(r["words"], np.uint64), _opened(r["before"], "<u4")
        marks = np.concatenate([_opened(x["levels"], "u1") for x in sorted(right.to_pylist(), key=lambda x: x["segment"])])
        order = np.argsort(words)
        ascending, count = words[order], _opened(r["counts"], "<u4")[order]
        after = np.bincount(before[(marks & COUNTED) > 0], minlength=len(words)).astype("<u4")[order]
        out, start = [], 0
        for s, end in enumerate(_segment(ascending, segments).tolist()):
            if end > start:
                out.append((s, r["chunk"], _squeezed(np.diff(ascending[start:end], prepend=np.uint64(0))), _squeezed(count[start:end]), _squeezed(after[start:end])))
            start = end
        return pa.table([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], names=["segment", "chunk", "words", "c", "t"])

    return parts.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(rows, "segment int, chunk long, words binary, c binary, t binary")


def word_totals(table: pa.Table) -> pa.Table:
    """A segment of words: for each chunk's words the training counts and successors of all chunks; beside the first chunk, how many words are in training."""
    words = [np.cumsum(_opened(w.as_py(), "<u8"), dtype=np.uint64) for w in table.column("words")]
    distinct, inverse = np.unique(np.concatenate(words), return_inverse=True)
    ends = np.cumsum([len(w) for w in words])[:-1]
    summed = lambda name: np.bincount(inverse, np.concatenate([_opened(x.as_py(), "<u4") for x in table.column(name)]), len(distinct)).astype("<u8")
    c, t = summed("c"), summed("t")
    parts = lambda x: pa.array([_squeezed(p) for p in np.split(x[inverse], ends)], pa.binary())
    known = np.zeros(len(words), np.int64)
    known[0] = np.count_nonzero(c)
    return pa.table({"chunk": table.column("chunk"), "segment": table.column("segment"), "known": pa.array(known), "c": parts(c), "t": parts(t)})


def segment_rows(chunks: DataFrame, segments: int, shift: int) -> DataFrame:
    """A chunk's distinct bigrams (without their last ``shift`` bits) and training counts, by segment."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r)
                keys, _, times, _ = c.bigrams()
                out, start = [], 0
                for s, end in enumerate(_segment(keys, segments).tolist()):
                    if end > start:
                        short = keys[start:end] >> np.uint64(shift)
                        out.append((s, c.chunk, end - start, _squeezed(np.diff(short, prepend=np.uint64(0))), _squeezed(np.minimum(times[start:end], 0xFFFFFFFF).astype("<u4"))))
                    start = end
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["segment", "chunk", "n", "keys", "times"])

    return chunks.mapInArrow(rows, "segment int, chunk long, n long, keys binary, times binary")


def probe(table: pa.Table) -> pa.Table:
    """A segment: its filter is filled from all chunks' training counts, then probed for each chunk's bigrams.

    All occurrences of a bigram are in one segment, so each trained one is marked in one chunk.
    """
    keys = [np.cumsum(_opened(k.as_py(), "<u8"), dtype=np.uint64) for k in table.column("keys")]
    times = [_opened(k.as_py(), "<u4").astype(np.int64) for k in table.column("times")]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate(times), len(distinct)).astype(np.int64)
    made = LogFrequencyFilter(distinct[counts > 0], counts[counts > 0])
    place = np.zeros(len(distinct), np.int64)
    place[inverse] = np.arange(len(inverse))
    counted = np.zeros(len(inverse), np.uint8)
    counted[place[counts > 0]] = COUNTED
    marks = np.split(counted, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"chunk": table.column("chunk"), "segment": table.column("segment"), "levels": pa.array([_squeezed(made.levels(k) | m) for k, m in zip(keys, marks, strict=True)], pa.binary())})


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Trained on the rows whose id's crc32 modulo 7 is not 2 (a null id counts as
    an empty one). A null or empty text is its end alone; repeated rows are
    counted and scored each; other columns are left out; an empty table gives no
    rows. Without training rows the unigram share is all there is. A score is
    finite and at most log10(2) below its base score.
    """
    chunks = common.staged(text_chunks(common.id_and_text(docs, id_col, text_col)))
    sum_of = lambda column, name: F.coalesce(F.sum(column), F.lit(0)).alias(name)
    sizes = chunks.agg(sum_of("n_train", "train"), sum_of("n_tokens", "all"), sum_of(F.length("words"), "words")).first()
    parts_of = lambda keys: max(LEAST_SEGMENTS, -(-keys // SEGMENT_KEYS))
    levels = common.staged(segment_rows(chunks, parts_of(sizes["all"]), key_shift(sizes["all"])).groupBy("segment").applyInArrow(probe, "chunk long, segment int, levels binary"))
    words = word_rows(word_parts(chunks), levels, parts_of(sizes["words"] // 8))
    totals = common.staged(words.groupBy("segment").applyInArrow(word_totals, "chunk long, segment int, known long, c binary, t binary"))
    distinct = totals.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    n_train = sizes["train"]
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    whole = chunks.select("chunk", F.lit(-1).alias("segment"), "ids", "lengths", "train", "codes", "words", *none("levels"))
    whole = whole.unionByName(levels.select("chunk", "segment", *none("ids", "lengths", "train", "codes", "words"), "levels"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["segment"])
        c = Chunk(rows[0])
        _, inverse, _, _ = c.bigrams()
        found = np.concatenate([_opened(r["levels"], "u1") for r in rows[1:]]) & ~np.uint8(COUNTED)
        sums = sorted(right.to_pylist(), key=lambda r: r["segment"])
        count, after, order = np.zeros(len(c.words)), np.zeros(len(c.words)), np.argsort(c.words)
        for into, name in ((count, "c"), (after, "t")):
            into[order] = np.concatenate([_opened(r[name], "<u8") for r in sums])
        # Of two bigrams whose shortened keys are equal one is marked, but a word in training has a successor.
        after = np.maximum(after, count > 0)
        share = (count[c.codes] + 1) / (n_train + distinct + 1)
        past, weight = count[c.history], after[c.history]
        pair = np.minimum(expected_count(found)[inverse], past)
        smooth = np.where(past > 0, (pair + weight * share) / np.maximum(past + weight, 1), share)
        starts = np.concatenate([[0], np.cumsum(c.lengths)[:-1]])
        per_doc = lambda x: np.add.reduceat(x, starts)
        base, bigram = per_doc(np.log10(share)), per_doc(np.log10(smooth))
        return pa.table({
            "doc_id": pa.array([None if i == _NO_ID else i for i in c.ids.tolist()], pa.int64()), "held_out": pa.array(~c.train), "n_tokens": pa.array(c.lengths), "n_known": pa.array(per_doc((count[c.codes] > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(c.ids), n_train, np.int64)), "base_score": pa.array(base), "score": pa.array(even_mixture(base, bigram)),
        })

    return whole.groupBy("chunk").cogroup(totals.select("chunk", "segment", "c", "t").groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(common.documents(spark, sf_dir))
