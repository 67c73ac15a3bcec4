"""Near duplicates by SimHash fingerprints, with a table of distances to reference fingerprints.

The table holds, for each different fingerprint, its Hamming distances to
``REFERENCES`` fixed fingerprints. Two fingerprints that differ in at most k bits
differ by at most k in every one of these distances, so a pair is discarded by the
greatest difference of its coordinates, and only survivors are verified bit by bit.

A table of distances alone would have to be compared with itself as a whole.
So rows meet in buckets first: of k + 3 blocks of bits, a pair within k bits
agrees on three whole blocks, and each choice of three blocks is a bucket. In a
bucket every fingerprint is compared with the first one; what links becomes a
group. Only different groups of a bucket are compared further: the group's box
(least and greatest coordinate of its members) must be within k of a row in every
coordinate, then the table is asked row by row. Rows of a large group of near
copies that are connected already are not compared again.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import common
from paceframe.llm.jaccard import components

WORDS, DISTANCE, SEED = 4, 4, 42
#: Reference fingerprints; distances to eight of them share a column. The first column's also bound groups.
REFERENCES, SHARED = 32, 8
#: Whole blocks on which a linked pair agrees.
AGREE = 3


def references(n: int = REFERENCES) -> list[int]:
    """Fixed fingerprints without a pattern (as signed numbers): the finaliser of a 64-bit mixer over 1, 2, 3, ..."""
    out = []
    for k in range(1, n + 1):
        x = k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 31
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def fingerprint(words: list[bytes], size: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of lower-cased words: the majority of each bit over the XXH64 of all shingles, repeats included."""
    import xxhash

    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - size + 1
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        some = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Bytes hold the sums of 255 rows.
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (a signed number) of every row."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.steps(batches):
            # As bytes, lower() and split() know ASCII only, which is what the contract asks for.
            made = [fingerprint(t.encode("utf-8", "surrogatepass").lower().split(), size) for t in texts]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.array(made, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(rows, "doc_id long, fp long")


def _block_masks(distance: int) -> list[int]:
    """Masks of each choice of AGREE blocks among distance + AGREE, as signed numbers."""
    n = distance + AGREE
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    masks = [sum(some) for some in itertools.combinations(blocks, AGREE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def differing_bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def with_distances(df: DataFrame) -> DataFrame:
    """Adds the row of the distance table: columns p0, p1, ..., each with the distances to ``SHARED`` references."""
    refs = references()
    packed = []
    for k in range(0, REFERENCES, SHARED):
        parts = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("long"), 8 * j) for j, r in enumerate(refs[k : k + SHARED])]
        packed.append(functools.reduce(operator.add, parts).alias(f"p{k // SHARED}"))
    return df.select("*", *packed)


def coordinate(column: str, k: int) -> Column:
    """The k-th distance of a packed column."""
    return F.shiftright(F.col(column), 8 * k).bitwiseAND(F.lit(255))


def coordinates_within(a: str, b: str, distance: int) -> Column:
    """Whether no coordinate of the rows aliased ``a`` and ``b`` differs by more than ``distance``."""
    each = [F.abs(coordinate(f"{a}.p{c}", k) - coordinate(f"{b}.p{c}", k)) <= distance for c in range(REFERENCES // SHARED) for k in range(SHARED)]
    return functools.reduce(operator.and_, each)


def linked_roots(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp and root (a fingerprint of its component) of the fingerprints ``fp`` (distinct) that link with another."""
    bucket = ["choice", "bits"]
    masked = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _block_masks(distance)])
    keyed = nodes.select("fp", F.posexplode(masked).alias("choice", "bits"))
    crowded = keyed.groupBy(bucket).agg(F.min("fp").alias("rep"), F.max("fp").alias("other")).where("rep <> other").drop("other")
    # Spark sizes what comes after an explode as if it had the rows from before; by that size it would broadcast millions of buckets.
    rows = common.staged(keyed.join(crowded.hint("merge"), bucket))
    stars = rows.where((F.col("fp") != F.col("rep")) & (differing_bits("fp", "rep") <= distance))
    near = common.staged(stars.select(F.col("fp").alias("a"), F.col("rep").alias("b")).distinct())
    groups = components(near).select(F.col("node").alias("fp"), F.col("root").alias("grp"))
    grouped = rows.drop("rep").join(groups, "fp", "left").withColumn("grp", F.coalesce("grp", "fp"))
    # Buckets of one group need no more comparisons.
    several = grouped.groupBy(bucket).agg(F.min("grp").alias("g"), F.max("grp").alias("h")).where("g <> h").select(bucket)
    members = common.staged(with_distances(grouped.join(several.hint("merge"), bucket, "left_semi")))

    box = [f(coordinate("p0", k)).alias(f"{name}{k}") for k in range(SHARED) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = members.groupBy(*bucket, "grp").agg(*box)
    in_box = functools.reduce(operator.and_, [(coordinate("m.p0", k) >= F.col(f"g.lo{k}") - distance) & (coordinate("m.p0", k) <= F.col(f"g.hi{k}") + distance) for k in range(SHARED)])
    m, g = members.alias("m"), boxes.hint("merge").alias("g")
    opened = m.join(g, (F.col("m.choice") == F.col("g.choice")) & (F.col("m.bits") == F.col("g.bits")) & (F.col("m.grp") < F.col("g.grp")) & in_box)
    opened = opened.select("m.*", F.col("g.grp").alias("into")).alias("a")
    b = members.alias("b")
    same = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.into") == F.col("b.grp"))
    # Discarded by the table, then verified.
    far = opened.join(b, same & coordinates_within("a", "b", distance) & (differing_bits("a.fp", "b.fp") <= distance))
    links = near.union(far.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct())
    return components(links).select(F.col("node").alias("fp"), "root")


def simhash_components(docs: DataFrame, size: int = WORDS, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    A-Z are lower-cased; words are runs without blanks; a text of fewer words than
    a shingle is one shingle; null, empty and blank texts have the fingerprint
    zero, which links like any other, so all of them are one component. Equal
    fingerprints link. Null ids are never a component's name: a component of null
    ids only has a null name. Repeated rows give rows each; other columns are left
    out; an empty table gives no rows.
    """
    prints = common.staged(fingerprints(docs, size, id_col, text_col))
    nodes = common.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    placed = nodes.join(linked_roots(nodes, distance), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = placed.join(names, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, at most four differing bits: every document with its fingerprint and its component."""
    return simhash_components(common.documents(spark, sf_dir))
