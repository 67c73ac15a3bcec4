"""N-gram Jaccard join with a token-group matrix.

Every document is the set of hashes of its word n-grams. Counting in how many
sets an n-gram occurs (exactly, in hash segments) settles most documents at once:
a set with too few shared n-grams has no partner. The others are ordered rare
n-grams first, and two sets that are similar enough share one of their first few.

Similar documents are put into groups: members of equal min-hashes are compared
with the first of them and joined where they link. The matrix stores, for each
token, the groups whose union of leading tokens has it, with their members' sizes
and the most tokens that a member has from there on. The first common token of
two sets leaves them no more common tokens than either has from there on; this
bounds a document's overlap with a group, and only groups that can reach the
threshold are opened. A second bound comes from a bit mark of each set (every
token flips one of its bits): the union and the intersection of a group's marks
tell bits in which a document differs from all members, and two sets differ in at
least as many tokens as their marks do in bits. Members that can reach the
threshold one by one are compared, exactly.

Already connected documents are not compared again, so most of a large group of
near copies costs one comparison each. Before groups are opened, every token's
documents are compared with one of them, another one for each token: copies that
differ too much from the first of their min-hash meet many others that way, at
one comparison for each token at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import common
from paceframe.llm.language_model import LEAST_SEGMENTS, PLACE_BITS, SEGMENT_KEYS, Chunk, _mixed, _opened, _segment, _squeezed, key_shift, text_chunks

BANDS = 4
SALTS = 8
#: Tokens of a chunk: its sets are held by one Python worker.
CHUNK_TOKENS = 1_000_000
#: 64-bit words of a set's mark.
MARK_WORDS = 8
_NO_ID = -(1 << 63)
_M = np.uint64(0x9E3779B97F4A7C15)
_SETS_SQL = "id long, row long, n long, sig binary, tokens binary, lead binary, bands array<long>, mark array<long>"


def mark(tokens: np.ndarray) -> list[int]:
    """Each token flips one bit of the mark, so marks differ in no more bits than their sets in tokens."""
    bits = np.bincount((_mixed(tokens) % np.uint64(64 * MARK_WORDS)).astype(np.int64), minlength=64 * MARK_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).tolist()


class ShingleSets:
    """The sets of a chunk's documents: ``tokens[starts[d]:starts[d + 1]]``, ascending."""

    def __init__(self, c: Chunk, words: int):
        import xxhash

        h = _mixed(c.words)[c.codes]
        ends = np.cumsum(c.lengths)
        starts, counts = ends - c.lengths, c.lengths - 1  # without the end
        doc = np.repeat(np.arange(len(counts)), c.lengths)
        value = np.zeros(len(h), np.uint64)
        for k in range(words):
            value = value * _M + np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)])[: len(h)]
        full = np.arange(len(h)) + words <= (starts + counts)[doc]
        value, doc = _mixed(value[full]), doc[full]
        # A text of fewer words is one shingle, told apart by its length.
        short = np.flatnonzero((counts > 0) & (counts < words))
        extra = np.zeros(len(short), np.uint64)
        for j, d in enumerate(short.tolist()):
            x = np.uint64(counts[d])
            with np.errstate(over="ignore"):
                for y in h[starts[d] : starts[d] + counts[d]]:
                    x = x * _M + y
            extra[j] = x
        value, doc = np.concatenate([value, _mixed(extra)]), np.concatenate([doc, short])
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), np.bool_)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        self.tokens, self.doc = value[new], doc[new]
        self.sizes = np.bincount(self.doc, minlength=len(counts))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.sigs = [xxhash.xxh3_128_digest(self.tokens[a:b].tobytes()) if b > a else None for a, b in zip(self.starts, self.starts[1:], strict=False)]

    def keys(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens without their last bits, ascending, and in how many different sets of the chunk each is."""
        seen: set = set()
        fresh = np.array([s is not None and not (s in seen or seen.add(s)) for s in self.sigs], np.bool_)
        return np.unique(self.tokens[fresh[self.doc]] >> np.uint64(shift), return_counts=True)


def _segment_rows(chunks: DataFrame, words: int, segments: int, shift: int) -> DataFrame:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r)
                keys, counts = ShingleSets(c, words).keys(shift)
                out, start = [], 0
                for s, end in enumerate(_segment(keys << np.uint64(shift), segments).tolist()):
                    if end > start:
                        out.append((s, c.chunk, _squeezed(np.diff(keys[start:end], prepend=np.uint64(0))), _squeezed(counts[start:end].astype("<u4"))))
                    start = end
                if out:
                    yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["segment", "chunk", "keys", "counts"])

    return chunks.mapInArrow(rows, "segment int, chunk long, keys binary, counts binary")


def _frequencies(table: pa.Table) -> pa.Table:
    """For a segment's keys of each chunk: the power of two of the number of sets."""
    keys = [np.cumsum(_opened(k.as_py(), "<u8"), dtype=np.uint64) for k in table.column("keys")]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([_opened(k.as_py(), "<u4") for k in table.column("counts")]), len(distinct))
    level = np.floor(np.log2(counts)).astype(np.uint8)[inverse]
    edges = np.cumsum([len(k) for k in keys])[:-1]
    return pa.table({"chunk": table.column("chunk"), "segment": table.column("segment"), "levels": pa.array([_squeezed(x) for x in np.split(level, edges)], pa.binary())})


def row_numbers(chunk: int, n: int) -> np.ndarray:
    """A number for each of the n documents of a chunk, different from those of all other chunks."""
    return (chunk << PLACE_BITS) + np.arange(n, dtype=np.int64)


def lead_length(n: np.ndarray | int, percent: int):
    """Tokens of a set of n of which a partner must have one."""
    return n - -(-n * percent // 100) + 1


def shingle_table(chunks: DataFrame, words: int, percent: int, segments: int, shift: int) -> DataFrame:
    """id, row, n and sig of every document; its tokens, leading tokens and min-hashes if it may have a partner.

    Frequencies are counted without the tokens' last ``shift`` bits, which can only
    make a token look more frequent: no partner is lost, sets are compared whole.
    """
    levels = _segment_rows(chunks, words, segments, shift).groupBy("segment").applyInArrow(_frequencies, "chunk long, segment int, levels binary")
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    parts = ("ids", "lengths", "train", "codes", "words")
    whole = chunks.select("chunk", F.lit(-1).alias("segment"), *parts, *none("levels")).unionByName(levels.select("chunk", "segment", *none(*parts), "levels"))

    def sets(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        c = Chunk(rows[0])
        s = ShingleSets(c, words)
        level = np.zeros(len(s.tokens), np.uint8)
        if len(s.tokens):
            keys, _ = s.keys(shift)
            level = np.concatenate([_opened(r["levels"], "u1") for r in rows[1:]])[np.searchsorted(keys, s.tokens >> np.uint64(shift))]
        shared = np.bincount(s.doc, level > 0, len(s.sizes))
        maybe = (s.sizes > 0) & (100 * shared >= percent * s.sizes)
        out: dict[str, list] = {k: [] for k in ("tokens", "lead", "bands", "mark")}
        seeds = [np.uint64(((b + 1) * int(_M)) & 0xFFFFFFFFFFFFFFFF) for b in range(BANDS)]
        for d, (a, b) in enumerate(zip(s.starts, s.starts[1:], strict=False)):
            if not maybe[d]:
                for v in out.values():
                    v.append(None)
                continue
            t = s.tokens[a:b]
            first = np.lexsort((t, level[a:b]))[: lead_length(len(t), percent)]
            out["tokens"].append(t.tobytes())
            out["lead"].append(t[first].tobytes())
            out["mark"].append(mark(t))
            out["bands"].append([int(_mixed(t ^ seed).min().view(np.int64)) for seed in seeds])
        n_docs = len(s.sizes)
        return pa.table({
            "id": pa.array([None if i == _NO_ID else i for i in c.ids.tolist()], pa.int64()), "row": pa.array(row_numbers(c.chunk, n_docs)), "n": pa.array(s.sizes.astype(np.int64)), "sig": pa.array(s.sigs, pa.binary()),
            "tokens": pa.array(out["tokens"], pa.binary()), "lead": pa.array(out["lead"], pa.binary()), "bands": pa.array(out["bands"], pa.list_(pa.int64())), "mark": pa.array(out["mark"], pa.list_(pa.int64())),
        })

    return whole.groupBy("chunk").applyInArrow(sets, _SETS_SQL)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets link: 100 * intersection >= percent * union."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}"))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node of the links, by alternating large and small stars."""
    edges = common.staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = common.staged(small)
        # Done when every node points at a root: no target points on, and no node has two.
        if after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after


def between_groups(rows: DataFrame) -> DataFrame:
    """The rows, staged, whose token occurs in more than one group."""
    shared = rows.groupBy("token").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x < y").select("token")
    return common.staged(rows.join(shared, "token", "left_semi"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row, and its row number (``row``).

    A-Z are lower-cased; words are runs without blanks; a text of fewer words is
    one shingle; texts without words link with nothing and are their own
    component. Null ids are never a component's name: a component of null ids
    only has a null name. Repeated rows and equal texts link. Other columns are
    left out; an empty table gives no rows.
    """
    chunks = common.staged(text_chunks(common.id_and_text(docs, id_col, text_col), CHUNK_TOKENS))
    total = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    table = common.staged(shingle_table(chunks, words, percent, max(LEAST_SEGMENTS, -(-total // SEGMENT_KEYS)), key_shift(total)))
    common.discard(chunks)
    # One node for each different set that may have partners.
    sets = common.staged(table.where("tokens IS NOT NULL").groupBy("sig").agg(F.min(F.struct("row", "n", "tokens", "lead", "bands", "mark")).alias("r")).select(F.col("r.row").alias("node"), "sig", "r.n", "r.tokens", "r.lead", "r.bands", "r.mark"))
    fits = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))

    # Groups: each member of a min-hash is compared with the first. A large group's members are dealt to SALTS tasks.
    keyed = sets.select("node", "n", F.posexplode("bands").alias("band", "key")).withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int"))
    first = keyed.groupBy("band", "key").agg(F.min(F.struct("node", "n")).alias("f"), F.count("*").alias("members")).where("members > 1")
    first = first.select("band", "key", F.col("f.node").alias("b"), F.col("f.n").alias("n_b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    stars = keyed.join(first, ["band", "key", "salt"]).where((F.col("node") != F.col("b")) & fits(F.col("n"), F.col("n_b"))).select(F.col("node").alias("a"), "b").distinct()
    near = common.staged(linked(stars, sets, percent))
    grouped = components(near)

    # The matrix: token, group, least and largest member, the most tokens from here on, union and intersection of the marks.
    def leads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("lead")]
            times = [len(t) for t in token]
            of = {c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), times) for c in ("node", "n", "grp")}
            place = np.concatenate([np.arange(k) for k in times]) if times else np.zeros(0, np.int64)
            columns = [np.concatenate(token) if token else np.zeros(0, np.int64), of["node"], of["n"], of["grp"], of["n"] - place]
            marks = batch.column("mark").take(pa.array(np.repeat(np.arange(len(times)), times)))
            yield pa.record_batch([*[pa.array(c, pa.int64()) for c in columns], marks], names=["token", "node", "n", "grp", "rest", "mark"])

    members = sets.join(grouped, "node", "left").select("node", "n", "lead", "mark", F.coalesce("root", "node").alias("grp"))
    # What is left behind a token must suffice for the smallest possible partner.
    rows = members.mapInArrow(leads, "token long, node long, n long, grp long, rest long, mark array<long>").where((100 + percent) * F.col("rest") >= F.lit(percent) * (F.col("n") + F.ceil(F.col("n") * percent / 100)))
    enough = lambda rest, a, b: (100 + percent) * rest >= percent * (a + b)
    unlike = lambda bits, a, b: (100 + percent) * bits > (100 - percent) * (a + b)
    words_of = range(MARK_WORDS)
    apart = lambda a, b: sum(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in words_of)
    rows = between_groups(rows)

    # Each token's documents are compared with one of them, chosen by a hash of both.
    hubs = rows.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("rest")).alias("before"), F.xxhash64("token", "node").alias("h"), "node", "n", "grp", "rest", "mark")).alias("f"))
    hubs = hubs.select("token", *[F.col(f"f.{c}").alias(f"{c}_b") for c in ("node", "n", "grp", "rest", "mark")])
    met = rows.join(hubs, "token").where((F.col("grp") != F.col("grp_b")) & fits(F.col("n"), F.col("n_b")) & enough(F.least("rest", "rest_b"), F.col("n"), F.col("n_b")) & ~unlike(apart("mark", "mark_b"), F.col("n"), F.col("n_b")))
    met = common.staged(linked(met.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct(), sets, percent))
    near = near.union(met)
    if not met.isEmpty():
        rows = between_groups(rows.drop("grp").join(components(near), "node", "left").withColumn("grp", F.coalesce("root", "node")).drop("root"))

    marks = [*[F.bit_or(F.col("mark")[i]).alias(f"any{i}") for i in words_of], *[F.bit_and(F.col("mark")[i]).alias(f"all{i}") for i in words_of]]
    groups = rows.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("reach"), *marks)
    # Bits that no member has and the query has, and the other way round.
    outside = sum(F.bit_count(F.col("q.mark")[i].bitwiseAND(F.bitwise_not(f"g.any{i}"))) + F.bit_count(F.bitwise_not(F.col("q.mark")[i]).bitwiseAND(F.col(f"g.all{i}"))) for i in words_of)
    # Qualifying groups: later ones that share the token, have sizes in reach, enough tokens from there on and marks near enough.
    opened = rows.alias("q").join(groups.alias("g"), "token").where(
        (F.col("q.grp") < F.col("g.grp")) & (100 * F.col("g.most") >= percent * F.col("q.n")) & (100 * F.col("q.n") >= percent * F.col("g.least"))
        & enough(F.least("q.rest", "g.reach"), F.col("q.n"), F.greatest(F.col("g.least"), F.ceil(F.col("q.n") * percent / 100)))
        & ~unlike(outside, F.col("q.n"), F.col("g.most"))
    )
    opened = opened.select("token", F.col("q.node").alias("a"), F.col("q.n").alias("n_a"), F.col("q.rest").alias("rest_a"), F.col("q.mark").alias("mark_a"), F.col("g.grp").alias("grp"))
    inside = rows.select("token", "grp", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), F.col("mark").alias("mark_b"))
    possible = fits(F.col("n_a"), F.col("n_b")) & enough(F.least("rest_a", "rest_b"), F.col("n_a"), F.col("n_b")) & ~unlike(apart("mark_a", "mark_b"), F.col("n_a"), F.col("n_b"))
    pairs = opened.join(inside, ["token", "grp"]).where(possible).select("a", "b").distinct()
    far = linked(pairs, sets, percent)
    roots = components(near.union(far))

    by_sig = table.where("n > 0").groupBy("sig").agg(F.min("id").alias("least_id"), F.min("row").alias("node"))
    placed = by_sig.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_sig = placed.join(names, "root").select("sig", "component_id")
    out = table.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "row", "sig").join(of_sig, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of each component's smallest id; of rows that share id and text one stays.

    A row is its id and text, so an id on two texts stands for each of them alone.
    Null ids rank last: rows without one stay unless they are linked to one with an
    id, and of a component without any id the row of the least text hash stays.
    """
    # Columns get names of their own, so a caller's column may be called anything.
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    hashed = docs.select(F.xxhash64(docs[id_col].cast("long"), text).alias("h"), docs[id_col].cast("long").alias("i"), text.alias("t"), *[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)])
    found = jaccard_components(hashed, words, percent, "h", "t").select(F.col("doc_id").alias("h"), "component_id").distinct()
    order = F.struct(F.col("i").isNull().alias("none"), "i", "h")
    kept = found.join(hashed.select("h", "i").distinct(), "h").groupBy("component_id").agg(F.min(order).alias("r")).select(F.col("r.h").alias("h"))
    # The join's partitioning by hash serves the removal of repeated rows as well.
    one = hashed.join(kept, "h", "left_semi").dropDuplicates(["h", "i", "t"])
    return one.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.85: every document with its set's size and its component."""
    return jaccard_components(common.documents(spark, sf_dir), words=4, percent=85).drop("row")


OP9_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM t, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM t UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT t.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM t LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY t.doc_id
"""
