"""N-gram Jaccard join: signature trees over shingle sets.

Texts become sets of word shingles, held as sorted 64-bit hashes. Documents with equal sets form a class, which gets a number. Classes
are routed to buckets by bands of three min-hashes; with so many bands as `n_bands` gives, two sets at the threshold share no
bucket with probability `MISS` (1e-10) at most, more similar ones less. Only buckets of two or more classes go on, of several
buckets with the same members one, and only the texts of their members are read again.

In each bucket a signature tree stands over the members in order of set size: leaves of up to `LEAF` sets and inner nodes hold the
OR of token bitmaps, the range of set sizes, and the most tokens that share a bit with others. A dual traversal from the
root against itself drops node pairs whose size ranges, or whose common bits, can't give the overlap that the threshold
needs. What survives is compared exactly, hash by hash, unless the two already hang together.
Each bucket returns a spanning forest of its links, so that thousands of near copies give as many rows, not their square.
Buckets that hold more than `LOAD` shingles are cut into chunks, and every pair of chunks is a task of its own.

Defined results: a text with fewer words than a shingle is one shingle of them all; null and blank texts have no shingles and
link with nothing; repeated rows share their class; rows of one id with different texts are documents of their own, which hang together only
by links; a null id comes after all others; texts of any length are read whole; extra columns don't matter; no rows in, no rows out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, row_hash, sieve, unused
from .components import components

MISS, ROWS = 1e-10, 3
LEAF, FAN, LOAD = 32, 4, 2_000_000
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def n_bands(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    known = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        while len(cls.known) < n:
            cls.known = np.concatenate([cls.known, cls.known * (cls.known[-1:] * _ODD)])
        return cls.known


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each lower-cased word of a UTF-8 text, from its bytes alone."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    gap = _GAP[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    # position of each letter in its word
    letters = np.flatnonzero(~gap)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(letters)) - first
    powers = _Powers.upto(int(sizes.max()))
    terms = (raw[letters].astype(np.uint64) + np.uint64(1)) * powers[place]
    return _mix(np.add.reduceat(terms, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64) * _ODD)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The text's set of shingles of n words: distinct hashes in order."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * _ODD + words[i : len(words) - k + 1 + i])
    return np.unique(out)


_SALTS = _mix(np.arange(1, 513, dtype=np.uint64) * _ODD)


def bands(sets: list[np.ndarray], count: int) -> np.ndarray:
    """For each set `count` keys, each of ROWS min-hashes."""
    out = np.zeros((len(sets), count), np.uint64)
    own = [i for i, s in enumerate(sets) if len(s)]
    if not own:
        return out.view(np.int64)
    low = np.concatenate([sets[i] for i in own])
    low = (low ^ (low >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *(len(sets[i]) for i in own[:-1])])
    for b in range(count):
        key = np.full(len(own), np.uint64(b))
        for r in range(ROWS):
            salt = int(_SALTS[(b * ROWS + r) % 512])
            mixed = (low ^ np.uint32(salt & 0xFFFFFFFF)) * np.uint32(salt >> 32 | 1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            key = _mix(key * _ODD + np.minimum.reduceat(mixed, starts))
        out[own, b] = key
    return out.view(np.int64)


SETS = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def signatures(docs: DataFrame, *, n: int, percent: int) -> DataFrame:
    """n_shingles, set_hash (null: no shingles) and bands of every row, in place of its last column, the text."""
    import hashlib

    count = n_bands(percent)
    kept = docs.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                sets = [shingles(t.as_py(), n) for t in b.column(len(kept))]
                keys = bands(sets, count)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * count, pa.int32()), pa.array(keys.ravel()))
                digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), flat], names=[*(f.name for f in kept), *SETS.names])

    return docs.mapInArrow(run, T.StructType([*kept, *SETS.fields]))


# signature trees


class Node:
    __slots__ = ("bits", "kids", "least", "most", "rows", "spare")

    def __init__(self, bits, least, most, spare, kids=(), rows=()):
        self.bits, self.least, self.most, self.spare, self.kids, self.rows = bits, least, most, spare, kids, rows


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set: wide enough that about a quarter of the largest set's share is taken."""
    width = 1 << max(6, int(4 * max(map(len, sets)) - 1).bit_length())
    width = min(width, 1 << 16)
    out = np.zeros((len(sets), width // 64), np.uint64)
    for row, s in zip(out, sets, strict=True):
        at = (s & np.uint64(width - 1)).astype(np.int64)
        np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def tree(bits: np.ndarray, sizes: np.ndarray) -> Node:
    spare = sizes - np.bitwise_count(bits).sum(1).astype(np.int64)
    order = np.argsort(sizes, kind="stable")
    level = []
    for at in range(0, len(order), LEAF):
        rows = order[at : at + LEAF]
        level.append(Node(np.bitwise_or.reduce(bits[rows]), int(sizes[rows].min()), int(sizes[rows].max()), int(spare[rows].max()), rows=rows))
    while len(level) > 1:
        level = [Node(np.bitwise_or.reduce([k.bits for k in kids]), kids[0].least, max(k.most for k in kids), max(k.spare for k in kids), kids=kids) for kids in (level[i : i + FAN] for i in range(0, len(level), FAN))]
    return level[0]


def _may(a: Node, b: Node, percent: int) -> bool:
    """Whether two sets below a and b can have 100 * overlap >= percent * union, i.e. (100 + percent) * overlap >= percent * (sizes)."""
    if 100 * a.most < percent * b.least or 100 * b.most < percent * a.least:
        return False
    top = min(a.most, b.most, int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.spare, b.spare))
    return (100 + percent) * top >= percent * (a.least + b.least)


def leaf_pairs(root: Node, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Dual traversal: pairs of leaves that may hold a link, and whether they are one leaf."""
    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        if not _may(a, b, percent):
            continue
        if not a.kids and not b.kids:
            yield a.rows, b.rows, a is b
        elif a is b:
            stack += [(x, y) for i, x in enumerate(a.kids) for y in a.kids[i:]]
        elif a.kids and (not b.kids or a.most - a.least >= b.most - b.least):
            stack += [(x, b) for x in a.kids]
        else:
            stack += [(a, y) for y in b.kids]


def forest(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between the sets, just enough to hold together what links hold together. side: only across its two values."""
    sizes, up, out = np.array([len(s) for s in sets]), list(range(len(sets))), []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def compare(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                up[max(a, b)] = min(a, b)
                out.append((i, j))

    if len(sets) == 2:
        compare(0, 1)
        return out
    bits = bitmaps(sets)
    ones = np.bitwise_count(bits).sum(1).astype(np.int64)
    for x, y, same in leaf_pairs(tree(bits, sizes), percent):
        # the same bounds for all pairs of the two leaves
        most = np.stack([np.bitwise_count(bits[y] & bits[i]).sum(1).astype(np.int64) for i in x])
        spare = sizes - ones
        most = np.minimum(most + np.minimum(spare[x][:, None], spare[y][None, :]), np.minimum(sizes[x][:, None], sizes[y][None, :]))
        ok = (100 + percent) * most >= percent * (sizes[x][:, None] + sizes[y][None, :])
        if same:
            ok = np.triu(ok, 1)
        if side is not None:
            ok &= side[x][:, None] != side[y][None, :]
        for i, j in zip(*np.nonzero(ok), strict=True):
            compare(int(x[i]), int(y[j]))
    return out


def links(members: DataFrame, *, n: int, percent: int) -> DataFrame:
    """Edges (a, b) of the tasks: rows of (task, side, node, shingles), where a task is a bucket or a pair of its chunks. A member
    that comes several times (repeated rows) counts once."""
    ordered = members.repartition("task").sortWithinPartitions("task", "node")

    def solve(nodes: list[int], sides: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        side = np.array(sides)
        return [(nodes[i], nodes[j]) for i, j in forest(sets, percent, side if side.any() else None)] if len(nodes) > 1 else []

    def edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nodes, sides, sets, out = None, [], [], [], []
        for b in batches:
            for t, s, i, raw in zip(*(b.column(c).to_pylist() for c in ("task", "side", "node", "shingles")), strict=True):
                if t != task:
                    out += solve(nodes, sides, sets)
                    task, nodes, sides, sets = t, [], [], []
                elif nodes and nodes[-1] == i:
                    continue
                nodes.append(i)
                sides.append(s)
                sets.append(np.frombuffer(raw, np.uint64))
            if out:
                yield edges(out)
                out = []
        out = solve(nodes, sides, sets)
        if out:
            yield edges(out)

    return ordered.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, *, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Of every row of docs: n_shingles, key (struct of no_id, id and a hash of the text, which tells documents apart) and component
    (the smallest key within reach of links, its own included)."""
    scratch = scratch or Scratch(docs.sparkSession)
    key = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), row_hash(docs, 3, text).alias("hash"))
    texts = docs.select(key.alias("key"), F.col(text).alias("text"))
    rows = scratch.cut(signatures(texts, n=n, percent=percent))
    classes = rows.filter(F.col("set_hash").isNotNull()).groupBy("set_hash").agg(F.min("key").alias("key"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = scratch.cut(classes.withColumn("node", F.monotonically_increasing_id()))  # written, so the numbers stay
    keys = classes.select("node", "size", F.posexplode("bands").alias("band", "band_key"))
    buckets = keys.groupBy("band", "band_key").agg(F.count("*").alias("members"), F.min("node").alias("least"), F.sum("size").alias("load"), F.bit_xor(F.xxhash64("node")).alias("who")).filter("members > 1")
    # one of the buckets with the same members
    buckets = buckets.groupBy("members", "least", "who").agg(F.min(F.struct("band", "band_key", "load")).alias("b")).select("b.*", "members")
    of = scratch.cut(keys.join(buckets, ["band", "band_key"]).select("node", "band", "band_key", F.least(F.col("members"), F.ceil(F.col("load") / (LOAD / 2))).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    # each pair of chunks is a task, and so is each chunk with itself
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("lo"), F.greatest(o, F.col("chunk")).alias("hi")))
    tasks = of.withColumn("chunk", chunk).select("node", "band", "band_key", "chunk", F.explode(pairs).alias("p"))
    tasks = tasks.select("node", F.xxhash64("band", "band_key", "p.lo", "p.hi").alias("task"), F.when(F.col("p.lo") == F.col("p.hi"), 0).when(F.col("chunk") == F.col("p.lo"), 1).otherwise(2).alias("side"))
    # the tasks of each member, and with them its text: so its set is sent once for each task and never before
    wanted = tasks.groupBy("node").agg(F.collect_list(F.struct("task", "side")).alias("tasks")).join(classes.select("node", "key"), "node")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, done = ("task", "side", "node", "shingles"), set()
        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                out = []
                for i, text, tasks in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), b.column("tasks").to_pylist(), strict=True):
                    if i not in done:  # repeated rows are sent once from here
                        done.add(i)
                        raw = shingles(text, n).tobytes()
                        out += [(t["task"], t["side"], i, raw) for t in tasks]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ((),) * 4, kinds, strict=True)], names=names)

    chosen = sieve(texts, wanted.select(F.col("key").alias("id")), "key").join(wanted, "key").select("node", "text", "tasks")
    members = chosen.mapInArrow(make, "task long, side int, node long, shingles binary")
    edges = scratch.cut(links(members, n=n, percent=percent))
    scratch.drop(of)
    found = components(edges, scratch)
    scratch.drop(edges)
    linked = classes.select("node", "set_hash", "key").join(found, "node")
    least = linked.groupBy("component").agg(F.min("key").alias("component_key"))
    named = classes.select("set_hash", "key", "node").join(found.join(least, "component").select("node", "component_key"), "node", "left").select("set_hash", F.coalesce("component_key", "key").alias("component"))
    return rows.select("key", "n_shingles", "set_hash").join(named, "set_hash", "left").select("key", "n_shingles", F.coalesce("component", "key").alias("component"))


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return join(docs, n=4, percent=85).select(F.col("key.id").alias("doc_id"), "n_shingles", F.col("component.id").alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest id (of equal ids the smallest hash of the text, null
    ids last), of rows equal in both one. Documents without words stay."""
    scratch = Scratch(spark)
    found = scratch.cut(join(docs, scratch=scratch).groupBy("key").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("size"), F.min("component").alias("component")))
    scratch.drop_others(found)
    # documents of which rows go; only rows that may be one of them take part in a join
    gone = found.filter("size > 0 and key <> component").select("key", F.lit(True).alias("goes"))
    more = found.filter("size > 0 and key = component and rows > 1").select("key", F.lit(False).alias("goes"))
    touched = scratch.cut(gone.union(more))
    scratch.drop(found)
    key, mark, goes = unused(docs, "key", "mark", "goes")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), row_hash(docs, 3, "text").alias("hash")))
    # an outer join stays above the sieve, while Spark would push a semi or anti join below it, to all texts
    marks = touched.select(F.col("key").alias(mark), F.col("goes").alias(goes))
    ids = touched.select(F.col("key").alias("id"))
    maybe = sieve(keyed, ids, key).join(marks, F.col(key) == F.col(mark), "left")
    once = maybe.filter(F.col(goes).isNull()).drop(key, mark, goes)
    copies = maybe.filter(~F.col(goes)).withColumn(mark, row_hash(docs, 4)).groupBy(key).agg(F.min_by(F.struct(*(f"`{c}`" for c in docs.columns)), mark).alias(mark)).select(f"{mark}.*")
    return sieve(keyed, ids, key, inside=False).drop(key).unionByName(once).unionByName(copies)
