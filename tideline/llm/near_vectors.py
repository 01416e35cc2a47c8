"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to one or more blocks of 8 dimensions, each decoded to the nearest point of the E8 lattice,
in several tables. A vector lies in the cell of its points and probes the cells of neighbouring points, one block at a time.
Vectors that meet in a cell (one lying, one lying or probing) are verified by their cosine in double precision.

How fine the lattice is, how many blocks make a cell, how many neighbours are probed and how many tables there are follows from the
number of vectors of the largest label (`plan`): cells must stay small however large the table, while two vectors exactly at the
threshold must meet with probability 1 - `MISS`. Probes that hit no cell where anything lies are sieved out before the shuffle.

Equal vectors form a class first, so copies cost nothing. What is grouped by cell are ids; then the vectors, as they are stored, go to
the cells where others wait, and only those of pairs that link are coded again, to count a pair in the first cell where it meets.
Cells return the number of links of each class and a spanning forest of the links, never the pairs. Cells of more than `CHUNK`
members are cut into chunks, and each pair of chunks is a task of its own.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label or an id, link with
nothing and are their own component (of a null id: null, and kept); only vectors of one length are compared; repeated rows are copies
of each other and link with each other as other vectors do; rows of one id with different vectors are vectors of their own, which
hang together only by links; extra columns don't matter; an empty table gives no rows. Found links have the threshold's
cosine or more; of all such links a small share may be missed (see the tests for recall).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, sieve
from .components import components

MISS, CHUNK, TOGETHER = 1e-3, 2048, 4096


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: all (+-1, +-1, 0, ...) and all (+-1/2, ...) with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    return np.array(out + [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0])


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 for each row: of its two cosets of D8 (integers with an even sum, shifted by 0 or 1/2) the nearer."""
    best, least = None, None
    for shift in (0.0, 0.5):
        z = y - shift
        x = np.round(z)
        odd = x.sum(1).astype(np.int64) % 2 != 0
        off = z - x
        far, rows = np.abs(off).argmax(1), np.arange(len(y))
        x[rows[odd], far[odd]] += np.where(off[rows[odd], far[odd]] >= 0, 1, -1)
        x = x + shift
        d = ((y - x) ** 2).sum(1)
        if best is None:
            best, least = x, d
        else:
            nearer = d < least
            best[nearer] = x[nearer]
    return best


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _code(points: np.ndarray, block: int) -> np.ndarray:
    out = np.full(points.shape[:-1], np.uint64(block + 1))
    for c in np.moveaxis(np.round(points * 2).astype(np.int64).astype(np.uint64), -1, 0):
        out = (out ^ c) * _ODD
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


@dataclass(frozen=True)
class Plan:
    blocks: int
    scale: float
    probes: int  # of each block
    tables: int


@lru_cache(maxsize=64)
def _meeting(scale: float, probes: int, least: float) -> tuple[float, float]:
    """How often two unit vectors of cosine `least` have the same point in one block, and how often one has a point that the other
    probes, by simulation."""
    rng, near = np.random.default_rng(31), roots()
    y = rng.normal(0, 1 / scale, (4000, 8)) + rng.random(8)
    z = y + rng.normal(0, np.sqrt(2 - 2 * least) / scale, y.shape)
    (p, p_near), (q, q_near) = _points(y, probes, near), _points(z, probes, near)
    alike = lambda a, b: (np.abs(a - b) < 1e-6).all(-1)
    same = alike(p, q)
    probed = ~same & (alike(p[:, None], q_near).any(1) | alike(q[:, None], p_near).any(1))
    return float(same.mean()), float(probed.mean())


def plan(members: int, least: float, miss: float = MISS) -> Plan:
    """The cheapest plan for so many vectors that may meet: cells to note for a vector, and vectors that meet by chance, each
    of which costs about eight times as much. Two random unit vectors have the same point with probability (scale^2 / 4 pi)^4."""
    best = None
    for blocks, scale, probes in product((1, 2, 3, 4), (1.6, 1.3, 1.0, 0.8, 0.65), (4, 8, 12, 24)):
        same, probed = _meeting(scale, probes, least)
        p = same**blocks + blocks * same ** (blocks - 1) * probed
        tables = int(np.ceil(np.log(miss) / np.log(max(1e-12, 1 - p)))) if p < 1 - miss else 1
        chance = members * min(1.0, (scale**2 / (4 * np.pi)) ** 4) ** blocks
        cost = tables * (1 + blocks * probes + 8 * chance * (1 + 2 * blocks * probes))
        if tables <= 64 and (best is None or cost < best[0]):
            best = cost, Plan(blocks, scale, probes, tables)
    return best[1]


def _points(y: np.ndarray, probes: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lattice point of each row, and the neighbours nearest to it."""
    points = decode(y)
    first = np.argpartition(-((y - points) @ near.T), probes, axis=1)[:, :probes]
    return points, points[:, None, :] + near[first]


def codes(x: np.ndarray, how: Plan, *, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """x: unit vectors. Cells they lie in (rows x tables), and cells they probe (rows x tables x probes of all blocks)."""
    rng, near, n = np.random.default_rng(seed), roots(), len(x)
    own, probes = np.zeros((n, how.tables), np.int64), np.zeros((n, how.tables, how.blocks * how.probes), np.int64)
    for t in range(how.tables):
        here, beside = [], []
        for b in range(how.blocks):
            y = x @ rng.normal(0, 1, (x.shape[1], 8)) / how.scale + rng.random(8)
            points, neighbours = _points(y, how.probes, near)
            here.append(_code(points, b))
            beside.append(_code(neighbours, b))
        own[:, t] = _joined(here, t)
        probes[:, t] = np.hstack([_joined([beside[b] if c == b else here[c][:, None] for c in range(how.blocks)], t) for b in range(how.blocks)])
    return own, probes


def _joined(parts: list[np.ndarray], table: int) -> np.ndarray:
    """One code of a cell from those of its blocks."""
    out = np.full(1, table + 1, np.uint64)
    for p in parts:
        out = (out ^ p.view(np.uint64)) * _ODD
        out = out ^ (out >> np.uint64(29))
    return out.view(np.int64)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, not empty, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def normal(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors of doubles."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _first_meeting(own: np.ndarray, probes: np.ndarray, i: np.ndarray, j: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether the given cell is the first cell where i and j meet."""
    a, b = own[i], own[j]
    in_a, in_b = (probes[j] == a[:, :, None]).any(2), (probes[i] == b[:, :, None]).any(2)
    met = (a == b) | in_a | in_b
    t, rows = met.argmax(1), np.arange(len(i))
    a, b, in_a, in_b = a[rows, t], b[rows, t], in_a[rows, t], in_b[rows, t]
    host = np.where(a == b, a, np.where(in_a & in_b, np.minimum(a, b), np.where(in_a, a, b)))
    return host == cells


def _links(x: np.ndarray, lies: np.ndarray, side: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of one cell that link, block by block."""
    n, block = len(x), 512
    for at in range(0, n, block):
        rows = np.arange(at, min(n, at + block))
        ok = (x[rows] @ x.T >= least) & (lies[rows][:, None] | lies[None, :]) & (np.arange(n)[None, :] > rows[:, None])
        if side.any():
            ok &= side[rows][:, None] != side[None, :]
        i, j = np.nonzero(ok)
        for part in range(0, len(i), 100_000):
            yield i[part : part + 100_000] + at, j[part : part + 100_000]


class Cells:
    """Members of some cells, in order of their tasks."""

    def __init__(self, how: Plan, least: float, dtype: str):
        self.how, self.least, self.dtype, self.rows = how, least, dtype, []

    def add(self, row: tuple) -> pa.RecordBatch | None:
        """Takes a row (task, cell, space, lies, side, rep, copies, raw). When many wait and a new task begins, solves them."""
        found = self.solve() if len(self.rows) >= TOGETHER and self.rows[-1][0] != row[0] else None
        self.rows.append(row)
        return found

    def solve(self) -> pa.RecordBatch | None:
        if len(self.rows) < 2:
            self.rows = []
            return None
        task, cell, space, lies, side, reps, copies, raw = zip(*self.rows, strict=True)
        self.rows = []
        task, cell, space, lies, side, reps, copies = (np.array(c) for c in (task, cell, space, lies, side, reps, copies))
        lengths, counts, edges = np.array([len(r) for r in raw]), np.zeros(len(reps), np.int64), []
        for length in np.unique(lengths):  # a cell has vectors of one length only
            own = np.flatnonzero(lengths == length)
            x = normal(np.frombuffer(b"".join(raw[i] for i in own), self.dtype).reshape(len(own), -1))
            first = np.flatnonzero(np.concatenate([[True], task[own][1:] != task[own][:-1]]))
            sizes = np.diff(np.concatenate([first, [len(own)]]))
            two = first[sizes == 2]  # most cells have two members: all of them at once
            i, j = own[two], own[two + 1]
            ok = (np.einsum("ij,ij->i", x[two], x[two + 1]) >= self.least) & (lies[i] | lies[j]) & ((side[i] != side[j]) | (side[i] == 0))
            self._count(x, own, two[ok], two[ok] + 1, counts, cell, space, copies)
            edges += zip(reps[i[ok]].tolist(), reps[j[ok]].tolist(), strict=True)
            for at, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                rows, joined = own[at : at + n], np.zeros((n, n), bool)
                for a, b in _links(x[at : at + n], lies[rows], side[rows], self.least):
                    joined[a, b] = joined[b, a] = True
                    self._count(x, own, a + at, b + at, counts, cell, space, copies)
                edges += [(int(reps[rows[a]]), int(reps[rows[b]])) for a, b in _forest(joined)]
        out = [(int(r), int(r), int(c)) for r, c in zip(reps, counts, strict=True) if c] + [(a, b, 0) for a, b in edges]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "links"]) if out else None

    def _count(self, x: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, counts: np.ndarray, cell: np.ndarray, space: np.ndarray, copies: np.ndarray) -> None:
        """Counts the pairs that meet first in their cell. i, j: rows of x, which are rows `own` of all."""
        for at in range(0, len(i), 8192):
            a, b = i[at : at + 8192], j[at : at + 8192]
            some, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            lying, probing = codes(x[some], self.how)
            key = space[own[some]]
            first = _first_meeting(lying ^ key[:, None], probing ^ key[:, None, None], place[: len(a)], place[len(a) :], cell[own[a]])
            np.add.at(counts, own[a[first]], copies[own[b[first]]])
            np.add.at(counts, own[b[first]], copies[own[a[first]]])


def _forest(joined: np.ndarray) -> list[tuple[int, int]]:
    todo, edges = joined.any(1), []
    for root in range(len(joined)):
        if not todo[root]:
            continue
        todo[root], stack = False, [root]
        while stack:
            new = np.flatnonzero(joined[stack.pop()] & todo).tolist()
            todo[new] = False
            edges += [(root, k) for k in new]
            stack += new
    return edges


def near_duplicates(vectors: DataFrame, *, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    takes_part = usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumns({"h1": F.when(takes_part, F.xxhash64("label", "v")), "h2": F.when(takes_part, F.xxhash64(F.lit(1), "v", "label"))})
    classes = rows.filter(takes_part).groupBy("h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = scratch.cut(classes.withColumn("rep", F.monotonically_increasing_id()))  # written, so the numbers stay
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    how = plan(largest, least)
    element = vectors.schema[vector].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    stored = classes if isinstance(element, (T.FloatType, T.DoubleType)) else classes.withColumn("v", F.col("v").cast("array<double>"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, TOGETHER):
                b = big.slice(start, TOGETHER)
                values, ends, keys = b.column("v").values.to_numpy(), b.column("v").offsets.to_numpy(), b.column("space").to_numpy(zero_copy_only=False)
                lengths = np.diff(ends)
                for length in np.unique(lengths):
                    at = np.flatnonzero(lengths == length)
                    raw = np.stack([values[ends[i] : ends[i + 1]] for i in at]).astype(dtype)
                    own, probes = codes(normal(raw), how)
                    own, probes = own ^ keys[at][:, None], probes ^ keys[at][:, None, None]  # labels and lengths have cells of their own
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * c[0].size, pa.int32()), pa.array(c.ravel())) for c in (own, probes)]
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([b.column("rep").take(take), b.column("copies").take(take), b.column("space").take(take), pa.array([r.tobytes() for r in raw], pa.binary()), *lists], names=["rep", "copies", "space", "raw", "own", "probes"])

    coded = scratch.cut(stored.select("rep", "copies", "v", F.xxhash64("label", F.size("v"), F.lit(2)).alias("space")).mapInArrow(encode, "rep long, copies long, space long, raw binary, own array<long>, probes array<long>"))
    lying = coded.select("rep", F.explode("own").alias("cell"))
    probing = sieve(coded.select("rep", F.explode("probes").alias("cell")), lying.select(F.col("cell").alias("id")), "cell")
    met = scratch.cut(lying.withColumn("lies", F.lit(True)).unionByName(probing.withColumn("lies", F.lit(False))))
    cells = met.groupBy("cell").agg(F.count("*").alias("members"), F.count_if("lies").alias("lying")).filter("members > 1 and lying > 0").select("cell", F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks"))
    met = met.join(cells, "cell").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("lo"), F.greatest(o, F.col("chunk")).alias("hi")))
    tasks = met.select("rep", "cell", "lies", "chunk", F.explode(pairs).alias("p"))
    tasks = tasks.select("rep", "cell", "lies", F.xxhash64("cell", "p.lo", "p.hi").alias("task"), F.when(F.col("p.lo") == F.col("p.hi"), 0).when(F.col("chunk") == F.col("p.lo"), 1).otherwise(2).alias("side"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = Cells(how, least, dtype)
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("task", "cell", "space", "lies", "side", "rep", "copies", "raw")), strict=True):
                if (found := waiting.add(row)) is not None:
                    yield found
        if (found := waiting.solve()) is not None:
            yield found

    grouped = tasks.join(coded.select("rep", "copies", "space", "raw"), "rep").repartition("task").sortWithinPartitions("task", "rep", F.col("lies").desc())
    found = scratch.cut(grouped.mapInArrow(compare, "a long, b long, links long"))
    scratch.drop(met, coded)
    reach = components(found.filter("a <> b").select("a", "b"), scratch)
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("more"))
    named = classes.select("h1", "h2", "rep", "least_id", "copies").join(links, "rep", "left").join(reach.withColumnRenamed("node", "rep"), "rep", "left")
    smallest = named.filter("component is not null").groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "component", "left").select("h1", "h2", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component_id", "least_id").alias("component"))
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
