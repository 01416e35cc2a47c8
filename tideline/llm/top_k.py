"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments, of which the mean and the deviation are known, first few long segments, then more short ones.
Over a segment of n components the squared distance of two vectors is at least n * ((m1 - m2)^2 + (d1 - d2)^2), so that with the
norms known the inner product is at most the sum of n * (m1 * m2 + d1 * d2).

Candidates are put in blocks of similar coarse statistics: each joins the nearest of `PIVOTS` centres at most, fitted on the statistics
of `SAMPLE` rows. Of each block only the number of rows and the range of each statistic are gathered; from them follows a bound on
every inner product of a query with the block. A query first visits the blocks of the best bounds, until they hold enough
candidates, which gives a k-th score to beat; then all other blocks whose bound reaches that score, and no others. Only for these
pairs of query and block the query's vector is sent; a candidate's vector is sent once for each `ASKED` queries of its block.
Within a block the same goes on by rows, coarse to fine: candidates whose coarse bound is below the score to beat drop out, then
those whose fine bound is, and the survivors are scored exactly in integers.

A block of any size is cut into chunks of about `CANDIDATES` rows, and queries stream past a chunk, so a task's memory is bounded.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do those of other lengths than
the query's; ties go to the smaller id; fewer candidates than k give fewer rows; rows with the query's id aren't its candidates.
Repeated candidates count as often as they occur; queries of one id with equal vectors are one query, with different vectors each
has k rows of its own under that id. Components and scores beyond 64 bits are held at the largest or least long. Extra columns don't matter; no rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, unit

CANDIDATES, ASKED, BATCH, SEGMENTS = 16384, 65536, 1024, (4, 16)
PIVOTS, BLOCK_ROWS, SAMPLE = 1024, 2048, 16384
STATS, LEAST = 2 * SEGMENTS[0], -(1 << 63)


def finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0), F.lit(False))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that the product of two rows bounds the inner product from above."""
    width = -(-x.shape[1] // segments)
    padded = np.zeros((len(x), width * segments))
    padded[:, : x.shape[1]] = x
    cut = padded.reshape(len(x), segments, width)
    return np.hstack([cut.mean(2), cut.std(2)]) * np.sqrt(width)


def vectors_of(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Block:
    """Candidates of one length, with their statistics."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.most = ids, x, max(abs(int(x.max())), abs(int(x.min())))
        self.levels = [statistics(x, s) for s in SEGMENTS]
        self.norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max(initial=0))
        self.doubles = x.astype(np.float64)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles below 2^53, in longs below 2^63, else in whole numbers of any size, held at a long's bounds."""
        bound = len(q) * max(1, self.most) * max(1, max(abs(int(q.max())), abs(int(q.min()))))
        if bound < 1 << 53:
            return np.rint(self.doubles[rows] @ q.astype(np.float64)).astype(np.int64)
        if bound < 1 << 63:
            return self.x[rows] @ q
        return np.array([max(LEAST, min(-LEAST - 1, s)) for s in (self.x[rows].astype(object) @ q.astype(object)).tolist()], np.int64)

    def search(self, own: int, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k candidates but those below `least`."""
        stats = [statistics(q[None, :], s)[0] for s in SEGMENTS]
        slack = 1e-9 * self.norm * float(np.sqrt((q.astype(np.float64) ** 2).sum())) + 1e-6
        live = np.flatnonzero(self.ids != own)
        for mine, asked in zip(self.levels, stats, strict=True):
            bound = mine[live] @ asked
            if len(live) > 4 * k:
                best = live[np.argpartition(-bound, 4 * k)[: 4 * k]]
                score = self.scores(best, q)
                score = int(np.partition(score, len(score) - k)[len(score) - k])
                least = max(least, float(score)) if score > LEAST else least
            keep = bound + slack >= least
            live = live[keep]
        score = self.scores(live, q)
        order = np.lexsort((self.ids[live], ~score))[:k]  # ~s falls as s rises, and has no overflow
        return self.ids[live[order]], score[order]


def nearest(stats: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    square = (found**2).sum(1)
    return np.concatenate([(square - 2 * stats[at : at + 4096] @ found.T).argmin(1) for at in range(0, len(stats), 4096)] or [np.zeros(0, np.int64)])


def centres(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres at most of the statistics, by a few rounds of means."""
    found = np.unique(sample, axis=0)
    if not len(found):
        return found
    out = found[np.linspace(0, len(found) - 1, min(n, len(found))).astype(int)]
    for _ in range(5):
        near = nearest(sample, out)
        out = np.stack([sample[near == i].mean(0) if (near == i).any() else out[i] for i in range(len(out))])
    return out


class Summary:
    """Of each block its length of vectors, rows, and the range of each statistic: PIVOTS rows at most for each length."""

    def __init__(self, rows: list):
        self.block = np.array([r["block"] for r in rows], np.int64)
        self.length, self.count = np.array([r["length"] for r in rows]), np.array([r["n"] for r in rows])
        self.low = np.array([[r[f"lo{i}"] for i in range(STATS)] for r in rows]).reshape(-1, STATS)
        self.high = np.array([[r[f"hi{i}"] for i in range(STATS)] for r in rows]).reshape(-1, STATS)
        self.norm = np.array([r["norm"] for r in rows])

    def visits(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The blocks of the query's length, best bound first, their bounds, and which of them are visited first."""
        of = np.flatnonzero(self.length == len(q))
        s = statistics(q[None, :], SEGMENTS[0])[0]
        bound = np.maximum(self.low[of] * s, self.high[of] * s).sum(1)
        bound += 1e-9 * self.norm[of] * float(np.sqrt((q.astype(np.float64) ** 2).sum())) + 1e-6
        order = np.argsort(-bound, kind="stable")
        of, bound = of[order], bound[order]
        before = np.cumsum(self.count[of]) - self.count[of]
        return self.block[of], bound, before < 4 * k + 1


PAIRS = "q long, query_id long, v array<long>, least double, block long"


def _pairs(queries: DataFrame, summary: Summary, k: int, *, first: bool) -> DataFrame:
    """The pairs of query and block to visit; after the first visits, those whose bound reaches `least`."""
    sent = queries.sparkSession.sparkContext.broadcast(summary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                rows, blocks = [], []
                for i, (v, least) in enumerate(zip(vectors_of(b.column("v")), b.column("least").to_pylist(), strict=True)):
                    block, bound, soon = sent.value.visits(v, k)
                    go = block[soon if first else ~soon & (bound >= (-np.inf if least is None else least))]
                    rows.append(np.full(len(go), i))
                    blocks.append(go)
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("q", "query_id", "v", "least")), pa.array(np.concatenate(blocks))], names=["q", "query_id", "v", "least", "block"])

    return queries.mapInArrow(run, PAIRS)


def _visit(pairs: DataFrame, coded: DataFrame, k: int) -> DataFrame:
    """(q, query_id, vec_id, score): the best k of each pair of query and chunk of a block."""
    asked = pairs.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("salts"))
    sizes = coded.groupBy("block").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("chunks"))
    tasks = asked.join(sizes, "block")  # one row a block
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = coded.join(tasks, "block").select("block", F.pmod(F.xxhash64("id", "v"), F.col("chunks")).cast("int").alias("chunk"), every("salts").alias("salt"), F.lit(False).alias("asks"), F.col("id"), "v", F.lit(None).cast("long").alias("q"), F.lit(None).cast("double").alias("least"))
    left = pairs.join(tasks, "block").select("block", every("chunks").alias("chunk"), F.pmod(F.xxhash64("q"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "v", "q", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, vectors, block, waiting = None, [], [], None, []

        def solved() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if block is None and ids and waiting:
                block = Block(np.array(ids, np.int64), np.stack(vectors))
            if block is not None and waiting:
                out = [(q, i, *block.search(i, v, k, -np.inf if least is None else least)) for q, i, v, least in waiting]
                cols = [np.concatenate([np.full(len(got), x) for x, _, got, _ in out]), np.concatenate([np.full(len(got), x) for _, x, got, _ in out]), np.concatenate([got for _, _, got, _ in out]), np.concatenate([s for *_, s in out])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["q", "query_id", "vec_id", "score"])
            waiting.clear()

        for b in batches:
            names = [b.column(c).to_pylist() for c in ("block", "chunk", "salt", "asks", "id", "q", "least")]
            for n, c, s, asks, i, q, least, v in zip(*names, vectors_of(b.column("v")), strict=True):
                if (n, c, s) != task:
                    yield from solved()
                    task, ids, vectors, block = (n, c, s), [], [], None
                if asks:
                    waiting.append((q, i, v, least))
                    if len(waiting) >= BATCH:
                        yield from solved()
                else:
                    ids.append(i)
                    vectors.append(v)
        yield from solved()

    dealt = right.unionByName(left).repartition("block", "chunk", "salt").sortWithinPartitions("block", "chunk", "salt", "asks")
    return dealt.mapInArrow(run, "q long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, vec_id, score). Both tables: (id long, v array of long)."""
    scratch = Scratch(queries.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch], found: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats, norms, near = np.zeros((b.num_rows, STATS)), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            by_length: dict[int, list[int]] = {}
            vectors = vectors_of(b.column("v"))
            for i, v in enumerate(vectors):
                by_length.setdefault(len(v), []).append(i)
            for rows in by_length.values():
                x = np.stack([vectors[i] for i in rows]).astype(np.float64)
                stats[rows], norms[rows] = statistics(x, SEGMENTS[0]), np.sqrt((x * x).sum(1))
            near = near if found is None else nearest(stats, found)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(stats.tolist(), pa.list_(pa.float64())), pa.array(norms), pa.array(near)], names=["id", "v", "stats", "norm", "pivot"])

    kind = "id long, v array<long>, stats array<double>, norm double, pivot long"
    m = candidates.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, m))
    sample = candidates.filter(unit(F.col("id"), F.lit(29)) <= share).mapInArrow(lambda bs: describe(bs, None), kind).select("stats").limit(SAMPLE).collect()
    pivots = centres(np.array([r["stats"] for r in sample]).reshape(-1, STATS), max(1, min(PIVOTS, m // BLOCK_ROWS)))
    if not len(pivots):
        pivots = np.zeros((1, STATS))
    coded = scratch.cut(candidates.mapInArrow(lambda bs: describe(bs, pivots), kind).withColumn("length", F.size("v")).withColumn("block", F.col("length").cast("long") * PIVOTS + F.col("pivot")))
    ranges = [f(F.element_at("stats", i + 1)).alias(f"{n}{i}") for i in range(STATS) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    summary = Summary(coded.groupBy("block").agg(F.first("length").alias("length"), F.count("*").alias("n"), F.max("norm").alias("norm"), *ranges).collect())
    asked = queries.dropDuplicates(["id", "v"]).select(F.xxhash64("id", "v").alias("q"), F.col("id").alias("query_id"), "v")
    rows = coded.select("block", "id", "v")
    first = scratch.cut(_best(_visit(_pairs(asked.withColumn("least", F.lit(None).cast("double")), summary, k, first=True), rows, k), k))
    beat = first.groupBy("q", "query_id").agg(F.when((F.count("*") >= k) & (F.min("score") > LEAST), F.min("score").cast("double")).alias("least"))
    later = _pairs(asked.join(beat, ["q", "query_id"], "left").select("q", "query_id", "v", "least"), summary, k, first=False)
    both = first.drop("rank").unionByName(_visit(scratch.cut(later), rows, k))
    return _best(both, k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, *, scale: int = 1024) -> DataFrame:
    """(id, v) with components floor(scale * x) as long, of the rows that take part."""
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(finite(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), whole.alias("v"))


def op4(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    rows = quantised(vectors)
    return top_k(rows.filter("id % 100 = 0"), rows)
