"""Sharding by balanced label propagation.

Rows that share a link group (here: equal texts) are neighbours. Every row starts in a shard by a hash of itself. In each
round the shards vote within every group, each row learns the shard where most of its neighbours are, and rows move there as
far as the quotas of the shards, with some slack, allow; which ones move is decided by a hash of the group, so that neighbours move together
(by a hash of the row where a group is too large for one shard). At last the counts are made exact: full shards give rows away, unlinked ones first,
which fill the others in order. Law `rows`: the counts of any two shards differ by one at most.

All that comes to the driver is the number of rows by pair of shards (n_shards squared at most). Groups are never gathered:
votes are counts by group and shard, summed before the shuffle. Rows meet what is known of their group by a shuffle only where the
group has at most one in `LARGE` of all rows; the few larger groups, of which there are `LARGE` at most, are broadcast.

Defined results: null texts have no neighbours; repeated rows are neighbours as equal texts, and rows of one id with different texts are
placed apart; texts of any length count by their bytes and digest alone; ties go to the smaller shard, slots are in order of a hash of the
row; null ids are placed as others; with fewer rows than shards the last shards stay empty; extra columns don't matter; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, sieve, unit

LARGE = 1000
BUCKETS, BUCKET_ROWS = 64, 500_000


def buckets_of(rows: int, n_shards: int) -> int:
    """Buckets to order a shard in: `BUCKETS` at least, and so many that one has about `BUCKET_ROWS` rows."""
    return max(BUCKETS, -(-rows // (n_shards * BUCKET_ROWS)))


def spread(*cols: str) -> Column:
    """A hash of the columns, in which a null isn't skipped."""
    return F.xxhash64(*(x for c in cols for x in (F.col(c).isNull(), F.col(c))))


def _flow(wish: np.ndarray, count: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many may move from i to j: the wishes, cut until no shard ends above its room."""
    x = wish.astype(float)
    for _ in range(60):
        after = count - x.sum(1) + x.sum(0)
        over = np.maximum(0, after - room)
        if over.max(initial=0) < 1:
            break
        x *= np.maximum(0.0, 1 - over / np.maximum(1, x.sum(0)))[None, :]
    return x


def positions(df: DataFrame, by: str, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """A gapless number from 0 within each value of `by`, in order of bucket and then `order`. Buckets are counted and
    prefix-summed, so no task sorts more than a bucket of rows."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(by, "_bucket").count()
    ahead = F.sum("count").over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(by, "_bucket", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1
    return df.join(counts, [by, "_bucket"]).withColumn(name, (F.col("_ahead") + within).cast("long")).drop("_bucket", "_ahead")


def _with_groups(rows: DataFrame, group: str, total: int, scratch: Scratch) -> DataFrame:
    """Adds linked (the group, where it has two rows or more) and members."""
    sizes = scratch.cut(rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("linked")).agg(F.count("*").alias("members")).filter("members > 1"))
    hot = F.broadcast(sizes.filter(F.col("members") > total // LARGE))  # at most LARGE groups
    rest = sizes.filter(F.col("members") <= total // LARGE)
    met = rows.join(hot, F.col(group) == F.col("linked"), "left")
    others, ids = met.filter("linked is null").select(*rows.columns), rest.select(F.col("linked").alias("id"))
    maybe = sieve(others, ids, group).join(rest, F.col(group) == F.col("linked"), "left")
    alone = sieve(others, ids, group, inside=False).withColumns({"linked": F.lit(None).cast(rows.schema[group].dataType), "members": F.lit(None).cast("long")})
    out = scratch.cut(met.filter("linked is not null").unionByName(maybe).unionByName(alone))
    scratch.drop(sizes)
    return out


def _counts(*tables: DataFrame, n_shards: int) -> np.ndarray:
    count = np.zeros(n_shards, int)
    for t in tables:
        for s, n in t.groupBy("shard").count().collect():
            count[s] += n
    return count


def propagate(rows: DataFrame, n_shards: int, *, group: str = "group", rounds: int = 4, slack: float = 0.5, order: tuple[str, ...] = ("doc_id",), scratch: Scratch | None = None) -> DataFrame:
    """Adds `shard` to rows whose column `group` (null: no neighbours) links them. Only linked rows take part in the rounds."""
    scratch = scratch or Scratch(rows.sparkSession)
    total = rows.count()
    start = F.pmod(F.xxhash64(spread(*order), F.lit(5)), F.lit(n_shards)).cast("int")
    every = scratch.cut(_with_groups(rows, group, total, scratch).withColumn("shard", start))
    alone, now = every.filter("linked is null"), every.filter("linked is not null")
    quota = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)])
    fixed, large = _counts(alone, n_shards=n_shards), F.col("members") > total // LARGE
    # rows of a group move together, unless it is more than a shard's share can take
    mates = F.when(F.col("members") <= max(1, total // n_shards // 4), F.xxhash64("linked")).otherwise(F.xxhash64(F.col("linked"), spread(*order)))
    for step in range(rounds):
        count = fixed + _counts(now, n_shards=n_shards)
        full = [s for s in range(n_shards) if count[s] >= quota[s] * (1 + slack)] if step else []
        votes = now.groupBy("linked", "shard").agg(F.count("*").alias("votes"), F.first("members").alias("members"))
        votes = votes.withColumn("open", ~F.col("shard").isin(full) if full else F.lit(True))
        # to an open shard with most votes; of equals, to the smallest
        best = votes.groupBy("linked").agg(F.max(F.when(F.col("open"), F.struct("votes", (-F.col("shard")).alias("neg")))).alias("best"))
        best = best.select("linked", F.col("best.votes").alias("best_votes"), (-F.col("best.neg")).alias("best_shard"))
        here = votes.select("linked", "shard", "members", F.col("votes").alias("here_votes"))
        moves = here.join(best, "linked").filter((F.col("best_shard") != F.col("shard")) & ((F.col("best_votes") > F.col("here_votes")) | ((F.col("best_votes") == F.col("here_votes")) & (F.col("best_shard") < F.col("shard")))))
        asked = scratch.cut(moves.select(F.col("linked").alias("m_linked"), F.col("shard").alias("m_shard"), "best_shard", "here_votes", "members"))
        wish = np.zeros((n_shards, n_shards))
        for i, j, n in asked.groupBy("m_shard", "best_shard").agg(F.sum("here_votes")).collect():
            wish[i, j] = n
        if not wish.any():
            scratch.drop(asked)
            break
        flow = _flow(wish, count, quota * (1 + slack))
        share = np.divide(flow, wish, out=np.zeros_like(flow), where=wish > 0)
        allowed = F.array(*(F.lit(float(x)) for x in share.ravel()))
        goes = F.col("best_shard").isNotNull() & (unit(mates, F.lit(step)) < F.element_at(allowed, (F.col("shard") * n_shards + F.col("best_shard") + 1).cast("int")))
        same = (F.col("linked") == F.col("m_linked")) & (F.col("shard") == F.col("m_shard"))
        # rows of large groups meet the few wishes of those by broadcast, so that no task gets such a group
        parts = [now.filter(which).join(wishes.drop("members"), same, "left") for which, wishes in ((large, F.broadcast(asked.filter(large))), (~large, asked.filter(~large)))]
        moved = scratch.cut(parts[0].unionByName(parts[1]).withColumn("shard", F.when(goes, F.col("best_shard")).otherwise(F.col("shard"))).select(*now.columns))
        scratch.drop(now, asked)
        now = moved
    return _even(alone.unionByName(now), n_shards, quota, order, scratch).drop("linked", "members")


def _even(now: DataFrame, n_shards: int, quota: np.ndarray, order: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """Moves rows from shards above their quota to those below."""
    count = _counts(now, n_shards=n_shards)
    excess, gap = np.maximum(0, count - quota), np.maximum(0, quota - count)
    if not excess.any():
        return now
    n = buckets_of(int(count.sum()), n_shards)
    # unlinked rows first, then the mates of a group side by side; both dealt over many buckets
    large = F.col("members") > max(64, int(quota.max(initial=0)) // n)
    bucket = F.when(F.col("linked").isNull(), F.pmod(spread(*order), F.lit(n))).when(large, 2 * n + F.pmod(F.xxhash64(F.col("linked"), spread(*order)), F.lit(n))).otherwise(n + F.pmod(F.xxhash64("linked"), F.lit(n)))
    ranked = positions(now, "shard", bucket, [F.col("linked"), *map(F.col, order)], "_at")
    lit = lambda xs: F.array(*(F.lit(int(x)) for x in xs))
    place = F.element_at(lit(np.cumsum(excess) - excess), F.col("shard") + 1) + F.col("_at")
    ends = lit(np.cumsum(gap))
    to = F.size(F.filter(ends, lambda e: e <= place))
    gives = F.col("_at") < F.element_at(lit(excess), F.col("shard") + 1)
    return ranked.withColumn("shard", F.when(gives, to).otherwise(F.col("shard")).cast("int")).drop("_at")


def op8(spark: SparkSession, docs: DataFrame, n_shards: int = 24) -> DataFrame:
    scratch, raw = Scratch(spark), F.col("text").cast("binary")
    rows = scratch.cut(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).alias("text_crc32"), F.md5(raw).alias("group")))
    order = ("doc_id", "text_crc32", "size")
    placed = scratch.cut(propagate(rows, n_shards, order=order, scratch=scratch))
    slots = positions(placed, "shard", F.pmod(F.xxhash64(spread(*order), F.lit(3)), F.lit(buckets_of(placed.count(), n_shards))), list(map(F.col, order)), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
