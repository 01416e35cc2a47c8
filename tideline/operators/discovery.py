"""Rules over features, their forward paths and exits, and nulls by permutation. Permutations and coins come from digests of the keys, so
that reruns agree and SQL can repeat them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXITS = "array<struct<exit: int, tp: double, sl: double, cap: int>>"


def fired(features: DataFrame, rules: dict[int, list[tuple[str, str, float]]], keys: list[str]) -> DataFrame:
    """(rule, keys) where all conditions (feature, > or <, cut) of a rule hold; an absent feature never does. One column a rule and no
    shuffle: only rules that fire become rows."""
    one = lambda f, op, cut: (F.col(f) > cut) if op == ">" else (F.col(f) < cut)
    hit = [F.when(reduce(Column.__and__, (one(*c) for c in conditions)), F.lit(rule)) for rule, conditions in rules.items()]
    return features.select(F.explode(F.array_compact(F.array(*hit))).alias("rule"), *keys)


def continuation(marks: DataFrame, *, cap: int, step: int, entry: Column | None = None) -> DataFrame:
    """marks (symbol, t in whole steps, high, low, close): `path`, the next `cap` marks relative to this one's close, up to the first that
    is missing. Marks are dealt by symbol and stretch of time, each also to the stretch before its own, so that no task holds a whole
    symbol; a path is an array of `cap` entries at most. With `entry`, only the rows where it holds are returned."""
    span = 64 * cap * step
    own = F.floor(F.col("t") / span)
    x = marks.withColumn("_own", F.lit(True) if entry is None else F.coalesce(entry, F.lit(False)))
    x = x.withColumn("_at", F.explode(F.array(own, own - 1))).withColumn("_own", F.col("_own") & (F.col("_at") == own))
    w = Window.partitionBy("symbol", "_at").orderBy("t").rangeBetween(step, cap * step)
    x = x.withColumn("_next", F.collect_list(F.struct("t", "high", "low", "close")).over(w)).filter("_own and close <> 0")
    # times rise strictly: an entry that stands where it would without gaps has none before it
    whole = F.filter("_next", lambda m, i: m.t == F.col("t") + (i + 1) * step)
    rel = F.transform(whole, lambda m, i: F.struct((i + 1).cast("int").alias("k"), (m.high / F.col("close")).alias("high"), (m.low / F.col("close")).alias("low"), (m.close / F.col("close")).alias("close")))
    return x.withColumn("path", rel).drop("_own", "_at", "_next")


def exit_grid(favorable: list[float], adverse: list[float], caps: list[int]) -> Column:
    """Every cap with every target and stop in multiples of volatility, each also without."""
    cells = [(tp, sl, cap) for cap in caps for tp in (None, *favorable) for sl in (None, *adverse)]
    return F.array(*(F.struct(F.lit(i).alias("exit"), F.lit(tp).cast("double").alias("tp"), F.lit(sl).cast("double").alias("sl"), F.lit(cap).alias("cap")) for i, (tp, sl, cap) in enumerate(cells)))


def round_trip(path: Column, vol: Column, g: Column) -> Column:
    """(k, reason, raw, normed) of the first bar that touches the stop or the target, the stop first; else the close at the cap; null where the
    path ends before, or volatility isn't positive."""
    stop, target = 1 - g.sl * vol, 1 + g.tp * vol
    stopped, reached = lambda b: F.coalesce(b.low <= stop, F.lit(False)), lambda b: F.coalesce(b.high >= target, F.lit(False))
    hit = F.get(F.filter(path, lambda b: (b.k <= g.cap) & (stopped(b) | reached(b) | (b.k == g.cap))), F.lit(0))
    raw = F.when(stopped(hit), stop - 1).when(reached(hit), target - 1).otherwise(hit.close - 1)
    reason = F.when(stopped(hit), "stop").when(reached(hit), "target").otherwise("time_cap")
    return F.when((vol > 0) & hit.isNotNull(), F.struct(hit.k.alias("k"), reason.alias("reason"), raw.alias("raw"), (raw / vol).alias("normed")))


def exit_scores(instances: DataFrame, grid: Column) -> DataFrame:
    """instances (..., path, vol): a row for each exit of the grid that the path resolves."""
    x = instances.withColumn("g", F.explode(grid)).withColumn("x", round_trip(F.col("path"), F.col("vol"), F.col("g")))
    return x.filter("x is not null").select(*(c for c in instances.columns if c != "path"), "g.*", "x.*")


def coins(key: Column, permutations: int) -> Column:
    """A coin a permutation, from the digest of key and number."""
    return F.transform(F.sequence(F.lit(1), F.lit(permutations)), lambda p: F.substring(F.md5(F.concat_ws("|", key, p.cast("string")).cast("binary")), 1, 1) < "8")


def null_bar(bests: Column, quantile: float) -> Column:
    """The entry at round(q * (n - 1)) of the sorted bests, halves to even."""
    return F.get(F.array_sort(bests), F.bround(quantile * (F.size(bests) - 1)).cast("int"))


def exit_null(instances: DataFrame, grid: Column, key: Column, *, permutations: int = 200, quantile: float = 0.95, min_firing: int = 20) -> DataFrame:
    """The best exit by mean normed return, and the bar that it must beat: in each permutation a coin mirrors each path about its start, and
    the best mean of the grid counts. A path is scored as it is and mirrored, once each: permutations only add sums to one aggregate."""
    mirrored = F.transform("path", lambda b: F.struct(b.k.alias("k"), (2 - b.low).alias("high"), (2 - b.high).alias("low"), (2 - b.close).alias("close")))
    x = instances.withColumns({"_coins": coins(key, permutations), "_mirrored": mirrored}).withColumn("g", F.explode(grid))
    own, other = (round_trip(F.col(p), F.col("vol"), F.col("g")).normed for p in ("path", "_mirrored"))
    x = x.select("g.exit", "_coins", own.alias("own"), other.alias("other"))
    picked = [F.when(F.get("_coins", F.lit(p)), F.col("other")).otherwise(F.col("own")) for p in range(permutations)]
    y = x.groupBy("exit").agg(F.count("own").alias("n"), F.avg("own").alias("edge"), F.array(*(F.when(F.count(c) >= min_firing, F.avg(c)) for c in picked)).alias("null"))
    bests = [F.coalesce(F.max(F.get("null", F.lit(p))), F.lit(float("-inf"))) for p in range(permutations)]
    real = F.when(F.col("n") >= min_firing, F.struct("edge", (-F.col("exit")).alias("at"), "n"))
    z = y.agg(F.max(real).alias("best"), null_bar(F.array(*bests), quantile).alias("null_bar")).filter("best is not null")
    return z.select((-F.col("best.at")).alias("exit"), "best.edge", "best.n", "null_bar", (F.col("best.edge") > F.col("null_bar")).alias("survives"))


def positions(df: DataFrame, by: str, digest: str, *, digits: int = 3) -> DataFrame:
    """`at`, the rank from 1 by a hex digest within `by`, without one task for all rows: ranks within the digest's first digits, on top of
    the counts of those before. More digits make smaller groups."""
    x = df.withColumn("_head", F.substring(digest, 1, digits))
    w = Window.partitionBy(by).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy(by, "_head").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(by, "_head").orderBy(digest))
    return x.withColumn("_rank", rank).join(before.drop("_n"), [by, "_head"]).withColumn("at", F.col("_before") + F.col("_rank")).drop("_head", "_rank", "_before")


def permuted(values: DataFrame, *, permutations: int) -> DataFrame:
    """values (key, v), keys once each: (key, v, shuffled), `shuffled` holding for each permutation the value that the key gets there. The
    key at some place of a permutation's order gets the value of the key at that place of order 0."""
    x = values.select("key", "v", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("p"))
    x = positions(x.withColumn("_digest", F.md5(F.concat_ws("|", "key", F.col("p").cast("string")).cast("binary"))), "p", "_digest")
    # at one place all orders meet: order 0 brings the value
    met = x.groupBy("at").agg(F.max(F.when(F.col("p") == 0, F.col("v"))).alias("v0"), F.collect_list(F.when(F.col("p") > 0, F.struct("p", "key"))).alias("to"))
    to = met.select("v0", F.explode("to").alias("t")).groupBy("t.key").agg(F.array_sort(F.collect_list(F.struct("t.p", "v0"))).alias("s"))
    return values.join(to.select("key", F.col("s.v0").alias("shuffled")), "key")


def rule_edges(hits: DataFrame, keys: list[str], *, permutations: int, min_firing: int) -> DataFrame:
    """hits (keys, v, shuffled), a row where a rule fired: n, edge and the mean under each permutation, of rules that fired often enough."""
    sums = F.array(*(F.avg(F.get("shuffled", F.lit(p))) for p in range(permutations)))
    return hits.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("edge"), sums.alias("null")).filter(F.col("n") >= min_firing)


def permutation_bar(edges: DataFrame, *, permutations: int, quantile: float) -> DataFrame:
    """One row: the bar, over the best rule of each permutation. No rule, no row."""
    bests = F.array(*(F.max(F.get("null", F.lit(p))) for p in range(permutations)))
    return edges.agg(null_bar(bests, quantile).alias("null_bar"), F.count("*").alias("n_scorable")).filter("n_scorable > 0")


def pool(values: DataFrame, featured: DataFrame) -> DataFrame:
    """The values which may be permuted: those of keys that have features (`featured`: key), whether or not an atom holds there. A value
    on which no rule can fire must not move the bar."""
    return values.join(featured.select("key"), "key", "left_semi")


def depth_search(values: DataFrame, atoms: DataFrame, featured: DataFrame, write, *, depth: int = 4, permutations: int = 200, quantile: float = 0.95, min_firing: int = 20) -> DataFrame:
    """values (key, v), atoms (key, feature, atom), an atom being the text of a condition that holds there, featured (key): which keys have
    features at all, as only those are permuted. Rules that beat the bar of their
    depth get one further atom of another feature. `write` stores a table and reads it back: what the depths share, and each depth's survivors,
    so that no depth computes an earlier one again. Returns (depth, rule, n, edge, null_bar), a rule being its atoms in their order."""
    held = atoms.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("atom", "feature"))).alias("atoms"))
    base = write(permuted(pool(values, featured), permutations=permutations).join(held, "key"))
    hits, found = base.select("*", F.array().cast("array<struct<atom: string, feature: string>>").alias("parent")), []
    text = lambda c: F.concat_ws(" & ", F.transform(c, lambda a: a.atom))
    for level in range(1, depth + 1):
        free = F.filter("atoms", lambda a: ~F.exists("parent", lambda b: b.feature == a.feature))
        hits = hits.select("*", F.explode(free).alias("a")).withColumn("whole", F.array_sort(F.array_append("parent", F.col("a")))).drop("a")
        # a rule reached from several parents fires on the same rows each time: one of them counts
        edges = rule_edges(hits.withColumns({"rule": text("whole"), "from": text("parent")}), ["rule", "from"], permutations=permutations, min_firing=min_firing)
        edges = edges.groupBy("rule").agg(F.min(F.struct("from", "n", "edge", "null")).alias("e")).select("rule", "e.*")
        bar = permutation_bar(edges, permutations=permutations, quantile=quantile)
        kept = write(edges.crossJoin(F.broadcast(bar)).filter("edge > null_bar").select(F.lit(level).alias("depth"), "rule", "from", "n", "edge", "null_bar"))
        found.append(kept.drop("from"))
        # the rows of the survivors, from the parent that counted
        hits = hits.withColumns({"rule": text("whole"), "from": text("parent")}).join(kept.select("rule", "from"), ["rule", "from"], "left_semi").select(*base.columns, F.col("whole").alias("parent"))
    return reduce(DataFrame.unionByName, found)


def confirmation(lifts: DataFrame, bars: dict[int, float], promoted: list[int], *, enough: int = 30, z: float = 2.0) -> DataFrame:
    """lifts (rule, v) of instances after the frontier: n, mean, t and verdict. A candidate waits, is promoted or rejected; a promoted rule
    is kept or, once its mean is no longer above zero and its bar, decayed. Without spread t is infinite with the mean's sign."""
    y = lifts.groupBy("rule").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    t = F.when(F.col("sd") == 0, F.when(F.col("mean") == 0, 0.0).otherwise(F.signum("mean") * float("inf"))).otherwise(F.col("mean") / (F.col("sd") / F.sqrt("n")))
    bar = F.coalesce(*(F.when(F.col("rule") == k, F.lit(v)) for k, v in bars.items()), F.lit(0.0))
    good = (F.col("mean") > 0) & (F.col("mean") > bar)
    live = F.when((F.col("n") >= enough) & ~good, "decayed").otherwise("kept")
    fresh = F.when(F.col("n") < enough, "wait").when(good & (F.col("t") >= z), "promote").otherwise("reject")
    return y.withColumn("t", t).withColumn("verdict", F.when(F.col("rule").isin(*promoted), live).otherwise(fresh))
