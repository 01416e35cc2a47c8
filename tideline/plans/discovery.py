"""Queries over rules, exits and their nulls, insight rules, evidence, and gates in batch form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import discovery as X
from ..operators import equity as E
from ..operators import evidence as EV
from ..operators import gates as G
from ..operators import tape as T
from ..sources import tape as S
from ..sources import views as V
from .catalog import query, r
from .equity import j1_base_features

CAP = 8
FAVORABLE, ADVERSE, CAPS = [1.0, 2.0], [0.5, 1.0], [3, 8]
PERMUTATIONS, QUANTILE = 20, 0.95


def stored(s):
    def write(df):
        path = S.work_path(s)
        df.write.parquet(path)
        return s.read.schema(df.schema).parquet(path)

    return write


def marks(s, d):
    """Hourly bars around a level of 100, with the hour as a number and the symbol's volatility over consecutive hours."""
    h = V.hours(s, d).select("symbol", (F.unix_timestamp(F.col("h").cast("timestamp")) / 3600).cast("long").alias("t"), *((F.col(c) + 100).alias(c) for c in ("high", "low", "close")), "volume")
    w = Window.partitionBy("symbol").orderBy("t")
    vol = h.select("symbol", (F.col("close") / F.lag("close").over(w) - 1).alias("x")).groupBy("symbol").agg(F.stddev_pop("x").alias("vol"), F.count("x").alias("n")).filter("n >= 2").drop("n")
    return h.join(vol, "symbol")


def instances(s, d):
    """Hours of much volume that closed high, with their forward paths."""
    return X.continuation(marks(s, d), cap=CAP, step=1, entry=(F.col("volume") > 6) & (F.col("close") < 150)).filter("size(path) > 0").select("symbol", "t", "vol", "path")


def lifts(s, d):
    """Log range of the next five bars' closes about this one, less the symbol's mean; keys are texts."""
    h = V.hours(s, d)
    w = Window.partitionBy("symbol").orderBy("h").rowsBetween(1, 5)
    v = F.log1p(F.max("close").over(w)) + F.log1p(F.min("close").over(w)) - 2 * F.log1p("close")
    x = h.select("symbol", "h", v.alias("v")).filter("v is not null")
    mean = x.groupBy("symbol").agg(F.avg("v").alias("m"))
    return x.join(mean, "symbol").select(key_of().alias("key"), (F.col("v") - F.col("m")).alias("v"))


def key_of():
    return F.concat_ws("|", "symbol", F.date_format("h", "yyyyMMddHH"))


def held_atoms(s, d, bins):
    """The conditions that hold at each key; the cuts of a feature are few, so they go to all rows as one array a feature."""
    base = j1_base_features(s, d)
    name = F.concat_ws(" ", "feature", "op", F.format_string("%.9f", "cut"))
    cuts = E.quantile_atoms(base, bins).groupBy("feature").agg(F.collect_list(F.struct("op", "cut", name.alias("atom"))).alias("cuts"))
    holds = F.filter("cuts", lambda c: F.when(c.op == ">", F.col("value") > c.cut).otherwise(F.col("value") < c.cut))
    return base.join(cuts, "feature").select(key_of().alias("key"), "feature", F.explode(F.transform(holds, lambda c: c.atom)).alias("atom"))


def featured(s, d):
    return j1_base_features(s, d).filter("value is not null").select(key_of().alias("key")).distinct()


@query
def j8_permutation_null(s, d):
    """Single conditions by decile against the best of them on permuted lifts."""
    hits = X.permuted(X.pool(lifts(s, d), featured(s, d)), permutations=PERMUTATIONS).join(held_atoms(s, d, 10), "key").withColumnRenamed("atom", "rule")
    edges = stored(s)(X.rule_edges(hits, ["rule"], permutations=PERMUTATIONS, min_firing=20))
    bar = X.permutation_bar(edges, permutations=PERMUTATIONS, quantile=QUANTILE)
    return edges.crossJoin(F.broadcast(bar)).select("rule", "n", *r("edge", "null_bar"), (F.col("edge") > F.col("null_bar")).alias("survives"))


@query
def j9_depth_search(s, d):
    found = X.depth_search(lifts(s, d), held_atoms(s, d, 4), featured(s, d), stored(s), depth=3, permutations=PERMUTATIONS, quantile=QUANTILE)
    return found.select("depth", "rule", "n", *r("edge", "null_bar"))


@query
def j10_exit_scores(s, d):
    """Every exit of the grid on every instance that it resolves, in units of volatility."""
    return X.exit_scores(instances(s, d), X.exit_grid(FAVORABLE, ADVERSE, CAPS)).select("exit", "symbol", "t", "k", "reason", *r("raw", "normed"))


@query
def j11_exit_null(s, d):
    key = F.concat_ws("|", "symbol", F.col("t").cast("string"))
    x = X.exit_null(instances(s, d), X.exit_grid(FAVORABLE, ADVERSE, CAPS), key, permutations=PERMUTATIONS, quantile=QUANTILE)
    return x.select("exit", "n", *r("edge", "null_bar"), "survives")


@query
def j14_continuation(s, d):
    x = instances(s, d).select("symbol", "t", F.explode("path").alias("b"))
    return x.select("symbol", "t", "b.k", F.round("b.high", 6).alias("high"), F.round("b.low", 6).alias("low"), F.round("b.close", 6).alias("close"))


@query
def j15_trade_log(s, d):
    """Round trips of two rules, written in two passes; a trip that is known stays as it was."""
    x = X.exit_scores(instances(s, d), F.filter(X.exit_grid(FAVORABLE, ADVERSE, CAPS), lambda g: g.exit.isin(4, 17)))
    trips = x.select(F.col("exit").alias("rule"), "symbol", F.col("t").alias("entry_at"), (F.col("t") + F.col("k")).alias("exit_at"), "reason", *r("raw", "normed"))
    first = trips.filter("entry_at % 3 <> 0").withColumn("recorded", F.lit(1))
    return T.insert_ignore(first, trips.withColumn("recorded", F.lit(2)), keys=["rule", "symbol", "entry_at"])


SAID = (("merger_acquisition", "Signed a Definitive Agreement"), ("merger_acquisition", "A new logo"), ("earnings", "Press release attached"), ("earnings", "Press release: EPS of $2.10"), ("earnings", "A good year"), ("guidance", "Investor Day on Monday"), ("guidance", "Outlook raised"), ("guidance", "Nothing of note"), ("management_change", "Senior secured notes issued by the CEO"), ("management_change", "The annual salary of the CFO"), ("management_change", "Mr. A is chairman"), ("management_change", "New CEO and chairman"), ("management_change", "A vice president left"), ("management_change", "The president left"), ("management_change", "Joins the audit committee"), ("product_launch", "Phase 2 topline results"), ("product_launch", "A pillar in our long-term strategy"), ("regulatory", "Settled $40 million case"), ("regulatory", "Routine compliance"), ("partnership", ""))


@query
def h6_evidence_sufficiency(s, d):
    """Quotes by the order's key, as the given tables have none."""
    k = F.col("o_orderkey")
    said = F.element_at(F.array(*(F.struct(F.lit(a).alias("kind"), F.lit(b).alias("quote")) for a, b in SAID)), (k % len(SAID) + 1).cast("int"))
    note = F.when(k % 11 == 0, "[SKIP] no text").when(k % 13 == 0, "so [INVALID_QUOTE]").when(k % 17 != 0, "plain")
    x = V.table(s, d, "orders").select("o_orderkey", said.alias("x"), note.alias("note"), F.lit("old").alias("status"), (k % 2 == 0).alias("counts"), F.when(k % 3 != 0, k % 5 != 0).alias("model_counts"), F.when(k % 7 == 0, "mixed").when(k % 7 < 4, "bullish").when(k % 7 < 6, "bearish").alias("sentiment"))
    return EV.revalidate(x.select("*", "x.*")).select("o_orderkey", F.col("new_status").alias("status"), "reason", F.col("new_counts").alias("counts"))


@query
def l8_insight_rules(s, d):
    """Reviews and outcomes by the day's volume, as the given tables have none; sources are the kinds of event."""
    n = F.col("num")
    c = V.candidates(s, d).select("symbol", "d", "num", F.when(n % 4 == 0, "A").otherwise("B").alias("tier"), F.when(n % 3 != 0, (1 + n % 4).cast("double")).alias("useful"), F.when(n % 8 == 1, "weak_catalyst").when(n % 8 == 2, "overstated_case").when(n % 8 == 3, "missing_peer_context").when(n % 8 == 5, "stale_data").alias("flaw"), F.when(n % 9 == 0, "No Sector view").alias("lacks"), (n % 10 == 7).alias("rejected"))
    x = c.join(V.preds(s, d).select("symbol", "d", "ret"), ["symbol", "d"])
    runs = V.ticks(s, d).select(F.col("event_type").alias("source"), (F.col("event_id") % 5 < F.length("event_type") % 5).alias("failed"))
    return EV.insights(x, runs).select("category", "subject", "n", *r("value"), "severity")


@query
def i15_alert_throttle(s, d):
    """Alerts by tick, in batch form: the first, each change of severity or payload, and a repeat once six hours have gone since the last one sent."""
    t = V.ticks(s, d).groupBy("symbol", F.col("ts").cast("timestamp").alias("ts")).agg(F.max("event_id").alias("id"))
    severity = F.when(F.col("id") % 40 == 0, "page").when(F.col("id") % 40 < 20, "warn").otherwise("info")
    t = t.select("symbol", "ts", severity.alias("severity"), F.concat(F.lit("p"), F.floor(F.col("id") / 300) % 3).alias("payload"))
    return G.throttled(t, 6 * 3600, stored(s)).select("symbol", "severity", "payload", F.unix_micros("ts").alias("at"))


@query
def i16_cooldown_gate(s, d):
    """Signals by tick, in batch form: on a symbol and side at least four hours after the last one sent, if the position isn't held already. Positions
    follow from the hours, as the given tables have none."""
    t = V.ticks(s, d).select("symbol", F.when(F.col("maker"), "sell").otherwise("buy").alias("side"), F.col("ts").cast("timestamp").alias("ts"))
    h = V.hours(s, d).select("symbol", F.hour("h").alias("n"), F.unix_micros(F.col("h").cast("timestamp")).alias("a"))
    minutes = lambda n: (F.col("a") + n * 60_000_000).alias("b")
    held = h.filter("n % 6 = 0").select("symbol", F.lit("buy").alias("side"), "a", minutes(150)).unionByName(h.filter("n % 8 = 3").select("symbol", F.lit("sell").alias("side"), "a", minutes(90)))
    return G.cooled(t, held, 4 * 3600, stored(s)).select("symbol", "side", F.unix_micros("ts").alias("at"))


@query
def a15_tape_stream(s, d):
    """The tape of the ticks as a stream: written by day, read as an unbounded source until nothing is left, each batch stored under its number; then
    read back. The rows are those of the stored batches."""
    ticks = V.ticks(s, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", "price", "qty")
    tape, out = S.work_path(s), S.work_path(s)
    S.write_partitioned(ticks.withColumn("date", F.to_date("ts")), tape, ["date"], sort_by=["ts"], files=2)
    schema = ticks.withColumn("date", F.to_date("ts")).schema
    # a stream keeps no list of all its rows: what it does to a row depends on the row alone
    stream = S.tape_stream(s, tape, schema, files=16).select("symbol", "ts", "event_id", (F.col("price") * F.col("qty")).alias("notional"))
    S.store_batches(stream, out, S.work_path(s)).awaitTermination()
    return S.stored_batches(s, out, stream.schema).select("symbol", F.unix_micros("ts").alias("at"), "event_id", *r("notional"))
