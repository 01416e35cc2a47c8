"""Queries over bars (continued), hourly features, and window summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import bars as B
from ..operators import intraday as I
from ..operators import quotes as QT
from ..operators import tape as T
from ..operators.frames import deal, framed, gather, in_block
from ..sources import views as V
from .catalog import query, r


def by():
    return Window.partitionBy("symbol").orderBy("d")


@query
def e8_rsi_seeded(s, d):
    return B.rsi_seeded(V.bars(s, d)).select("symbol", "d", *r("rsi", digits=5))


@query
def e9_rsi_ewm(s, d):
    return B.rsi_ewm(V.bars(s, d)).select("symbol", "d", *r("rsi", digits=5))


@query
def e15_day_place(s, d):
    return B.day_place(V.hours(s, d), "h").select("symbol", "h", *r("day_place", "prior_range"))


@query
def e17_forward_pips(s, d):
    return B.forward_excursion(V.bars(s, d), [24, 48], 1.0).select("symbol", "d", *r("up_24", "down_24", "net_24", "up_48", "down_48", "net_48", digits=7))


@query
def e28_macro_trend(s, d):
    x = V.filings(s, d).filter("form in ('8-K', '10-Q')").groupBy("form", F.trunc("filing_date", "month").alias("month")).agg(F.count("*").alias("v"))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("form").orderBy(F.col("month").desc()))).filter("k <= 2")
    y = x.groupBy("form").agg(F.max(F.when(F.col("k") == 1, F.col("v"))).alias("last"), F.max(F.when(F.col("k") == 2, F.col("v"))).alias("prior"))
    return y.select("form", "last", "prior", F.when(F.col("last") > F.col("prior"), "rising").when(F.col("last") < F.col("prior"), "falling").when(F.col("prior").isNotNull(), "flat").alias("trend"))


@query
def e30_funding_stats(s, d):
    x = V.ticks(s, d).filter("event_type = 'view'").groupBy("symbol", F.to_date("ts").alias("d")).agg(F.avg("price").alias("rate"))
    over = lambda f, n: f("rate").over(in_block().rowsBetween(1 - n, 0))
    cols = {"avg_3": over(F.avg, 3), "avg_7": over(F.avg, 7), "m": over(F.avg, 30), "sd": over(F.stddev_samp, 30)}
    x = framed(x, lambda x: x.withColumns(cols), before=29)
    return x.select("symbol", "d", *r("avg_3", "avg_7"), F.round(C.safe_ratio(F.col("rate") - F.col("m"), F.col("sd")), 6).alias("z"))


@query
def e31_oi_changes(s, d):
    x = B.lag_returns(deal(V.bars(s, d), before=7), [1])
    step = {f"change_{k}": C.safe_ratio(F.col("volume"), F.lag("volume", k).over(in_block())) - 1 for k in (1, 3, 7)}
    x = gather(x.withColumns(step)).withColumn("divergence", F.col("change_1") - F.col("ret_1"))
    return x.select("symbol", "d", *r("change_1", "change_3", "change_7", "divergence"))


@query
def e35_plausibility(s, d):
    """Volumes, ranges and counts of trades that are low by the median before, and days on which over 30 % of at least five symbols
    have a low volume."""
    x = V.bars(s, d).select("symbol", "d", "volume", "trades", (F.col("high") - F.col("low")).alias("reach"))
    x = deal(x, before=20)
    for value in ("reach", "trades"):
        x = B.plausible(x, value).withColumnRenamed("low", f"low_{value}")
    x = gather(B.plausible(x, "volume"))
    day = Window.partitionBy("d")
    many = (F.count("low").over(day) >= 5) & (F.count_if(F.col("low")).over(day) > 0.3 * F.count("low").over(day))
    return x.select("symbol", "d", *r("median_before"), "low", "low_reach", "low_trades", many.alias("systemic"))


@query
def e39_accumulation_start(s, d):
    gain = C.safe_ratio(F.lead("close", 4).over(in_block()), F.col("close")) - 1
    x = framed(V.bars(s, d), lambda x: x.withColumn("gain", gain), after=4)
    return x.filter("gain >= 0.05").groupBy("symbol", F.year("d").alias("year")).agg(F.min("d").alias("first_day"), F.round(F.min_by("gain", "d"), 6).alias("gain"))


@query
def e40_window_return(s, d):
    x = B.lag_returns(V.bars(s, d), [1]).withColumn("small", F.col("ret_1") / 100)
    return x.filter("small > -1").groupBy("symbol", F.trunc("d", "month").alias("month")).agg(F.round(F.exp(F.sum(F.log1p("small"))) - 1, 6).alias("ret"))


@query
def e43_outcome_complete(s, d):
    return B.outcome_within(V.bars(s, d), 10, 8).select("symbol", "d", *r("best", "worst"))


@query
def e44_walk_forward_folds(s, d):
    in_test = V.bars(s, d).groupBy(F.trunc("d", "month").alias("test_start")).agg(F.count("*").alias("n_test"))
    return B.folds(in_test, burn_months=6).select("test_start", "n_train", "n_test")


def hourly(*cols, before, source=V.hours):
    """Columns over dealt hours that reach `before` rows back."""
    make = lambda x: x.withColumns({n: C.float_round(c, digits) for n, c, digits in cols})
    return lambda s, d: framed(source(s, d), make, t="h", before=before).select("symbol", "h", *(n for n, _, _ in cols))


@query
def f1_roc(s, d):
    return hourly(("roc_3", I.roc(3), 6), ("accel_3", I.acceleration(3), 6), before=6)(s, d)


@query
def f2_move_shape(s, d):
    shape = C.safe_ratio(F.max("step").over(I.rows(-11)), F.abs(F.col("close") - I.lag("close", 12)))
    make = lambda x: x.withColumn("step", F.abs(F.col("close") - I.lag("close", 1))).withColumn("shape", shape)
    return framed(V.hours(s, d), make, t="h", before=12).select("symbol", "h", *r("shape", digits=5))


@query
def f3_vwap_dist(s, d):
    day = Window.partitionBy("symbol", F.to_date("h")).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    with_session = lambda s, d: V.hours(s, d).withColumn("session", F.round(I.vwap_distance(day), 6))
    x = hourly(("rolling", I.full(60, I.vwap_distance(I.rows(-59))), 6), ("session", F.col("session"), 6), before=59, source=with_session)
    return x(s, d)


@query
def f4_sma_breakout(s, d):
    sma = F.avg("close").over(I.rows(-19))
    return hourly(("sma_20", I.full(20, C.safe_ratio(F.col("close") - sma, sma)), 6), ("breakout_20", I.breakout(20), 6), before=20)(s, d)


@query
def f5_up_down_volume(s, d):
    return hourly(("ratio", I.up_down_volume(12), 6), before=11)(s, d)


@query
def f6_rvol(s, d):
    return hourly(("rvol_1", I.relative_volume(1, 24), 6), ("rvol_5", I.relative_volume(5, 24), 6), before=28)(s, d)


@query
def f7_taker_imbalance(s, d):
    return hourly(("taker_1", I.taker_imbalance(1), 6), ("taker_5", I.taker_imbalance(5), 6), ("taker_15", I.taker_imbalance(15), 6), before=14)(s, d)


@query
def f8_trade_count_ratio(s, d):
    ratio = lambda c: I.full(24, C.safe_ratio(F.col(c), F.avg(c).over(I.rows(-24, -1))), back=1)
    sized = lambda s, d: V.hours(s, d).withColumn("size", F.col("volume") / F.col("trades"))
    return hourly(("count_ratio", ratio("trades"), 6), ("size_ratio", ratio("size"), 6), before=24, source=sized)(s, d)


@query
def f9_oi_change(s, d):
    return hourly(*((f"change_{k}", C.safe_ratio(F.col("volume"), I.lag("volume", k)) - 1, 6) for k in (1, 3, 12)), before=12)(s, d)


@query
def f11_cross_section(s, d):
    x = framed(V.hours(s, d), lambda x: x.withColumn("roc", I.roc(1)), t="h", before=1)
    return I.cross_section(x, "roc", "U0").select("symbol", "h", *(C.float_round(F.col(c), 6).alias(c) for c in ("vs_bench", "vs_median", "below")))


@query
def g2_threshold_select(s, d):
    p = V.preds(s, d).filter("prob >= 0.7")
    return p.select("symbol", "d", "prob", F.row_number().over(Window.partitionBy("d").orderBy(F.col("prob").desc(), "symbol")).alias("rank_in_day"))


@query
def g6_multi_key_nulls_last(s, d):
    w = Window.partitionBy("model").orderBy(F.col("hit").asc_nulls_first(), F.col("ret").desc_nulls_last(), "d", "symbol")
    return V.preds(s, d).select("symbol", "d", F.row_number().over(w).alias("place")).filter("place <= 20")


@query
def h4_contains_quote(s, d):
    """Quotes of one to eleven words from every third word of the benchmark's passages on, looked for in all documents."""
    words = F.split(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")), " ")
    q = V.table(s, d, "benchmark").select("item_id", words.alias("w")).select("item_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(3))).alias("i"))
    q = q.select((F.col("item_id") * 1000 + F.col("i")).alias("quote_id"), F.array_join(F.slice("w", F.col("i") + 1, F.col("i") % 11 + 1), " ").alias("quote"))
    found = QT.find(q, V.table(s, d, "documents").select("doc_id", "text")).groupBy("quote_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    short = F.length("quote") < 10
    return q.join(found, "quote_id", "left").select("quote_id", "quote", (short | F.col("n").isNotNull()).alias("valid"), F.coalesce("n", F.lit(0)).alias("n_docs"), "first_doc")


@query
def h7_event_priority(s, d):
    base = F.when(F.col("source") == "web", 2).otherwise(1)
    terms = F.least(F.regexp_count("text", F.lit("(report|market|price)")), F.lit(3))
    return V.table(s, d, "documents").select("doc_id", (base + terms + F.when(F.length("text") > 2000, 1).otherwise(0)).alias("priority"))


@query
def h8_source_coverage(s, d):
    n = F.length("text")
    return V.table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(n > 1000).alias("long"), F.count_if(n < 100).alias("short"), F.count_if(F.col("lang").isNull()).alias("unknown"))


@query
def h10_row_fingerprint(s, d):
    row = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation")))
    return V.table(s, d, "customer").select("c_custkey", F.sha2(row, 256).alias("fingerprint"))


@query
def h11_json_metadata(s, d):
    x = V.table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    j = F.to_json(F.struct("n", "first"))
    return x.select("o_custkey", j.alias("meta"), F.get_json_object(j, "$.first").cast("long").alias("first_key"))


@query
def i2_bookticker_window(s, d):
    x = I.quotes_window(V.quotes(s, d), "1 hour")
    return x.select("symbol", "window_start", *r("bid_open", "bid_high", "bid_low", "bid_close", "ask_open", "ask_close", "bid_qty_mean", "spread_max", "spread_mean"), "bid_qty_last", "ask_qty_max", "ask_qty_min", "n")


@query
def i4_liquidation_window(s, d):
    return I.forced_window(V.ticks(s, d), "6 hours").select("symbol", "window_start", "buy_volume", "sell_volume", *r("buy_notional", "sell_notional"), "buys", "sells")


@query
def i5_depth_window(s, d):
    """Ladders of 3 to 22 levels a side, from the best quote on."""
    n = (F.col("event_id") % 20 + 3).cast("int")
    ladder = lambda price, qty, sign: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.col(price) + sign * 0.05 * i).alias("price"), (F.col(qty) + i).alias("qty")))
    q = V.quotes(s, d).select("symbol", "ts", "event_id", F.explode(F.array(F.struct(F.lit("bid").alias("side"), ladder("bid", "bid_qty", -1).alias("ladder")), F.struct(F.lit("ask").alias("side"), ladder("ask", "ask_qty", 1).alias("ladder")))).alias("b")).select("symbol", "ts", "event_id", "b.*")
    x = I.book_window(q, "6 hours")
    return x.select("symbol", "window_start", "side", "level", "samples", *r("price_open", "price_high", "price_low", "price_close", "qty_mean"), "qty_last", "qty_min", "qty_max", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("notional_mean", "notional_max", "notional_min")))


@query
def i9_window_dedup(s, d):
    w = V.hours(s, d).select("symbol", "h", "trades")
    again = w.filter("trades > 1").select("symbol", "h", (F.col("trades") * 10).alias("trades"))
    return T.insert_ignore(w.filter("trades < 4"), again, keys=["symbol", "h"])


@query
def i11_path_labels(s, d):
    h = V.hours(s, d)
    gaps = h.filter("symbol = 'U3' and hour(h) = 5").select(F.unix_timestamp("h").alias("gap_start"), (F.unix_timestamp("h") + 1800).alias("gap_end"))
    return I.path_labels(h, [1, 4, 12], gaps).select("symbol", "h", "horizon", *(C.float_round(F.col(c), 6).alias(c) for c in ("fwd_return", "mfe", "mae")), "valid")


@query
def i13_book_reconstruct(s, d):
    t = V.ticks(s, d)
    c = t.select("symbol", F.col("event_id").alias("u"), F.when(F.col("maker"), "bid").otherwise("ask").alias("side"), F.floor("price").cast("double").alias("price"), (F.col("event_id") % 4).cast("double").alias("qty"), (F.col("event_id") % 1009 == 0).alias("snapshot"))
    return I.rebuild_book(c)


@query
def i14_quality_asserts(s, d):
    p = V.preds(s, d)
    bad = {"filled_without_hit": F.col("ret").isNotNull() & F.col("hit").isNull(), "pending_with_hit": F.col("ret").isNull() & F.col("hit").isNotNull(), "prob_range": ~F.col("prob").between(0, 1), "horizon_name": ~F.col("horizon").isin("5d", "10d"), "pending": F.col("ret").isNull()}
    one = p.agg(*(F.count_if(c).alias(k) for k, c in bad.items()))
    return one.unpivot([], list(bad), "check", "n")


@query
def i17_stall_peers(s, d):
    """The tape's writers by symbol, now (the last tick of all) against six hours before; twelve are expected, one check an hour."""
    t = V.ticks(s, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"))
    now = t.agg(F.max("ts").alias("now"))
    x = t.crossJoin(F.broadcast(now))
    early = F.col("ts") <= F.col("now") - F.expr("interval 6 hours")
    beats = x.groupBy("symbol").agg(F.max("ts").alias("ts"), F.count("*").alias("rows"))
    before = x.filter(early).groupBy("symbol").agg(F.count("*").alias("rows"))
    expected = s.range(12).select(F.concat(F.lit("U"), "id").alias("symbol"))
    return T.stalls(beats, before, expected, now, interval_seconds=3600).select("symbol", "state")


@query
def j6_lifts(s, d):
    x = B.forward_labels(V.bars(s, d), [5], 0.5).filter("fwd_max_5 is not null").withColumn("v", F.col("fwd_max_5") + F.col("fwd_min_5"))
    x = x.join(x.groupBy("symbol").agg(F.avg("v").alias("mean")), "symbol")
    return x.select("symbol", "d", F.round(F.col("v") - F.col("mean"), 5).alias("lift"))


@query
def j13_coin_vol(s, d):
    return framed(V.hours(s, d), lambda x: x.withColumn("ret", I.roc(1)), t="h", before=1).groupBy("symbol").agg(C.float_round(F.stddev_pop("ret"), 5).alias("vol"), F.count("ret").alias("n"))


@query
def l3_stale_guard(s, d):
    a = V.bars(s, d).agg(F.max("d").alias("price_day"))
    b = V.preds(s, d).filter("ret is not null").agg(F.max("d").alias("feature_day"))
    return a.crossJoin(F.broadcast(b)).select("price_day", "feature_day", (F.col("feature_day") < F.col("price_day")).alias("stale"))


@query
def l6_model_drift(s, d):
    w = Window.partitionBy("horizon").orderBy(F.unix_date("d"))
    day = V.preds(s, d).filter("hit is not null and prob >= 0.6").groupBy("horizon", "d").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    n, hits = F.sum("n").over(w.rangeBetween(-6, 0)), F.sum("hits").over(w.rangeBetween(-6, 0))
    base = A.hit_rate(V.preds(s, d).filter("hit is not null"), ["horizon"]).select("horizon", "rate")
    x = day.withColumns({"n7": n, "p7": hits / n}).join(F.broadcast(base), "horizon")
    return x.select("horizon", "d", "n7", F.round("p7", 6).alias("p7"), ((F.col("n7") >= 5) & (F.col("rate") < 0.95) & (F.round(F.col("p7") / F.col("rate"), 9) < 0.8)).alias("drift"))
