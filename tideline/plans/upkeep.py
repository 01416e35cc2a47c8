"""Queries over parsed rows, universe upkeep, rules over windows and review sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import accounts as AC
from ..operators import aggregates as A
from ..operators import bars as B
from ..operators import discovery as X
from ..operators import intraday as I
from ..sources import tape as S
from ..sources import views as V
from .catalog import query, r


@query
def a2_typed_rows(s, d):
    raw = V.ticks(s, d).select("event_id", F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string"))).alias("u"), F.col("qty").cast("int").cast("string").alias("qty"))
    return S.typed_rows(raw, {"u": "bigint", "qty": "double"})


@query
def a3_csv_bars(s, d):
    o = V.table(s, d, "orders")
    day = F.when(F.col("o_orderkey") % 9 == 0, "N/D").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    price = F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise((F.col("o_orderkey") % 1000).cast("string"))
    line = F.when(F.col("o_orderkey") % 13 == 0, "short,line").otherwise(F.concat_ws(",", F.col("o_orderkey").cast("string"), day, price, price, price, price, F.lit("10")))
    return S.csv_bars(o.select(line.alias("value")))


@query
def a4_json_klines(s, d):
    e = V.table(s, d, "events")
    open_ms = F.col("event_id") * 60000
    bar = F.format_string('["%d","1","%d","0.5","1.5","7","%d"]', open_ms, F.col("event_id") % 9, open_ms + 59999)
    rows = e.select(F.concat(F.lit("K"), (F.col("event_id") % 3).cast("string")).alias("symbol"), F.concat(F.lit("["), bar, F.lit(","), F.replace(bar, F.lit('"7"'), F.lit('"bad"')), F.lit("]")).alias("payload"))
    return S.json_klines(rows, F.lit(5_000 * 60000))


@query
def b21_refresh_queue(s, d):
    """Customers to refresh: why, and how urgent; the first hundred."""
    last = V.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.to_date("o_orderdate")).alias("last_day"))
    x = V.table(s, d, "customer").select("c_custkey", "c_acctbal").join(last, "c_custkey", "left")
    age = F.datediff(F.lit("2001-12-31").cast("date"), "last_day")
    rules = [(F.col("last_day").isNull(), F.lit("no_prices"), 1), (age > 10, F.concat(F.lit("stale_prices_"), age.cast("string"), F.lit("d")), 2), (F.col("c_acctbal") < 0, F.lit("no_fundamentals"), 3), (F.col("c_custkey") % 3 == 0, F.lit("no_market_cap"), 4)]
    out = x.select("c_custkey", F.concat_ws("|", *(F.when(c, n) for c, n, _ in rules)).alias("reason"), F.least(*(F.when(c, p) for c, _, p in rules)).alias("priority"))
    return out.filter("priority is not null").orderBy("priority", "c_custkey").limit(100)


@query
def c23_membership_at_time(s, d):
    """Predictions on symbols outside the five with the most volume in the 30 days before."""
    w = Window.partitionBy("symbol").orderBy(F.unix_date("d")).rangeBetween(-30, -1)
    b = V.bars(s, d).withColumn("past", F.sum("volume").over(w))
    rank = b.withColumn("rank", F.rank().over(Window.partitionBy("d").orderBy(F.col("past").desc_nulls_last())))
    x = V.preds(s, d).filter("prob >= 0.5").select("symbol", "d", "model").join(rank.select("symbol", "d", "rank"), ["symbol", "d"])
    return x.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg((F.col("rank") > 5).cast("double")), 6).alias("outside"))


@query
def d30_order_vwap(s, d):
    li = V.table(s, d, "lineitem")
    x = li.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("qty"), F.try_divide(F.sum("l_extendedprice").cast("double"), F.sum("l_quantity").cast("double")).alias("vwap"))
    return x.select("l_orderkey", "qty", F.round("vwap", 9).alias("vwap"), (F.round("vwap", 9) * (1 - 0.0009) > 2000).alias("won"))


@query
def d31_settled_label_hit(s, d):
    p = V.preds(s, d).withColumn("settled", F.date_add("d", F.when(F.col("horizon") == "5d", 7).otherwise(14)))
    return A.hit_rate(p.filter("settled <= date '2000-06-30' and hit is not null"), ["horizon", "model"]).select("horizon", "model", "n", "hits", *r("rate"))


@query
def d42_daily_balance(s, d):
    day = V.preds(s, d).filter("ret is not null").groupBy("horizon", "d").agg(F.sum(F.log1p("ret")).alias("pnl"), F.count("*").alias("n"))
    w = Window.partitionBy("horizon").orderBy("d")
    return day.select("horizon", "d", "n", F.round(F.col("pnl") - F.lag("pnl").over(w), 6).alias("delta"), F.round(F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)), 5).alias("running"))


@query
def d42_preliminary(s, d):
    """Accounts by day with a preliminary row of today. Positions are entries of likely days, held for five to eleven days, every tenth still open;
    reconciled days are those with bars, but for Wednesdays, up to yesterday."""
    since, today = (F.lit(x).cast("date") for x in ("1997-01-01", "1999-06-30"))
    n = F.datediff("d", F.lit("1995-01-01").cast("date"))
    entries = V.trades(s, d).filter(F.col("d") <= today).select("symbol", F.col("d").alias("entry_day"), F.when(n % 10 != 0, F.date_add("d", 5 + n % 7)).alias("exit_day"), "entry", (1 + n % 3).cast("double").alias("qty"), ((F.col("prob") - 0.94) * F.col("entry")).alias("realized"))
    b = V.bars(s, d).filter(F.col("d") < today)
    days = b.filter(F.weekday("d") != 2).groupBy("d").agg(F.sum("volume").alias("equity"))
    x = AC.daily_balance(days, entries, b.select("symbol", "d", F.col("close").alias("price")), since=since, today=today)
    return x.select("d", "preliminary", *r("equity", "realized", "unrealized", "delta", "cumulative", digits=7))


@query
def e34_universe_hysteresis(s, d):
    """Over the last seven ranking days by trailing mean volume: in the top five on all adds a symbol that isn't held (if listed for 60 days,
    else it is pending), on none removes one that is; days in the top counted back from the last, and the last rank."""
    today, n = F.lit("1998-12-31").cast("date"), F.substring("symbol", 2, 2).cast("int")
    b = V.bars(s, d).withColumn("mean", F.avg("volume").over(B.by_key().rowsBetween(-29, 0)))
    days = b.select("d").distinct().orderBy(F.col("d").desc()).limit(7).withColumn("back", F.row_number().over(Window.orderBy(F.col("d").desc())))  # seven rows
    x = b.join(F.broadcast(days), "d").withColumn("rank", F.row_number().over(Window.partitionBy("d").orderBy(F.col("mean").desc(), "symbol")))
    top = F.col("rank") <= 5
    y = x.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(top).alias("inside"), (F.coalesce(F.min(F.when(~top, F.col("back"))), F.lit(8)) - 1).alias("streak"), F.min(F.when(F.col("back") == 1, F.col("rank"))).alias("rank"))
    y = y.withColumns({"active": n % 2 == 0, "listed": F.when(n != 9, F.when(n % 3 == 0, F.date_sub(today, 30)).otherwise(F.date_sub(today, 900)))})
    age = F.datediff(today, "listed")
    add = F.when(F.col("listed").isNull(), "no_listing").when(age < 60, "pending").otherwise("add")
    change = F.when(F.col("n") < 7, "insufficient_history").when(~F.col("active") & (F.col("inside") == 7), add).when(F.col("active") & (F.col("inside") == 0), "remove").otherwise("keep")
    return y.select("symbol", "n", "inside", "streak", "rank", "active", change.alias("change"), F.when(change == "pending", F.date_add("listed", 60)).alias("eligible"))


@query
def e37_event_clusters(s, d):
    """Detections of a symbol and kind within five days of the one before are one event: its best move, number and span."""
    x = B.lag_returns(V.bars(s, d), [1]).filter("ret_1 > 1 or ret_1 < -0.6").withColumn("kind", F.when(F.col("ret_1") > 0, "up").otherwise("down"))
    w = Window.partitionBy("symbol", "kind").orderBy("d")
    new = F.coalesce(F.datediff("d", F.lag("d").over(w)) > 5, F.lit(True)).cast("int")
    y = x.withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return y.groupBy("symbol", "kind", "g").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n"), F.round(F.max(F.abs("ret_1")), 6).alias("best")).drop("g")


@query
def e41_downsample(s, d):
    """At most 100 evenly spaced rows a symbol, and its first, last, highest and lowest."""
    by = Window.partitionBy("symbol")
    x = V.bars(s, d).select("symbol", "d", F.round("close", 8).alias("close"), F.row_number().over(by.orderBy("d")).alias("k"), F.count("*").over(by).alias("n"))
    x = x.withColumns({"step": F.ceil(F.col("n") / 100.0), "top": F.max(F.struct("close", "k")).over(by).k, "low": F.min(F.struct("close", "k")).over(by).k})
    keep = ((F.col("k") - 1) % F.col("step") == 0) | (F.col("k") == F.col("n")) | (F.col("k") == F.col("top")) | (F.col("k") == F.col("low"))
    return x.filter(keep).select("symbol", "d", "close")


@query
def f10_book_imbalance(s, d):
    q = V.quotes(s, d)
    mid = (F.col("bid") + F.col("ask")) / 2
    levels = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((F.col("bid") - 0.05 * i).alias("bid"), (F.col("ask") + 0.05 * i).alias("ask"), (F.col("bid_qty") + i).alias("bq"), (F.col("ask_qty") + i).alias("aq")))
    near = lambda side, qty: F.aggregate("levels", F.lit(0.0), lambda acc, x: acc + F.when(F.abs(x[side] - F.col("mid")) <= F.col("mid") * 0.005 + 1e-9, x[qty]).otherwise(0.0))
    x = q.withColumns({"levels": levels, "mid": mid}).withColumns({"b": near("bid", "bq"), "a": near("ask", "aq")})
    return x.select("event_id", F.round(C.safe_ratio(F.col("b") - F.col("a"), F.col("b") + F.col("a")), 6).alias("imbalance"), C.float_round(C.float_ratio(F.col("ask") - F.col("bid"), F.col("mid")) * 10000, 5).alias("spread_bps"))


@query
def i3_markprice_window(s, d):
    order = F.struct("ts", "event_id")
    t = V.ticks(s, d).withColumns({"funding": F.col("qty") / 1000, "index": F.when(F.col("event_id") % 3 != 0, F.col("price") * 1.001), "settle": F.when(F.col("event_id") % 5 == 0, F.col("price") * 0.999)})
    own = lambda c: [f.alias(f"{c}_{n}") for n, f in (("open", F.min_by(c, F.when(F.col(c).isNotNull(), order))), ("high", F.max(c)), ("low", F.min(c)), ("close", F.max_by(c, F.when(F.col(c).isNotNull(), order))))]
    x = t.groupBy("symbol", F.window("ts", "6 hours").alias("w")).agg(*I.summary("mark", F.col("price"), order), *I.summary("funding", F.col("funding"), order), *own("index"), *own("settle"), F.max_by("event_id", order).alias("next_id"))
    return x.select("symbol", F.col("w.start").alias("window_start"), *r("mark_open", "mark_high", "mark_low", "mark_close", "funding_low", "funding_high", "funding_close", *(f"{c}_{n}" for c in ("index", "settle") for n in ("open", "high", "low", "close"))), "next_id")


RULES = {1: [("ret_1", ">", 0.5), ("sma_dist_20", "<", 0.0)], 2: [("ret_5", "<", -0.3)], 3: [("ret_1", "<", -0.2), ("ret_5", ">", 0.2), ("sma_dist_20", ">", -0.5)]}


def fired(s, d):
    x = B.sma_distance(B.lag_returns(V.bars(s, d), [1, 5]), 20, min_rows=20)
    return X.fired(x, RULES, ["symbol", "d"])


@query
def j5_rule_firing(s, d):
    return fired(s, d)


@query
def j7_rule_score(s, d):
    x = B.forward_labels(V.bars(s, d), [5], 0.5).filter("fwd_max_5 is not null").select("symbol", "d", F.log1p("fwd_max_5").alias("v"))
    lift = x.join(x.groupBy("symbol").agg(F.avg("v").alias("mean")), "symbol").withColumn("lift", F.col("v") - F.col("mean"))
    return fired(s, d).join(lift, ["symbol", "d"]).groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg("lift"), 6).alias("mean_lift")).filter("n >= 20")


@query
def j12_forward_confirm(s, d):
    x = B.forward_labels(V.bars(s, d), [5], 0.5).filter("fwd_ret_5 > -1").select("symbol", "d", F.log1p("fwd_ret_5").alias("v"))
    y = fired(s, d).filter("d > date '2000-01-01'").join(x, ["symbol", "d"])
    return X.confirmation(y, {1: 0.05, 2: 0.01, 3: 0.0}, promoted=[1, 3]).select("rule", "n", *r("mean", "t", digits=5), "verdict")


@query
def l4_validate_backfill(s, d):
    """Integrity checks: name, whether it passed, rows that break it. One pass, and one for duplicate keys."""
    p = V.preds(s, d)
    one = p.agg(F.count_if(~F.col("prob").between(0, 1)).alias("prob_range"), F.count_if(F.col("hit").isNull() & F.col("ret").isNotNull()).alias("unfilled"), F.count_if(F.col("close") <= 0).alias("price"), F.count_if(F.year("d") != F.col("model")).alias("model_year"))
    dup = p.groupBy("symbol", "d").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    x = one.crossJoin(F.broadcast(dup)).unpivot([], ["prob_range", "unfilled", "price", "model_year", "duplicates"], "name", "n")
    return x.select("name", (F.col("n") == 0).alias("passed"), "n")


@query
def l7_review_sections(s, d):
    """The best five of each component by month, the sections in which a symbol stands, and how urgent it is; tier C always is."""
    c = V.candidates(s, d).withColumn("month", F.trunc("d", "month"))
    best = c.groupBy("symbol", "month").agg(*(F.max(x).alias(x) for x in ("cheap", "quality", "momentum")), F.when(F.max("num") % 3 == 0, "C").otherwise("B").alias("tier"))
    long = best.unpivot(["symbol", "month", "tier"], ["cheap", "quality", "momentum"], "section", "score").filter("score is not null")
    top = long.withColumn("k", F.row_number().over(Window.partitionBy("month", "section").orderBy(F.col("score").desc(), "symbol"))).filter("k <= 5")
    x = top.groupBy("symbol", "month", "tier").agg(F.concat_ws(",", F.sort_array(F.collect_set("section"))).alias("sections"), F.countDistinct("section").alias("n"))
    return x.select("symbol", "month", "tier", "sections", "n", F.when((F.col("n") >= 3) | (F.col("tier") == "C"), "high").when(F.col("n") == 2, "medium").otherwise("low").alias("priority"))


@query
def l7_review_stats(s, d):
    """By month: rows, share of components that are missing, share of rows with fewer than three, and rounded scores in tens as counts."""
    c = V.candidates(s, d)
    parts = ["cheap", "quality", "catalyst", "momentum", "sentiment"]
    seen = sum((F.col(x).isNotNull().cast("int") for x in parts), F.lit(0))
    tens = [F.count_if(F.floor(F.col("cheap") / 10) == i).alias(f"tens_{i}") for i in range(11)]
    missing = [F.round(F.avg(F.col(x).isNull().cast("double")), 6).alias(f"no_{x}") for x in parts]
    return c.groupBy(F.trunc("d", "month").alias("month")).agg(F.count("*").alias("n"), *missing, F.round(F.avg((seen < 3).cast("double")), 6).alias("low_confidence"), *tens)


@query
def l11_guard_hits(s, d):
    c = V.candidates(s, d)
    meta = F.to_json(F.struct((F.col("num") % 4 == 0).alias("flagged"), F.when(F.col("num") % 5 == 0, "low").otherwise("high").alias("confidence")))
    x = c.select("symbol", F.trunc("d", "month").alias("month"), meta.alias("m"))
    hit = F.when(F.get_json_object("m", "$.flagged") == "true", "flagged").when(F.get_json_object("m", "$.confidence") == "low", "low_confidence")
    return x.groupBy("symbol", "month").agg(F.concat_ws("|", F.sort_array(F.collect_set(hit))).alias("hits"))
