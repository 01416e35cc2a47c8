"""The registered queries: each applies an operator to views over the given tables. Doubles are rounded, as engines differ in
the last bits of sums."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import bars as B
from ..operators import joins as J
from ..operators import tape as T
from ..operators.frames import deal, gather
from ..sources import views as V
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def r(*cols: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in cols]


def bench(b: DataFrame) -> DataFrame:
    return b.filter("symbol = 'S0'")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum, distance, volatility and forward labels per symbol-day."""
    b = deal(V.bars(spark, sf_dir), before=49, after=20)
    b = B.realized_vol(B.sma_distance(B.lag_returns(b, [1, 5, 20]), 50), 20, scale=252, include_current=False)
    return gather(B.forward_labels(b, [5, 10, 20], 0.05)).select("symbol", "d", *r("ret_1", "ret_5", "ret_20", "sma_dist_50", "vol", "fwd_ret_5", "fwd_max_10", "fwd_min_20"), "hit_5")


@query
def a0_bars(s, d):
    return V.bars(s, d).select("symbol", "d", *r("open", "high", "low", "close", digits=8), "volume", "trades", "taker_buy")


@query
def a7_keyed_upsert(s, d):
    b = V.bars(s, d).select("symbol", "d", "trades", "volume")
    new = b.filter("trades > 2").select("symbol", F.date_add("d", 1).alias("d"), (F.col("trades") * 10).alias("trades"), F.lit(1.0).alias("volume"))
    return T.upsert(b, new, keys=["symbol", "d"], update_cols=["trades"])


@query
def a8_insert_or_ignore(s, d):
    b = V.bars(s, d).select("symbol", "d", "trades")
    return T.insert_ignore(b, b.select("symbol", F.date_add("d", 1).alias("d"), (F.col("trades") + 100).alias("trades")), keys=["symbol", "d"])


@query
def a13_retention(s, d):
    return V.bars(s, d).filter(F.col("d") >= F.date_sub(F.lit("2001-11-04").cast("date"), 90)).select("symbol", "d", "trades")


@query
def a16_ordered_export(s, d):
    p = V.preds(s, d).filter("d = date '1999-06-01' and prob >= 0.1")
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.col("prob").desc(), "symbol"))
    return p.select("symbol", "d", "prob", rank.alias("rank"), F.date_add("d", 1).alias("export_date"))


@query
def b1_safe_ratio(s, d):
    return V.bars(s, d).select("symbol", "d", F.round(C.safe_ratio(F.col("taker_buy"), F.col("volume") - F.col("taker_buy")), 6).alias("ratio"))


@query
def b2_bounded_ratio(s, d):
    value, reason = C.bounded(C.safe_ratio(F.col("taker_buy"), F.col("volume") - F.col("taker_buy")), 0.2, 5)
    return V.bars(s, d).select("symbol", "d", F.round(value, 6).alias("ratio"), reason.alias("reason"))


@query
def b3_step_score(s, d):
    return B.lag_returns(V.bars(s, d), [20]).select("symbol", "d", C.step_score(F.col("ret_20"), (-0.2, 0.0, 0.2, 0.5), (10, 30, 50, 70, 90)).alias("score"))


@query
def b4_market_cap_bucket(s, d):
    return V.table(s, d, "supplier").select("s_suppkey", C.cap_bucket(F.col("s_acctbal") * 1e7).alias("bucket"))


@query
def b5_prob_bin(s, d):
    return V.preds(s, d).groupBy(C.prob_bin(F.col("prob")).alias("bin")).agg(F.count("*").alias("n"))


@query
def b7_exclusion_gate(s, d):
    b = gather(B.lag_returns(B.extreme_distance(deal(V.bars(s, d), before=90), 90), [5, 60]))
    a = F.coalesce((F.col("drawdown") < -0.2) & (F.col("ret_60") > 2.0), F.lit(False))
    c = F.coalesce(F.col("ret_5") < -0.3, F.lit(False))
    return b.select("symbol", "d", F.when(a & c, "A+B").when(a, "A").when(c, "B").alias("reason"))


@query
def b8_dual_signal(s, d):
    p = V.preds(s, d).withColumn("down", F.round(F.lit(1.0) - F.col("prob"), 6))
    return p.select("symbol", "d", F.when((F.col("prob") >= 0.65) & (F.col("down") < 0.4), "BUY").when((F.col("down") >= 0.65) & (F.col("prob") < 0.4), "SELL").alias("signal"))


@query
def b17_calendar_features(s, d):
    h = F.hour("ts")
    return V.ticks(s, d).select("event_id", F.round(F.sin(h * 2 * 3.141592653589793 / 24), 6).alias("hour_sin"), F.round(F.cos(h * 2 * 3.141592653589793 / 24), 6).alias("hour_cos"), F.weekday("ts").alias("weekday"), h.between(7, 15).alias("london"), h.between(12, 20).alias("new_york"), (h < 8).alias("asian"))


@query
def c1_training_set(s, d):
    b = V.bars(s, d)
    y = B.forward_labels(b, [5], 0.05).select("symbol", "d", "hit_5")
    x = B.lag_returns(b, [5]).select("symbol", "d", F.round("ret_5", 6).alias("ret_5"))
    return x.join(y.filter("hit_5 is not null and d between date '1996-01-01' and date '1999-12-31'"), ["symbol", "d"])


@query
def c4_row_offset_join(s, d):
    return J.row_offset_join(V.preds(s, d).filter("prob >= 0.9").select("symbol", "d"), V.bars(s, d), n=10).select("symbol", "d", "mature_d", *r("mature_close", digits=8))


@query
def c5_calendar_offset_join(s, d):
    return J.calendar_offset_join(V.preds(s, d).filter("prob >= 0.9").select("symbol", "d"), V.bars(s, d), days=7).select("symbol", "d", *r("later_close", digits=8))


@query
def c6_interval_join_agg(s, d):
    return J.forward_extremes(V.preds(s, d).filter("prob >= 0.5").select("symbol", "d"), V.bars(s, d), days=10).select("symbol", "d", *r("max_close", "min_close", digits=8), "n_bars")


@query
def c8_asof_backward(s, d):
    f = V.filings(s, d).groupBy("symbol", "filing_date").agg(F.max("accession").alias("accession"))
    return J.asof_join(V.bars(s, d).select("symbol", "d"), f, by="symbol", left_t="d", right_t="filing_date", values=["accession"])


@query
def c8_asof_strict(s, d):
    f = V.filings(s, d).groupBy("symbol", "filing_date").agg(F.max("accession").alias("accession"))
    return J.asof_join(V.bars(s, d).select("symbol", "d"), f, by="symbol", left_t="d", right_t="filing_date", values=["accession"], strict=True)


@query
def c9_latest_of_form(s, d):
    f = V.filings(s, d).filter("form in ('10-K', '10-Q')").groupBy("symbol", "filing_date").agg(F.max_by("form", "accession").alias("form"), F.max("accession").alias("accession"))
    return J.asof_join(V.bars(s, d).select("symbol", "d"), f, by="symbol", left_t="d", right_t="filing_date", values=["form", "accession"])


@query
def c11_asof_forward(s, d):
    a = V.preds(s, d).filter("prob >= 0.8").select("symbol", "d", F.date_add("d", 20).alias("t"))
    return J.asof_join(a, V.bars(s, d).select("symbol", F.col("d").alias("bar_d"), "close"), by="symbol", left_t="t", right_t="bar_d", values=["close"], forward=True).select("symbol", "d", "match_t", *r("close", digits=8))


@query
def c12_asof_offset(s, d):
    b = V.bars(s, d)
    a = b.select("symbol", "d", "close", F.date_sub("d", 30).alias("t"))
    m = J.asof_join(a, b.select("symbol", F.col("d").alias("bar_d"), F.col("close").alias("base")), by="symbol", left_t="t", right_t="bar_d", values=["base"])
    return m.select("symbol", "d", F.round(C.safe_ratio(F.col("close"), F.col("base")) - 1, 6).alias("move")).filter("move > 0.5")


@query
def c13_reconcile(s, d):
    b = V.bars(s, d)
    return J.reconcile(b.filter("trades > 1"), b.withColumn("close", F.when(F.col("trades") % 3 == 0, F.col("close") * 1.1).otherwise(F.col("close"))).filter("d < date '2001-01-01'"), on=["symbol", "d"], value="close", tol=0.001)


@query
def c14_semi_filter(s, d):
    rich = V.bars(s, d).groupBy("symbol").agg(F.sum("volume").alias("v")).filter("v > 150000 or symbol in ('S1', 'S3')")
    return V.bars(s, d).join(rich, "symbol", "left_semi").select("symbol", "d", "trades")


@query
def c19_hold_window_sum(s, d):
    rates = V.ticks(s, d).filter("event_type = 'view'").select(F.concat(F.lit("S"), F.substring("symbol", 2, 2)).alias("symbol"), F.to_date("ts").alias("day"), ((F.col("price") - 50) / 100000).alias("rate"))
    trades = rates.select("symbol", F.col("day").alias("d")).distinct()
    x = J.hold_sum(trades, rates, days=5)
    return x.select("symbol", "d", *r("funding", digits=9), "n_rates", (F.col("n_rates") < 10).alias("few"))


@query
def d2_cond_counts(s, d):
    return A.hit_rate(V.preds(s, d).filter("hit is not null"), ["horizon"]).select("horizon", "n", "hits", *r("rate"))


@query
def d3_weighted_mean(s, d):
    return V.ticks(s, d).groupBy(F.to_date("ts").alias("d")).agg(F.round(F.try_divide(F.sum(F.col("price") * F.col("qty")), F.sum("qty")), 6).alias("vwap"), F.countDistinct("symbol").alias("n_symbols"))


@query
def d4_last_by_order(s, d):
    return V.ticks(s, d).groupBy("symbol", F.to_date("ts").alias("d")).agg(F.max_by("price", "event_id").alias("last_price"), F.round(F.avg("price"), 6).alias("mean_price"))


@query
def d5_distinct_counts(s, d):
    return V.filings(s, d).groupBy("form").agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("filing_date").alias("days"), F.count("*").alias("n"))


@query
def d6_having_dups(s, d):
    return V.filings(s, d).groupBy("symbol", "filing_date", "form").agg(F.count("*").alias("n")).filter("n > 1")


@query
def d7_trade_stats(s, d):
    return A.trade_stats(V.preds(s, d).filter("ret is not null").withColumn("ret", F.col("ret") - 0.5), ["horizon", "model"]).select("horizon", "model", "n", *r("win_rate", "mean_ret", "median_ret", "profit_factor", digits=5))


@query
def d9_event_day_sharpe(s, d):
    return A.event_day_sharpe(V.preds(s, d).filter("ret is not null"), ["horizon"]).select("horizon", "n_days", *r("sharpe", digits=5))


@query
def d10_max_drawdown(s, d):
    b = B.lag_returns(V.bars(s, d), [1]).withColumn("x", F.when(F.col("ret_1") > 0, 0.01).otherwise(-0.011))
    return A.max_drawdown(b, "symbol", "d", "x").select("symbol", *r("max_drawdown"))


@query
def d11_topn_daily_sharpe(s, d):
    top = A.top_n(V.preds(s, d).filter("ret is not null"), 6).withColumn("x", F.col("ret") * 0.8 / 6).withColumn("all", F.lit("all"))
    return A.event_day_sharpe(top, ["all"], value="x").select("n_days", *r("sharpe", digits=5))


@query
def d12_reliability(s, d):
    return A.reliability(V.preds(s, d).filter("hit is not null"), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.2]).select("bucket", "n", "hits", *r("rate", "dev_pp"))


@query
def d16_auc(s, d):
    return A.auc(V.preds(s, d).filter("hit is not null"), "model").select("model", *r("auc"))


@query
def d17_threshold_sweep(s, d):
    return A.threshold_sweep(V.preds(s, d).filter("hit is not null"), [round(0.3 + 0.02 * i, 2) for i in range(25)]).select("threshold", "n", *r("precision", "recall"))


@query
def d18_precision_at_k(s, d):
    top = A.top_n(V.preds(s, d).filter("hit is not null"), 20, by="model")
    return top.groupBy("model").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("precision"))


@query
def d19_brier(s, d):
    e = F.col("prob") - F.col("hit").cast("double")
    return V.preds(s, d).filter("hit is not null").groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.round(F.avg(e * e), 6).alias("brier"))


@query
def d20_linear_trend(s, d):
    m = V.bars(s, d).groupBy("symbol", F.year("d").alias("year")).agg(F.avg("close").alias("y"))
    return m.groupBy("symbol").agg(F.round(F.regr_slope("y", "year"), 4).alias("slope"), F.round(F.regr_intercept("y", "year"), 2).alias("intercept"), F.count("*").alias("n")).filter("n >= 3")


@query
def d22_class_weight(s, d):
    return V.preds(s, d).filter("hit is not null").groupBy("horizon").agg(F.round(F.try_divide(F.count_if(~F.col("hit")).cast("double"), F.count_if("hit")), 6).alias("weight"))


@query
def d23_sector_concentration(s, d):
    names = V.table(s, d, "supplier").join(V.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(V.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = names.groupBy(F.col("r_name").alias("sector")).agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6)
    return n.select("sector", "n", share.alias("share"), (share > 0.3).alias("heavy"))


@query
def d24_regime(s, d):
    share = V.preds(s, d).groupBy("d").agg(F.avg((F.col("prob") >= 0.6).cast("double")).alias("share"))
    return share.select("d", F.when(F.col("share") >= 0.5, "high").when(F.col("share") >= 0.2, "normal").otherwise("low").alias("regime"))


@query
def d32_monthly_distribution(s, d):
    month = V.bars(s, d).groupBy("symbol", F.trunc("d", "month").alias("m")).agg(F.max_by("close", "d").alias("last"))
    ch = F.try_divide(F.col("last"), F.lag("last").over(Window.partitionBy("symbol").orderBy("m"))) - 1
    q = month.withColumn("ch", ch).groupBy("symbol")
    return q.agg(*(F.round(F.percentile("ch", p / 100), 6).alias(f"p{p}") for p in (5, 25, 50, 75, 95)))


@query
def e1_lag_returns(s, d):
    return B.lag_returns(V.bars(s, d), [1, 5, 20]).select("symbol", "d", *r("ret_1", "ret_5", "ret_20"))


@query
def e2_sma_distance(s, d):
    b = deal(V.bars(s, d), before=49)
    return gather(B.sma_distance(B.sma_distance(b, 20, min_rows=20), 50)).select("symbol", "d", *r("sma_dist_20", "sma_dist_50"))


@query
def e3_bollinger(s, d):
    return B.bollinger(V.bars(s, d), 20, zero=0.0).select("symbol", "d", *r("bollinger", digits=5))


@query
def e4_rolling_extremes(s, d):
    return B.extreme_distance(V.bars(s, d), 252).select("symbol", "d", *r("drawdown", "rally", "place"))


@query
def e5_realized_vol(s, d):
    b = B.realized_vol(deal(V.bars(s, d), before=31), 20, scale=252, include_current=False).withColumnRenamed("vol", "vol_prior")
    return gather(B.realized_vol(b, 30, scale=365, include_current=True, min_obs=30)).select("symbol", "d", *r("vol_prior", "vol"))


@query
def e6_atr(s, d):
    return B.atr(V.bars(s, d), 14).select("symbol", "d", *r("true_range", "atr_pct", digits=8))


@query
def e7_relative_volume(s, d):
    return B.relative_volume(V.bars(s, d), 20, 10).select("symbol", "d", *r("rel_volume"))


@query
def e10_rolling_slope(s, d):
    return B.rolling_slope(V.bars(s, d), 5).select("symbol", "d", *r("volume_slope", digits=11))


@query
def e11_rolling_beta(s, d):
    b = V.bars(s, d)
    return B.rolling_beta(b, bench(b), 60, 55).select("symbol", "d", *r("beta", digits=4))


@query
def e12_relative_return(s, d):
    b = V.bars(s, d)
    return B.relative_return(b, bench(b), 5).select("symbol", "d", *r("rel_return", digits=5))


@query
def e13_candle_shape(s, d):
    return B.candle_shape(V.bars(s, d)).select("symbol", "d", *r("body", "upper_wick", "lower_wick", "close_in_range", "gap", digits=5))


@query
def e14_streaks(s, d):
    return B.streaks(V.bars(s, d)).select("symbol", "d", "up_streak", "down_streak")


@query
def e16_forward_labels(s, d):
    return B.forward_labels(V.bars(s, d), [5, 10], 0.5).select("symbol", "d", *r("fwd_ret_5", "fwd_max_5", "fwd_min_5", "fwd_ret_10", "fwd_max_10"), "hit_5", "hit_10")


@query
def e18_knockout(s, d):
    return B.knockout(V.bars(s, d), 0.10, 0.05, 5).select("symbol", "d", "outcome", "bar")


@query
def e20_latest_per_key(s, d):
    w = Window.partitionBy("symbol", "form").orderBy(F.col("filing_date").desc(), F.col("accession").desc())
    return V.filings(s, d).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


@query
def e22_trail_line(s, d):
    return B.trail_line(V.bars(s, d), activation=0.1, trail=0.3).select("symbol", "d", *r("peak", "line", digits=8))


@query
def e29_event_counts(s, d):
    f = V.filings(s, d).filter("form = '8-K'")
    e = f.select(F.col("symbol"), F.explode(F.sequence(F.col("filing_date"), F.date_add("filing_date", 13))).alias("d"), "accession")
    counts = e.groupBy("symbol", "d").agg(F.countDistinct("accession").alias("n"))
    return V.bars(s, d).select("symbol", "d").join(counts, ["symbol", "d"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query
def e32_dominance(s, d):
    return B.dominance(V.bars(s, d), "S0").select("symbol", "d", *r("bench_share", "log_dollar", digits=5))


@query
def e33_volume_rank(s, d):
    return B.volume_rank(V.bars(s, d), "2000-06-30", 90).select("symbol", F.round("dollar", 2).alias("dollar"), "rank")


@query
def e36_breakouts(s, d):
    return B.breakouts(V.bars(s, d)).select("symbol", "d", *r("close", "prior_high", digits=8))


@query
def e38_episodes(s, d):
    moves = B.lag_returns(V.bars(s, d), [1]).filter("abs(ret_1) > 0.1")
    return B.episodes(moves, 5).select("symbol", "first_day", "last_day", "n", *r("best", "total_ret", "best_ret", digits=7))


@query
def e42_gap_days(s, d):
    return B.gap_days(V.bars(s, d))


@query
def g1_top_n_per_group(s, d):
    return A.top_n(V.preds(s, d), 3).select("symbol", "d", "prob", "rank_in_day")


@query
def g3_adaptive_select(s, d):
    return A.adaptive_select(V.preds(s, d), min_high=3, cap=4).select("symbol", "d", "prob", "confident", "rank_in_day")


@query
def g4_cap_per_key(s, d):
    p = V.filings(s, d).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("form", F.col("filing_date").desc(), "accession"))).filter("k <= 3")
    return p.orderBy("form", F.col("filing_date").desc(), "accession").limit(20).select("symbol", "form", "filing_date", "accession")


@query
def g5_hash_sample(s, d):
    h = F.sha2(F.concat(F.col("accession").cast("string"), F.lit("salt")), 256)
    return V.filings(s, d).withColumn("h", h).orderBy("h").limit(50).select("accession", "h")


@query
def g7_latest_dates(s, d):
    return V.bars(s, d).select("d").distinct().orderBy(F.col("d").desc()).limit(7)


@query
def h1_candidate_union(s, d):
    b = V.bars(s, d)
    usual = F.broadcast(b.agg((F.avg("trades") * 1.3).alias("many"), (F.avg("volume") * 1.3).alias("much")))  # one row
    x, y = (b.crossJoin(usual).filter(c).select("symbol", "d").distinct() for c in ("trades > many", "volume > much"))
    both = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), ["symbol", "d"], "full_outer")
    return both.select("symbol", "d", F.when(F.col("b").isNull(), "add").when(F.col("a").isNull(), "remove").otherwise("keep").alias("change"))


@query
def h2_distinct_rows(s, d):
    return V.filings(s, d).select("symbol", "form").distinct()


@query
def h3_html_text(s, d):
    return V.table(s, d, "pages").select("page_id", C.html_text(F.col("html")).alias("text"))


@query
def h9_surprise_pct(s, d):
    p = V.table(s, d, "part")
    return p.select("p_partkey", F.round(F.try_divide(F.col("p_retailprice") - F.col("p_size") * 40, F.abs(F.col("p_size") * 40)) * 100, 7).alias("surprise"))


@query
def h13_dates(s, d):
    o = V.filings(s, d)
    return o.select("accession", F.trunc("filing_date", "month").alias("month"), F.datediff(F.lit("2001-12-31").cast("date"), "filing_date").alias("age"), F.date_add("filing_date", 45).alias("due"), F.quarter("filing_date").alias("quarter"))


def searched(df, *, tier=None, low=0.0, high=10_000.0, text=None):
    """Rows of a score range; a tier and a text within ticker or name, whatever its case, narrow it where given."""
    found = F.col("s_acctbal").between(low, high)
    if tier:
        found &= F.col("tier") == tier
    if text:
        found &= F.contains(F.lower("s_name"), F.lit(text.lower())) | F.contains(F.lower("ticker"), F.lit(text.lower()))
    return df.filter(found)


@query
def h14_filtered_search(s, d):
    """Three searches over the suppliers: by name or ticker, by tier and range, by all."""
    x = V.table(s, d, "supplier").withColumn("tier", F.when(F.col("s_nationkey") < 8, "A").otherwise("B")).withColumn("ticker", F.concat(F.lit("T"), (F.col("s_suppkey") * 7).cast("string")))
    asked = {"text": {"text": "R#00000001"}, "tier": {"tier": "A", "low": 1000.0}, "all": {"tier": "B", "low": -500.0, "high": 5000.0, "text": "11"}}
    return reduce(DataFrame.unionByName, (searched(x, **how).select(F.lit(name).alias("search"), "s_suppkey", "s_name") for name, how in asked.items()))


@query
def i1_trades_window(s, d):
    t = T.trades_window(V.ticks(s, d), cadence="1 hour")
    return t.select("symbol", "window_start", "buy_volume", "sell_volume", *r("notional"), "n", "open", "high", "low", "close", "qty_max", *r("qty_mean"))


@query
def i6_asof_window(s, d):
    return T.asof_window(V.ticks(s, d), cadence="6 hours")


@query
def i7_settled(s, d):
    t = T.trades_window(V.ticks(s, d), cadence="1 hour")
    return T.settled(t, cadence_s=3600, now="2024-01-15 12:00:30", lag_s=90).select("symbol", "window_start", "n")


@query
def i12_sequence_gaps(s, d):
    t = J.running_last(V.ticks(s, d), {"before": F.col("event_id")}, by="symbol", t="event_id", strict=True)
    t = t.withColumn("pu", F.when(F.col("event_id") % 97 != 0, F.col("before")).otherwise(-1))
    return T.sequence_gaps(t.select("symbol", F.col("event_id").alias("u"), "pu").filter("pu is not null"))


@query
def i18_sessions(s, d):
    return T.sessions(V.ticks(s, d), gap="30 minutes")


@query
def j2_trailing_z(s, d):
    return B.trailing_z(V.bars(s, d), F.col("volume"), 240, 60).select("symbol", "d", *r("z", digits=5))


@query
def j3_cross_rank(s, d):
    return B.cross_rank(V.bars(s, d), "volume").select("symbol", "d", *r("cross_rank"))


INVENTORY = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts", "customer": None, "supplier": None, "part": None, "nation": None, "region": None, "documents": None, "embeddings": None, "pages": None, "benchmark": None, "labels": None, "conversations": None}


@query
def l10_table_inventory(s, d):
    """Rows and the span of the date column of every table; null where a table has none."""
    day = lambda f, c: (f(c).cast("date") if c else F.lit(None).cast("date"))
    parts = [V.table(s, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), day(F.min, c).alias("first_day"), day(F.max, c).alias("last_day")) for t, c in INVENTORY.items()]
    return reduce(DataFrame.union, parts)


def queries() -> dict[str, Query]:
    from . import decisions, discovery, equity, evaluation, intraday, upkeep  # noqa: F401 (registers its queries)

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    from . import oracle_discovery, oracle_equity, oracle_evaluation, oracle_intraday, oracle_paths, oracle_upkeep

    return {k: v for m in (oracle, oracle_paths, oracle_intraday, oracle_evaluation, oracle_upkeep, oracle_equity, oracle_discovery) for k, v in m.all_sql().items() if k in _queries}
