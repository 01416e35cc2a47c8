"""Queries over the decision ladders and the trade paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import decisions as D
from ..operators import paths as P
from ..sources import views as V
from .catalog import query, r


@query
def b6_tier_assign(s, d):
    c = V.candidates(s, d)
    observed = F.col("trades") % 6
    tier = D.assign_tier((F.col("num") * 23 % 101).cast("double"), F.col("catalyst"), F.col("risk"), (F.col("trades") % 11) / 10.0, observed)
    return c.select("symbol", "d", tier.alias("tier"))


@query
def b9_miss_classify(s, d):
    c = V.candidates(s, d)
    tier = F.when(F.col("num") % 5 == 0, "A").when(F.col("num") % 5 == 1, "C").when(F.col("num") % 5 == 2, "Incomplete").when(F.col("num") % 5 == 3, "Reject")
    window = F.element_at(F.array(*map(F.lit, (1, 3, 5, 10, 20, 60, 252, 7))), (F.col("num") % 8 + 1).cast("int"))
    universe = F.when(F.col("num") % 3 == 0, "primary").when(F.col("num") % 3 == 1, "extended")
    x = c.select("symbol", "d", (F.col("num") % 11 != 0).alias("in_universe"), F.col("quality").isNotNull().alias("scored"), F.col("quality").alias("score"), tier.alias("tier"), (F.col("trades") % 2 == 0).alias("has_evidence"), window.alias("window_days"), universe.alias("universe"))
    return D.classify_miss(x).select("symbol", "d", "label", "hint", *r("priority"))


@query
def b12_attribution_label(s, d):
    x = B.lag_returns(V.bars(s, d), [1])
    etf = x.filter("symbol = 'S0'").select("d", (F.col("ret_1") / 10).alias("etf"))
    own = x.select("symbol", "d", (F.col("ret_1") / 10).alias("own"))
    return own.join(etf, "d", "left").select("symbol", "d", D.sector_label(F.col("own"), F.col("etf")).alias("label"))


@query
def b13_symbol_guard(s, d):
    x = V.table(s, d, "customer").select("c_custkey", F.concat(F.upper(F.substring("c_name", 1, 4)), (F.col("c_custkey") % 50).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "USDT").when(F.col("c_custkey") % 3 == 1, "usdt").otherwise("-USDT")).alias("symbol"))
    return x.filter(F.col("symbol").rlike("^[A-Z0-9]+USDT$") & ~F.col("symbol").isin("CUST3USDT", "CUST6USDT"))


@query
def b14_instrument_classify(s, d):
    x = V.table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 5 == 0, "growth fund").when(F.col("p_partkey") % 5 == 1, "ETF").when(F.col("p_partkey") % 5 == 2, "ADR").when(F.col("p_partkey") % 5 == 3, "warrant")).alias("name"), F.concat(F.lit("T"), F.when(F.col("p_partkey") % 7 == 0, "."), (F.col("p_partkey") * 7).cast("string")).alias("t0"), F.concat(F.lit("T"), (F.col("p_partkey") * 7).cast("string")).alias("t1"))
    x = x.select("p_partkey", "name", F.coalesce("t0", "t1").alias("ticker"))
    return D.classify_instruments(x).select("p_partkey", "is_etf", "is_fund", "is_adr", "kept")


@query
def b15_industry_flags(s, d):
    kinds = V.facts(s, d).groupBy("symbol").agg(F.countDistinct(F.when((F.col("concept") == "P") & (F.col("value") > 300000), F.col("concept"))).alias("insurer"), F.countDistinct(F.when((F.col("concept") == "P") & (F.col("value") > 250000), F.col("concept"))).alias("bank"))
    names = V.table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("S"), (F.col("s_suppkey") % 10).cast("string")).alias("symbol"), F.upper(F.concat_ws(" ", "s_name", F.when(F.col("s_suppkey") % 4 == 0, "bancorp").when(F.col("s_suppkey") % 4 == 1, "assurance"))).alias("name"))
    kind = F.when(F.col("insurer") > 0, "insurer").when(F.col("bank") > 0, "bank").when(F.contains("name", F.lit("ASSURANCE")), "insurer").when(F.contains("name", F.lit("BANCORP")), "bank").otherwise("other")
    return names.join(kinds, "symbol", "left").select("s_suppkey", kind.alias("kind"))


@query
def b16_period_alignment(s, d):
    w = Window.partitionBy("symbol").orderBy("filing_date", "accession")
    f = V.filings(s, d).select("symbol", "accession", "form", F.col("filing_date").alias("period_end"), F.lag("filing_date", 40).over(w).alias("prior_end"), F.lag("form", 40).over(w).alias("prior_form")).filter("prior_end is not null")
    return D.period_alignment(f).select("accession", "gap_days", "period_type", "method", "status")


@query
def b18_market_clock(s, d):
    day = F.to_date("ts")
    holidays = V.ticks(s, d).select(F.date_add(F.trunc(day, "month"), 14).alias("day")).distinct()  # the 15th of each month
    x = D.busday_add(V.ticks(s, d).withColumn("day", day), "day", 10, holidays, name="settles")
    return x.select("event_id", "settles", D.forex_closed(F.col("ts")).alias("closed"), D.forex_close_floor(F.col("ts")).alias("close_floor"), D.prev_weekday(day).alias("prev_weekday"), D.weekdays_between(F.lit("2023-12-20").cast("date"), day).alias("weekdays"))


@query
def b19_pct_move(s, d):
    p = V.preds(s, d)
    x = p.join(p.groupBy("symbol").agg(F.max_by("close", "d").alias("last")), "symbol")
    return x.select("symbol", "d", F.round(D.pct_move(F.col("prob") < 0.5, F.col("ret"), F.col("close"), F.col("last")), 5).alias("move"))


@query
def b20_catalyst_adjustment(s, d):
    pick = lambda m, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.col("num") % m + 1).cast("int"))
    x = V.candidates(s, d).select("symbol", "d", pick(4, "merger_acquisition", "dividend", "guidance", "rumour").alias("kind"), pick(3, "high", "medium", "low").alias("materiality"), pick(5, "bullish", "bearish", "neutral", "bullish", "bearish").alias("sentiment"), (F.col("trades") % 13 / 10.0).alias("confidence"), pick(6, "valid", "weak", "valid", "valid", "invalid", "valid").alias("status"), (F.col("num") % 17 != 0).alias("quote_ok"), "risk", (F.col("num") % 120).cast("int").alias("days_since"), F.when(F.col("num") % 3 == 0, F.col("num") % 8 / 1.0).alias("spread"))
    return D.scaled_adjustment(x).select("symbol", "d", *r("adjustment", digits=11), "impact")


@query
def b23_confidence(s, d):
    n = sum((F.col(c).isNotNull().cast("double") * w for c, w in D.WEIGHTS.items()), F.lit(0.0))
    return V.candidates(s, d).select("symbol", "d", D.confidence(F.round(n, 6)).alias("confidence"))


@query
def b24_cost_tier(s, d):
    return B.volume_rank(V.bars(s, d), "2000-06-30", 90).withColumn("rank", F.col("rank") * 5).select("symbol", D.slippage_tier(F.col("rank")).alias("tier"), F.round(D.trade_cost(F.col("rank")), 6).alias("cost"))


@query
def b25_contract_to_coin(s, d):
    spec = F.broadcast(V.table(s, d, "region").select(F.col("r_regionkey").alias("k"), F.lit("0.001").cast("decimal(18,9)").alias("ct_val")))
    x = V.ticks(s, d).select("event_id", (F.col("event_id") % 7).alias("k"), F.col("qty").cast("decimal(18,0)").alias("size"))
    return x.join(spec, "k", "left").select("event_id", (F.col("size") * F.col("ct_val")).cast("double").alias("coins"))


@query
def d1_component_scores(s, d):
    c = V.candidates(s, d).select("symbol", F.year("d").alias("year"), F.month("d").alias("month"), *D.WEIGHTS, "risk", "num")
    long = c.drop("num").unpivot(["symbol", "year", "month"], [*D.WEIGHTS, "risk"], "grp", "score")
    return D.component_scores(long, ["symbol", "year", "month"]).select("symbol", "year", "month", *r(*D.WEIGHTS, "risk"), "total", "coverage", "observed")


def path(s, d, days=10):
    return P.expand(V.trades(s, d), V.bars(s, d), days=days)


def exits(df):
    return df.select("symbol", "d", "reason", "bar", *r("ret", digits=5))


@query
def k1_path_expand(s, d):
    return path(s, d).select("symbol", "d", "k", "day", *r("high", "low", "close", digits=8), "gap")


@query
def k2_fixed_tp(s, d):
    return exits(P.first_exit(path(s, d), [P.target(0.5)]))


@query
def k3_tp_sl(s, d):
    return exits(P.first_exit(path(s, d), [P.stop(F.col("entry") * 0.7), P.target(0.5)]))


@query
def k4_tp_atr_sl(s, d):
    atr = B.atr(V.bars(s, d), 14).select("symbol", "d", F.least("atr_pct", F.lit(0.4)).alias("atr_pct"))
    t = V.trades(s, d).join(atr, ["symbol", "d"], "left").filter("atr_pct is not null")
    p = P.expand(t, V.bars(s, d), days=10)
    return exits(P.first_exit(p, [P.stop(F.col("entry") * (1 - 1.5 * F.col("atr_pct"))), P.target(0.5)]))


@query
def k5_trailing(s, d):
    return exits(P.first_exit(path(s, d).withColumn("peak", P.prior_peak()), [P.trailing(0.1, 0.3)]))


@query
def k6_tiered(s, d):
    return exits(P.tiered(path(s, d), tp=0.5, trail=0.3))


@query
def k7_hard_floor(s, d):
    return exits(P.first_exit(path(s, d).withColumn("peak", P.prior_peak()), [P.stop(F.col("entry") * 0.6, "floor", at_open=True), P.trailing(0.1, 0.3)]))


@query
def k10_costs_net(s, d):
    x = P.first_exit(path(s, d), [P.target(0.5)])
    rank = B.volume_rank(V.bars(s, d), "2000-06-30", 90).select("symbol", (F.col("rank") * 5).alias("rank"))
    net = x.join(rank, "symbol", "left").withColumn("net", F.col("ret") - D.trade_cost(F.col("rank")))
    return net.select("symbol", "d", *r("ret", "net", digits=5))


@query
def k11_config_sweep(s, d):
    grid = F.array(*(F.struct(F.lit(i).alias("config"), F.lit(tp).alias("tp"), F.lit(sl).alias("sl")) for i, (tp, sl) in enumerate((tp, sl) for tp in (0.2, 0.5, 1.0) for sl in (0.2, 0.4))))
    low, high = F.col("entry") * (1 - F.col("sl")), F.col("entry") * (1 + F.col("tp"))
    x = P.sweep(path(s, d), grid, [("sl", lambda b: b.low <= low, lambda b: low), ("tp", lambda b: b.high >= high, lambda b: high)])
    return x.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 5).alias("mean_ret"), F.count_if(F.col("reason") == "tp").alias("tp"), F.count_if(F.col("reason") == "sl").alias("sl"), F.count_if(F.col("reason") == "data_gap").alias("gaps"))


@query
def j10_exit_grid(s, d):
    """First touch by multiples of the symbol's volatility and time caps; truncated paths give no result."""
    vol = B.realized_vol(V.bars(s, d), 20, scale=1, include_current=True).select("symbol", "d", F.least("vol", F.lit(0.3)).alias("vol"))
    t = V.trades(s, d).join(vol, ["symbol", "d"]).filter("vol > 0")
    grid = F.array(*(F.struct(F.lit(m).alias("mult"), F.lit(h).alias("cap")) for m in (1.0, 2.0) for h in (3, 8)))
    low, high = F.col("entry") * (1 - F.col("mult") * F.col("vol")), F.col("entry") * (1 + F.col("mult") * F.col("vol"))
    x = P.sweep(P.expand(t, V.bars(s, d), days=8), grid, [("sl", lambda b: b.low <= low, lambda b: low), ("tp", lambda b: b.high >= high, lambda b: high)], carry=("vol",), upto=F.col("cap"))
    return x.select("mult", "cap", "symbol", "d", "reason", "bar", *r("ret", digits=5))
