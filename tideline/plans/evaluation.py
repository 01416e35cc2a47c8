"""Queries over joins (continued), evaluation of predictions and trades, and table upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import accounts as AC
from ..operators import aggregates as A
from ..operators import bars as B
from ..operators import coverage as CV
from ..operators import decisions as D
from ..operators import intervals as IV
from ..operators import joins as J
from ..operators import paths as P
from ..operators.frames import deal, gather
from ..sources import views as V
from .catalog import query, r


def scored(s, d):
    return V.preds(s, d).filter("hit is not null")


@query
def a9_replace_slice(s, d):
    b = V.bars(s, d).select("symbol", "d", "trades")
    new = b.filter("d = date '1999-06-01'").withColumn("trades", F.col("trades") + 1000)
    return b.filter("d <> date '1999-06-01'").unionByName(new)


@query
def a11_roster_parity(s, d):
    """Roster entries that the store lacks or holds with another count."""
    w = V.hours(s, d).select("symbol", "h", "trades")
    store = w.filter("hour(h) <> 7").select("symbol", "h", F.when(F.hour("h") == 9, F.col("trades") + 1).otherwise(F.col("trades")).alias("stored"))
    x = w.join(store, ["symbol", "h"], "left")
    return x.select("symbol", "h", F.when(F.col("stored").isNull(), "missing").when(F.col("stored") != F.col("trades"), "mismatch").alias("problem")).filter("problem is not null")


@query
def a12_infer_gaps(s, d):
    """Spans that unreadable fragments covered, from the readable ones around them."""
    f = V.hours(s, d).groupBy("symbol", F.to_date("h").alias("day")).agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    bad = F.dayofmonth("day") % 9 == 0
    w = Window.partitionBy("symbol").orderBy("day")
    before = F.last(F.when(~bad, F.col("hi")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(~bad, F.col("lo")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    x = f.select("symbol", "day", bad.alias("bad"), before.alias("a"), after.alias("b")).filter("bad")
    return x.select("symbol", "day", F.coalesce("a", "b").alias("gap_start"), F.coalesce("b", "a").alias("gap_end"))


@query
def c2_left_lookup(s, d):
    sup = V.table(s, d, "supplier").groupBy((F.col("s_suppkey") % 10).alias("k")).agg(F.round(F.sum("s_acctbal"), 2).alias("cap"))
    dim = sup.select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("symbol"), "cap").filter("cap > 0")
    return V.bars(s, d).join(dim, "symbol", "left").select("symbol", "d", "cap")


@query
def c3_cross_scalar(s, d):
    h = V.hours(s, d)
    last = F.broadcast(h.agg(F.max("h").alias("latest")))
    x = h.groupBy("symbol").agg(F.max("h").alias("own")).crossJoin(last)
    return x.select("symbol", "own", ((F.unix_timestamp("latest") - F.unix_timestamp("own")) / 3600).cast("int").alias("hours_behind"))


@query
def c7_row_range_having(s, d):
    w = Window.partitionBy("symbol").orderBy("d").rowsBetween(1, 10)
    b = V.bars(s, d).select("symbol", "d", F.max("high").over(w).alias("top"), F.min("low").over(w).alias("bottom"), F.count("*").over(w).alias("n"))
    p = V.preds(s, d).filter("prob >= 0.8").select("symbol", "d")
    return p.join(b, ["symbol", "d"]).filter("n = 10").select("symbol", "d", *r("top", "bottom", digits=8))


@query
def c10_attach_series(s, d):
    w = Window.orderBy("t")  # one row a week
    x = V.facts(s, d).filter("concept = 'F'").groupBy(F.date_trunc("week", "as_of_date").cast("date").alias("t")).agg(F.avg("value").alias("v")).withColumn("step", F.col("v") - F.lag("v").over(w))
    y = J.attach_series(V.bars(s, d).select("symbol", "d"), x, values=["v", "step"])
    return y.select("symbol", "d", F.round("v", 9).alias("level"), F.round(F.when(F.col("exact"), F.col("step")), 9).alias("step"))


@query
def c15_cluster(s, d):
    e = B.lag_returns(V.bars(s, d), [1]).filter("ret_1 > 3").select("symbol", "d", (F.substring("symbol", 2, 2).cast("int") % 2).alias("grp"))
    return J.clusters(e, days=3, others=2).select("symbol", "d", "others")


@query
def c16_near(s, d):
    f = V.filings(s, d).filter("form = '8-K'").select("symbol", F.col("filing_date").alias("t"))
    return J.near(V.bars(s, d).select("symbol", "d", "trades"), f, days=7)


@query
def c17_point_lookup(s, d):
    keys = V.preds(s, d).filter("prob >= 0.95").select("symbol", "d")
    x = B.lag_returns(V.bars(s, d), [60]).select("symbol", "d", F.round("ret_60", 6).alias("ret_60"))
    return keys.join(x, ["symbol", "d"], "left").filter("ret_60 is not null")


@query
def c18_interval_overlap(s, d):
    """Six-hour spans after each hour against half-hour gaps, which hold for all symbols."""
    sec = F.unix_timestamp("h")
    spans = V.hours(s, d).select("symbol", "h", sec.alias("a"), (sec + 6 * 3600).alias("b"), F.lit(0).alias("_all"))
    gaps = V.hours(s, d).filter("symbol = 'U3' and hour(h) = 5").select(F.lit(0).alias("_all"), sec.alias("a"), (sec + 1800).alias("b"))
    return IV.overlapping(spans, gaps, by="_all").select("symbol", "h", "overlaps")


@query
def c20_pair_spread(s, d):
    x = V.bars(s, d).filter("symbol in ('S1', 'S2')").groupBy("d").pivot("symbol", ["S1", "S2"]).agg(F.max("close"))
    return x.filter("S1 is not null and S2 is not null").select("d", F.round(F.col("S1") - F.col("S2"), 7).alias("spread"))


@query
def c22_leak_check(s, d):
    runs = V.preds(s, d).groupBy("model").agg(F.date_add(F.min("d"), 30).alias("train_end"))
    return V.preds(s, d).join(F.broadcast(runs), "model").filter("d <= train_end").groupBy("model").agg(F.count("*").alias("n"), F.max("d").alias("last_day"))


@query
def c24_latest_mark(s, d):
    pos = V.preds(s, d).filter("prob >= 0.95").select("symbol", "d", "close", (F.year("d") - 1990).alias("qty"))
    mark = V.bars(s, d).groupBy("symbol").agg(F.max_by("close", "d").alias("mark"))
    x = pos.join(mark, "symbol")
    return x.groupBy("symbol").agg(F.round(F.sum((F.col("mark") - F.col("close")) * F.col("qty")), 2).alias("unrealised"), F.count("*").alias("n"))


@query
def c25_merge_last_seen(s, d):
    t = V.ticks(s, d)
    one = lambda n, i: F.when(F.col("event_id") % 3 == i, F.col("price")).alias(n)
    x = J.last_seen(t.select("symbol", "event_id", one("mark", 0), one("index", 1), one("funding", 2)), ["mark", "index", "funding"], by="symbol", t="event_id")
    return x.filter("mark is not null").select("symbol", "event_id", *r("last_mark", "last_index", "last_funding"))


@query
def d8_run_summary(s, d):
    """Trades with a stop and a target, a run a year, net of fees, slippage and funding."""
    x = P.first_exit(P.expand(V.trades(s, d), V.bars(s, d), days=10), [P.stop(F.col("entry") * 0.7), P.target(0.5)])
    x = x.withColumns({"run": F.year("d"), "exit_day": F.date_add("d", F.col("bar")), "holding": F.col("bar").cast("double"), "fee": F.lit(D.ROUND_TRIP_FEE), "slippage": F.lit(2 * D.SLIPPAGE[3]), "funding": (F.col("bar") % 3) * 0.0001})
    y = A.run_summary(x.withColumn("net", F.col("ret") - F.col("fee") - F.col("slippage") + F.col("funding")), "run")
    return y.select("run", "n", "n_days", *r(*(c for c in y.columns if c not in ("run", "n", "n_days")), digits=5))


@query
def d13_calibration_runs(s, d):
    return A.calibration_runs(A.reliability(scored(s, d), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])).select("side", "first", "length", "place")


@query
def d14_tolerance_checks(s, d):
    """Three checks: the rate at high probabilities within a quarter of the whole rate, a lift of 1.3 in the model's last 30 days, 200 rows."""
    p = scored(s, d).withColumn("y", F.col("hit").cast("double"))
    last = p.groupBy("model").agg(F.date_sub(F.max("d"), 30).alias("since"))  # one row a model
    high = F.col("prob") >= 0.6
    recent = F.col("d") > F.col("since")
    x = p.join(last, "model").groupBy("model").agg(F.count("*").alias("n"), F.avg("y").alias("base"), F.avg(F.when(high, F.col("y"))).alias("top"), F.avg(F.when(recent, F.col("y"))).alias("base_30"), F.avg(F.when(recent & high, F.col("y"))).alias("top_30"))
    lift, lift_30 = (F.round(F.try_divide(F.col(a), F.col(b)), 6) for a, b in (("top", "base"), ("top_30", "base_30")))
    near, lifted, enough = F.coalesce((lift >= 0.75) & (lift <= 1.25), F.lit(False)), F.coalesce(lift_30 >= 1.3, F.lit(False)), F.col("n") >= 200
    return x.select("model", "n", lift.alias("lift"), lift_30.alias("lift_30"), near.alias("rate_ok"), lifted.alias("lift_ok"), enough.alias("sample_ok"), F.when(~enough, "INTERIM").when(near & lifted, "PASS").otherwise("FAIL").alias("verdict"))


@query
def d15_accumulation_eta(s, d):
    p = V.filings(s, d)
    x = p.groupBy("form").agg(F.count("*").alias("n"), F.count_if(F.col("filing_date") > F.date_sub(F.lit("2001-07-31").cast("date"), 7)).alias("week"))
    return x.select("form", "n", "week", F.round(F.try_divide(F.lit(1e6) - F.col("n"), F.col("week") / 7.0), 3).alias("days_left"))


@query
def d21_median_impute(s, d):
    x = B.lag_returns(V.bars(s, d), [60]).select("symbol", "d", F.col("ret_60").alias("x"), F.when(F.dayofmonth("d") % 3 != 0, F.col("volume")).alias("y"))
    return A.impute_medians(x.filter("d < date '1998-01-01'"), x.filter("d >= date '1998-01-01'"), ["x", "y"]).select("symbol", "d", "slice", *r("x", "y"))


@query
def d25_coverage_ratio(s, d):
    return A.coverage_ratio(V.bars(s, d)).select("d", "n", *r("ratio"), "state")


@query
def d25_covered_day(s, d):
    """Filings by form and bars by month of the year: the latest day with enough rows, and what that says of the source."""
    filed = V.filings(s, d).filter("filing_date <= date '2001-07-31'").select(F.concat(F.lit("filings "), "form").alias("source"), F.col("filing_date").alias("day"))
    sold = V.bars(s, d).filter("d <= date '2000-03-31'").select(F.concat(F.lit("bars of "), F.month("d")).alias("source"), F.col("d").alias("day"))
    x = CV.covered_day(filed, by="source", day="day", today=F.lit("2001-08-01").cast("date"))
    y = CV.covered_day(sold, by="source", day="day", today=F.lit("2000-04-03").cast("date"), share=1.0)
    return x.unionByName(y).select("source", "latest", "n", "gap", "expected", "covered", "state")


@query
def d26_freshness(s, d):
    """Age of the last row by kind, of filings and of bars, each with its own bounds."""
    today = F.lit("2001-08-02").cast("date")
    def state(last, table, fresh, stale):
        age = F.datediff(today, "last_day")
        return last.select(F.lit(table).alias("table"), "symbol", "form", age.alias("age"), F.when(age <= fresh, "fresh").when(age <= stale, "stale").otherwise("missing").alias("state"))

    filed = V.filings(s, d).groupBy("symbol", "form").agg(F.max("filing_date").alias("last_day"))
    traded = V.bars(s, d).groupBy("symbol", F.lit("bar").alias("form")).agg(F.max("d").alias("last_day"))
    return state(filed, "filings", 2, 30).unionByName(state(traded, "bars", 980, 984))


@query
def d27_outcome_by(s, d):
    """Outcomes by bucket of the score, tier, horizon and model: one pass, each row counted once a dimension."""
    p = F.col("prob")
    dims = {"bucket": F.when(p >= 0.8, "80+").when(p >= 0.7, "70-79").when(p >= 0.6, "60-69").when(p >= 0.5, "50-59").otherwise("<50"), "tier": F.when(p >= 0.75, "A").when(p >= 0.6, "B").otherwise("C"), "horizon": F.col("horizon"), "model": F.col("model").cast("string")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in dims.items())))
    x = scored(s, d).select("hit", F.log1p("ret").alias("ret"), each.alias("e")).select("hit", "ret", "e.*")
    return x.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(F.avg("ret"), 6).alias("mean_ret"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("rate"))


@query
def d27_component_means(s, d):
    """Mean of each component and of the outcome, by whether the outcome was a hit."""
    x = V.candidates(s, d).join(scored(s, d).select("symbol", "d", "hit", F.log1p("ret").alias("ret")), ["symbol", "d"])
    return x.groupBy("hit").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("cheap", "quality", "catalyst", "momentum", "sentiment", "risk", "ret")))


@query
def d27_feature_coverage(s, d):
    """Features by symbol and year: all, present and their share."""
    names = ["cheap", "quality", "catalyst", "momentum", "sentiment", "risk"]
    x = V.candidates(s, d).groupBy("symbol", F.year("d").alias("year")).agg((F.count("*") * len(names)).alias("features"), sum((F.count(c) for c in names), F.lit(0)).alias("present"))
    return x.select("symbol", "year", "features", "present", F.round(F.col("present") * 100.0 / F.col("features"), 6).alias("pct"))


@query
def d28_two_sample_t(s, d):
    x = V.preds(s, d).filter("ret is not null").withColumn("lr", F.log1p("ret"))
    return A.pooled_t(x, F.col("prob") >= 0.5, "lr").select("na", "nb", *r("ma", "mb", "t", digits=5))


@query
def d29_quintile_spread(s, d):
    x = A.quantile_bins(V.preds(s, d).filter("ret is not null").withColumn("lr", F.log1p("ret")), "prob", 5)
    means = x.groupBy("bin").agg(F.count("*").alias("n"), F.avg("lr").alias("mean"), F.var_samp("lr").alias("var"))
    pick = lambda c, b: F.max(F.when(F.col("bin") == b, F.col(c)))
    ends = means.agg((pick("mean", 1) - pick("mean", 5)).alias("spread"), F.sqrt(pick("var", 1) / pick("n", 1) + pick("var", 5) / pick("n", 5)).alias("se"))
    return means.crossJoin(F.broadcast(ends)).select("bin", "n", *r("mean", "spread"), F.round(F.try_divide(F.col("spread"), F.col("se")), 5).alias("t"))


@query
def d33_monthly_regime(s, d):
    m = V.bars(s, d).filter("symbol = 'S0'").groupBy(F.trunc("d", "month").alias("month")).agg((F.max_by("close", "d") / F.min_by("close", "d") - 1).alias("ch"))
    regime = F.when(F.col("ch") > 0.05, "bull").when(F.col("ch") < -0.05, "bear").otherwise("neutral")
    x = scored(s, d).withColumn("month", F.trunc("d", "month")).join(F.broadcast(m.select("month", regime.alias("regime"))), "month")
    return x.groupBy("regime").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("rate"), F.round(F.avg("ret"), 5).alias("mean_ret"))


@query
def d34_friction_sweep(s, d):
    costs = F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 1.0)))).alias("cost")
    x = V.preds(s, d).filter("ret is not null").select("*", costs).withColumn("ret", F.col("ret") - F.col("cost"))
    return A.trade_stats(x, ["cost"]).join(A.event_day_sharpe(x, ["cost"]), "cost").select("cost", "n", *r("win_rate", "mean_ret", "sharpe", digits=5))


@query
def d35_leave_one_out(s, d):
    return A.leave_one_out(V.preds(s, d).filter("ret is not null").withColumn("ret", F.log1p("ret"))).select("month", *r("sharpe", "ratio", digits=5))


@query
def d36_config_ranking(s, d):
    x = A.event_day_sharpe(V.preds(s, d).filter("ret is not null"), ["model", "horizon"]).withColumn("sharpe", F.round("sharpe", 6))
    best = x.orderBy(F.col("sharpe").desc_nulls_last(), "model", "horizon").limit(10)
    place = F.row_number().over(Window.orderBy(F.col("sharpe").desc_nulls_last(), "model", "horizon"))  # ten rows
    return best.select("model", "horizon", "sharpe", place.alias("place"))


@query
def d36_sensitivity(s, d):
    """The best of all models, horizons and thresholds by Sharpe, and what one other value on each axis makes of it."""
    grid = F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))
    p = V.preds(s, d).filter("ret is not null").withColumn("threshold", F.explode(F.filter(grid, lambda t: t <= F.col("prob"))))
    runs = A.event_day_sharpe(p, ["model", "horizon", "threshold"]).withColumn("sharpe", F.round("sharpe", 6))
    return AC.sensitivity(runs, ["model", "horizon", "threshold"], "sharpe", ["n_days", "sharpe"])


@query
def d37_recurring_keys(s, d):
    x = V.preds(s, d).groupBy("symbol", "model").agg(F.sort_array(F.collect_set(F.col("d").cast("string"))).alias("days"))
    return x.filter(F.size("days") > 1).select("symbol", "model", F.size("days").alias("n"), F.concat_ws(",", "days").alias("days"))


@query
def d38_shadow_cap(s, d):
    c = V.candidates(s, d).withColumn("adj", (F.col("num") % 9 - 4).cast("double"))
    x = c.groupBy("symbol", F.trunc("d", "month").alias("month")).agg(C.clamp(F.sum("adj"), -5.0, 5.0).alias("adj"), F.max(F.col("num") * 23 % 101).cast("double").alias("score"))
    tier = lambda v: D.assign_tier(v, F.lit(60.0), F.lit(10.0), F.lit(0.9), F.lit(5))
    old, new = tier(F.col("score")), tier(F.col("score") + F.col("adj"))
    return x.select("symbol", "month", "adj", new.alias("tier"), F.when(old == new, "same").when(F.col("adj") > 0, "up").otherwise("down").alias("move"))


@query
def d39_rule_aggregates(s, d):
    b = B.lag_returns(B.realized_vol(deal(V.bars(s, d), before=21, after=5), 20, scale=1, include_current=True), [1])
    x = gather(B.forward_labels(b, [5], 0.5)).filter("vol > 0 and fwd_max_5 is not null")
    rule = F.when(F.col("ret_1") > 1, "up").when(F.col("ret_1") < -0.5, "down").otherwise("quiet")
    return x.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit_5").cast("double")), 6).alias("rate"), F.round(F.avg(F.log1p("fwd_max_5") / F.col("vol")), 5).alias("mean_norm"))


@query
def d40_promotion_gate(s, d):
    x = A.hit_rate(scored(s, d), ["model"]).withColumn("old", F.lag("rate").over(Window.orderBy("model")))  # one row a model
    return x.select("model", *r("rate", "old"), F.when(F.col("old").isNull() | (F.col("old") == 0), True).otherwise(F.round(F.col("rate") - 0.9 * F.col("old"), 9) >= 0).alias("passed"))


@query
def d40_legacy_gates(s, d):
    """Gates of the tables as they are: enough outcomes, discrimination of the last model, flawed reviews, thin features, one group's share, days of
    runs. Each is one aggregate; none sees rows of another."""
    c, p = V.candidates(s, d), scored(s, d)
    seen = sum((F.col(x).isNotNull().cast("int") for x in D.WEIGHTS), F.lit(0))
    groups = c.groupBy((F.substring("symbol", 2, 2).cast("int") % 3).alias("g")).agg(F.count("*").alias("n"))
    gate = lambda df, name, value, bound, least: df.agg(F.lit(name).alias("gate"), value.cast("double").alias("value")).select("gate", "value", F.lit(bound).alias("bound"), F.coalesce((F.col("value") >= bound) if least else (F.col("value") <= bound), F.lit(True)).alias("passed"))
    share = lambda cond: F.avg(cond.cast("double"))
    made = [gate(p, "sample_size", F.count("*"), 100.0, True), gate(A.auc(p, "model"), "discrimination", F.max_by("auc", "model"), 0.55, True), gate(c, "flawed_reviews", share((F.col("num") % 8).isin(1, 2, 3, 5)), 0.30, False), gate(c, "thin_features", share(seen < 3), 0.40, False), gate(groups, "concentration", F.max("n") / F.sum("n"), 0.50, False), gate(p.select("model").distinct(), "stability", F.count("*"), 5.0, True)]
    return reduce(DataFrame.unionByName, made).select("gate", *r("value"), "bound", "passed")


@query
def d43_fold_stability(s, d):
    p = scored(s, d)
    e = F.col("prob") - F.col("hit").cast("double")
    x = p.groupBy("model").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("base"), F.avg(F.when(F.col("prob") >= 0.8, F.col("hit").cast("double"))).alias("top"), F.avg(e * e).alias("brier"))
    y = x.join(A.auc(p, "model"), "model")
    trend = y.agg(F.regr_slope("auc", "model").alias("auc_trend"), F.regr_slope("brier", "model").alias("brier_trend"))  # one row
    return y.crossJoin(F.broadcast(trend)).select("model", "first_day", "last_day", "n", *r("base", "top", "brier", "auc", "auc_trend", "brier_trend"))
