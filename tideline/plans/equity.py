"""Queries over company features, outcomes, causes and discovery atoms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import bars as B
from ..operators import equity as E
from ..operators import joins as J
from ..operators import reports as R
from ..sources import tape as S
from ..sources import views as V
from .catalog import query, r

TODAY = "2001-08-02"


def fundamentals(s, d):
    """Reported facts named as income, revenue and shares; income may be negative."""
    names = F.when(F.col("concept") == "F", "income").when(F.col("concept") == "O", "revenue").otherwise("shares")
    value = F.when(names == "income", F.col("value") - 120_000).when(names == "revenue", F.col("value") * 3).otherwise(F.col("value") * 20)
    return V.facts(s, d).select("symbol", names.alias("concept"), value.alias("value"), "as_of_date", "fact_id")


def months(s, d):
    return V.bars(s, d).select("symbol", F.last_day("d").alias("as_of")).distinct()


def reported(s, d):
    return E.last_two(months(s, d), fundamentals(s, d), ["income", "revenue", "shares"])


def priced(s, d):
    """The last bar of each month with the high of 52 weeks and the number of bars so far."""
    w = B.by_key().rowsBetween(-10_000, 0)
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    year = F.max("high").over(B.by_key().orderBy(day).rangeBetween(-364, 0))
    x = V.bars(s, d).withColumns({"rows": F.count("*").over(w), "high_52w": year})
    return x.groupBy("symbol", F.last_day("d").alias("as_of")).agg(*(F.max_by(c, "d").alias(c) for c in ("close", "rows", "high_52w")))


def valued(s, d):
    x = reported(s, d).join(priced(s, d), ["symbol", "as_of"])
    return E.valuation(x.withColumns({"eps": F.col("income") / 2000, "equity": F.col("revenue_before") * 4000, "revenue": F.col("revenue") * 4000}))


def big_moves(s, d):
    return B.lag_returns(V.bars(s, d), [1]).filter("abs(ret_1) > 0.2")


@query
def a6_snapshot_read(s, d):
    x = S.read_snapshots(s, f"{d}/events.parquet", time="ts", floor="2024-01-08 00:00:00", columns=["event_id", "user_id", "ts"], where=F.col("event_type") != "view")
    return x.select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


def tape(s, d):
    return V.ticks(s, d).select("symbol", F.to_date("ts").alias("date"), "ts", "event_id", "price")


def written(s, d):
    """The ticks as a tape of files by symbol and day, in the shared folder."""
    path = S.work_path(s)
    S.write_partitioned(tape(s, d), path, ["symbol", "date"])
    return path


@query
def a1_tape_scan(s, d):
    x = S.tape_scan(s, written(s, d), tape(s, d).schema, symbols=["U1", "U2", "U7"], after="2024-01-05 12:00:00", before="2024-01-20 00:00:00")
    return x.select("event_id", "symbol", *r("price"))


@query
def a5_partitioned_sink(s, d):
    x = s.read.schema(tape(s, d).schema).parquet(written(s, d))
    return x.groupBy("symbol", "date").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query
def a10_compact_partitions(s, d):
    return S.compact(s, written(s, d), S.work_path(s), by=["symbol", "date"], sort_by=["ts", "event_id"]).select("symbol", F.col("date").cast("date").alias("date"), "rows_in", "rows_out", "same")


@query
def a14_report_export(s, d):
    """A report of fixed columns as JSON lines, read back: what the table lacks is null, what the report lacks is left out."""
    path = S.work_path(s)
    S.export(V.bars(s, d).select("symbol", F.col("d").cast("string").alias("d"), "trades", "volume"), path, "json", ["symbol", "d", "trades", "note"])
    return s.read.schema("symbol string, d string, trades long, note string").json(path)


@query
def b10_incomplete_subcause(s, d):
    """Attributes from the supplier's key and balance, as the given tables have no registry of companies."""
    k, pick = F.col("s_suppkey"), lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("s_suppkey") % len(v) + 1).cast("int"))
    x = V.table(s, d, "supplier").select("s_suppkey", F.when(k % 11 != 0, k).alias("cik"), F.when(k % 3 != 0, k % 5 != 0).alias("active_sec"), (F.col("s_nationkey") % 6 == 0).alias("is_adr"), F.when(k % 4 != 0, F.date_sub(F.lit(TODAY).cast("date"), (k * 7 % 230).cast("int"))).alias("last_filing"), F.when(F.col("s_acctbal") > 2000, F.col("s_acctbal")).alias("market_cap"), pick("Energy", "Financials", "Health", "Utilities", "Tech", "Tech", "Real Estate").alias("sector"))
    return x.select("s_suppkey", E.incomplete_subcause(x, F.lit(TODAY).cast("date")).alias("subcause"))


@query
def b11_root_cause(s, d):
    moves = big_moves(s, d).select("symbol", "d")
    c = V.candidates(s, d).select("symbol", "d", "num", "catalyst", "quality").join(moves, ["symbol", "d"])
    due = V.filings(s, d).filter("form = '10-Q'").select("symbol", F.col("filing_date").alias("t"))
    near = J.near(moves, due, days=2).distinct().withColumn("near_earnings", F.lit(True))
    grouped = J.clusters(moves.withColumn("grp", F.substring("symbol", 2, 2).cast("int") % 3), days=1, others=3).select("symbol", "d").distinct().withColumn("in_cluster", F.lit(True))
    x = c.join(near, ["symbol", "d"], "left").join(grouped, ["symbol", "d"], "left").fillna(False, ["near_earnings", "in_cluster"])
    n = F.col("num")
    x = x.withColumns({"classification": F.when(n % 17 == 0, "universe_miss").when(n % 13 == 0, "unscored_mover").otherwise("scored_miss"), "tier": F.when(n % 6 == 0, "Incomplete").otherwise("B"), "subcause": F.when(n % 4 == 0, "missing_cik").otherwise("price_only_scored"), "evidence": n % 7 != 0, "near_threshold": n % 5 == 0})
    return E.explained(E.root_cause(x)).select("symbol", "d", "cause", "group", "confidence", "fields")


@query
def b22_lifecycle(s, d):
    return E.lifecycle(big_moves(s, d), V.bars(s, d)).select("symbol", "d", "episode_start", *r("since", "since_episode", "runup", "drawdown", "from_peak"), "elapsed", "outcome", "phase", "action")


@query
def c21_theme_join(s, d):
    n = F.substring("symbol", 2, 2).cast("int")
    members = V.bars(s, d).select("symbol").distinct().select("symbol", F.explode(F.array(F.concat(F.lit("odd"), n % 2), F.concat(F.lit("third"), n % 3))).alias("theme"))
    returns = B.lag_returns(V.bars(s, d), [5]).select("symbol", "d", F.col("ret_5").alias("ret"))
    return E.peer_returns(big_moves(s, d).select("symbol", "d"), members, returns).select("symbol", "d", "theme", "peers", *r("median", "mean"))


@query
def d41_net_pnl(s, d):
    p = V.preds(s, d).filter("prob >= 0.8 and peak is not null").select("symbol", "d", F.col("close").alias("entry"), (F.col("close") * F.col("peak")).alias("mark"), (1 + F.year("d") % 3).cast("double").alias("qty"), F.date_add("d", 5).alias("exit_day"))
    rates = V.filings(s, d).select("symbol", F.col("filing_date").alias("day"), (F.col("accession") % 7 - 3).cast("double").alias("rate"))
    until = V.filings(s, d).filter("form = '10-K'").groupBy("symbol").agg(F.date_sub(F.max("filing_date"), 300).alias("until"))
    x = E.net_pnl(p, J.hold_sum(p, rates, days=5), until)
    off = lambda c: F.round(F.col(c) + 1e-7, 4).alias(c)  # noqa: E731 (half cents of cents round alike in both engines)
    return x.select("symbol", "d", off("gross"), off("net"), "state")


@query
def e19_forward_outcomes(s, d):
    c = V.bars(s, d).select("symbol", "d", "close")
    x = E.forward_outcomes(c, c)
    return x.select("symbol", "d", *r("ret_1d", "ret_3d", "ret_5d", "ret_10d", "ret_20d", "ret_60d", "ret_120d", "runup_20", "runup_60", "drawdown_20", "drawdown_60"), "hit_10", "hit_20")


@query
def e21_running_equity(s, d):
    return E.running_total(V.preds(s, d).filter("ret is not null"), "model", "d", "ret").select("model", "d", *r("step", "total"))


@query
def e23_quality_features(s, d):
    x = E.quality(reported(s, d))
    return x.select("symbol", "as_of", *r("income", "growth", "margin", "dilution", digits=4), "income_score", "growth_score", "margin_score", "dilution_score", "age", "confidence")


@query
def e24_valuation_features(s, d):
    return valued(s, d).select("symbol", "as_of", *r("vs_high", "ps", "pe", "pb", "high_score", digits=4), "ps_score", "pe_score", "pb_score")


def company_days(s, d):
    """Each company at the ends of the months in which it reports, with a name and a price."""
    n = F.substring("symbol", 2, 9).cast("int")
    name = F.when(n % 9 == 0, "First Bancorp").when(n % 10 == 0, "Alpha Reinsurance Co").when(n % 11 == 0, "National Bank Insurance").when(n % 4 != 0, "Acme")
    x = V.statements(s, d).select("symbol", F.last_day("day").alias("as_of")).distinct().withColumn("name", name)
    return x.withColumns({"close": (3 + n % 97).cast("double"), "rows": F.lit(250), "high_52w": (3 + n % 97) * 1.25})


@query
def e23_industry_guard(s, d):
    """Growth and margin of each symbol and month, with the confidence that its industry allows."""
    n = F.substring("symbol", 2, 2).cast("int")
    x = E.quality(reported(s, d)).withColumns({"is_bank": n % 3 == 0, "is_insurer": n % 4 == 1})
    return R.industry_confidence(x).select("symbol", "as_of", *r("growth", "margin", digits=4), "growth_confidence", "margin_confidence", "margin_warning")


@query
def e24_guarded_valuation(s, d):
    """Ratios from figures chosen by the priority of their concepts, with the guards of industry, filer and currency."""
    foreign = V.table(s, d, "orders").filter("o_orderkey % 31 = 0")
    filed = foreign.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), F.lit("20-F").alias("form"), F.to_date("o_orderdate").alias("day"))
    x = R.guarded_valuation(R.prioritised(company_days(s, d), V.statements(s, d), filed))
    return x.select("symbol", "as_of", *r("ps", "pe", "pb", digits=4), "ps_score", "pe_score", "pb_score", "ps_reason", "pe_reason", "pb_reason", "is_bank", "is_insurer", "is_foreign", "currency")


@query
def e25_momentum_features(s, d):
    return E.momentum(V.bars(s, d)).select("symbol", "d", *r("ret_20", "ret_60", "spike", "drawdown", "spike_score", "drawdown_score", digits=5), "score_20", "score_60")


@query
def e26_risk_features(s, d):
    n = V.filings(s, d).filter("form = '8-K'").groupBy("symbol", F.last_day("filing_date").alias("as_of")).agg(F.count("*").alias("n_filings"))
    x = E.quality(valued(s, d)).join(n, ["symbol", "as_of"], "left").withColumn("close", F.col("close") / 700)
    return E.risk(x, ["high_score", "ps_score", "pe_score", "pb_score", "growth_score", "margin_score", "dilution_score", "income_score"]).select("symbol", "as_of", "penalty")


@query
def e27_catalyst_features(s, d):
    say = F.when(F.col("accession") % 3 == 0, "Entry into a definitive merger agreement").otherwise("Other events")
    f = V.filings(s, d).withColumn("description", say)
    interest = V.bars(s, d).groupBy("symbol", F.last_day("d").alias("as_of")).agg(F.sum("volume").alias("interest"))
    return E.catalysts(months(s, d), f, interest).select("symbol", "as_of", "n_8k", "n_reports", "n_due", *r("si_change", digits=5), "score", "signals")


@query
def h5_catalyst_rules(s, d):
    """Headlines by the order's key, as the given tables have none."""
    said = ("Company signs definitive merger agreement with peer", "To be acquired by a rival in cash", "Reports quarterly results, revenue up", "EPS of 2.10 beat consensus", "Raises full-year revenue guidance", "Cuts outlook for the year", "Board named a new chief executive", "CFO to step down, leaving as CFO", "Agreed to pay 40 million over lawsuit", "Phase 2 study met its primary endpoint", "FDA approved the device", "Receives complete response letter", "General availability of version 4", "Board authorises share repurchase program", "Nothing of note")
    text = F.element_at(F.array(*map(F.lit, said)), (F.col("o_orderkey") % len(said) + 1).cast("int"))
    x = V.table(s, d, "orders").select("o_orderkey", E.catalyst_rule(text).alias("c"))
    return x.select("o_orderkey", F.col("c.type").alias("type"), F.col("c.sentiment").alias("sentiment"), F.col("c.rule").alias("rule"))


@query
def h12_math(s, d):
    x = F.col("price")
    return V.ticks(s, d).select("event_id", F.round(F.ln(x + 1), 9).alias("ln"), F.round(F.log10(x + 1), 9).alias("log10"), F.round(F.sqrt(x), 9).alias("root"), F.abs(x - 50).alias("off"), F.greatest(x, F.lit(20.0)).alias("top"), F.least(x, F.lit(80.0)).alias("low"), F.floor(x).cast("long").alias("whole"), F.round(F.sin(x), 9).alias("sine"), F.round(F.cos(x), 9).alias("cosine"), F.greatest(F.lit(10.0), F.least(F.lit(90.0), x)).alias("held"))


@query
def j1_base_features(s, d):
    """Scalars of each symbol-hour from its bar and its quotes, one row a feature."""
    key = F.struct("ts", "event_id")
    q = V.quotes(s, d).groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(F.avg(F.col("ask") - F.col("bid")).alias("spread"), F.max_by("bid", key).alias("bid"), F.max_by("ask", key).alias("ask"), F.avg("bid_qty").alias("bq"), F.avg("ask_qty").alias("aq"))
    x = V.hours(s, d).join(q, ["symbol", "h"])
    ratio = lambda a, b: F.try_divide(a, b)
    made = {"total_vol": F.col("volume"), "taker_buy_ratio": ratio(F.col("taker_buy"), F.col("volume")), "trade_count": F.col("trades").cast("double"), "price_range": ratio(F.col("high") - F.col("low"), F.col("open")), "ret_co": ratio(F.col("close") - F.col("open"), F.col("open")), "rel_spread": ratio(F.col("spread"), (F.col("bid") + F.col("ask")) / 2), "book_imbalance": ratio(F.col("bq"), F.col("bq") + F.col("aq"))}
    long = x.select("symbol", "h", *(v.alias(k) for k, v in made.items())).unpivot(["symbol", "h"], list(made), "feature", "value")
    return long.filter("value is not null").select("symbol", "h", "feature", *r("value", digits=7))


@query
def j4_quantile_atoms(s, d):
    return E.quantile_atoms(j1_base_features(s, d)).select("feature", "op", F.round("cut", 9).alias("cut"))


@query
def k9_entry_rules(s, d):
    """Entries at the open of the hour that lies exactly a day and two hours after the signal's hour; signals without that hour go."""
    h = V.hours(s, d)
    signals = h.filter("close > 90").select("symbol", F.col("h").alias("signal"), (F.col("h") + F.expr("interval 26 hours")).alias("h"))
    return signals.join(h.select("symbol", "h", "open"), ["symbol", "h"]).select("symbol", "signal", F.col("h").alias("entry_at"), *r("open"))


@query
def l9_investigation_flags(s, d):
    moves = big_moves(s, d).select("symbol", "d")
    c = V.candidates(s, d).select("symbol", "d", "num", "catalyst").join(moves, ["symbol", "d"])
    f = V.filings(s, d).filter("form = '8-K'").select("symbol", "filing_date", (F.col("accession") % 3 == 0).alias("material"))
    spread = f.select("symbol", F.explode(F.sequence(F.col("filing_date"), F.date_add("filing_date", 2))).alias("d"), "material").groupBy("symbol", "d").agg(F.max("material").alias("material"))
    first = V.facts(s, d).groupBy("symbol").agg(F.date_add(F.min("as_of_date"), 400).alias("since"))
    x = c.join(spread.withColumn("has_filing", F.lit(True)), ["symbol", "d"], "left").join(first, "symbol", "left")
    n = F.col("num")
    x = x.withColumns({"in_universe": n % 17 != 0, "has_price": n % 19 != 0, "has_facts": F.col("since") <= F.col("d"), "near_threshold": n % 5 == 0, "catalyst_low": F.col("catalyst") < 50, "evidence": n % 2 == 0, "scored": n % 3 != 0})
    return E.investigation_flags(x).select("symbol", "d", F.concat_ws(",", "labels").alias("labels"), "primary_label", "text_needed")
