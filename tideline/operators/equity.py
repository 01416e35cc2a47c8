"""Features of a company as of a day, from bars, reported facts and filings, and the ladders that name causes and states.

Ladders take the first condition that holds. Thresholds, scores and names are fixed values, as results are compared by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import joins as J
from .bars import by_key
from .frames import framed, in_block

# Score steps (cuts, scores) and bounds of ratios.
RETURN_20, RETURN_60 = (-5.0, 5.0, 15.0), (-10.0, 10.0, 25.0)
MIN_SHARES, PS_BOUNDS, PE_BOUNDS, PB_BOUNDS, STALE_DAYS = 1_000_000, (0.05, 100.0), (0.0, 150.0), (0.0, 50.0), 180
MATERIAL = ("earn", "acqui", "merger", "divestiture", "agreement", "guidance", "revenue", "settlement", "dividend", "buyback", "restate")
MODEL_GAPS = ("Financials", "Real Estate", "Utilities")
VALIDATED, FAILED, WINDOW_DAYS = 0.10, -0.05, 126
EPISODE_GAIN, LOOKBACK_DAYS, FIRST_DAYS, LONG_DAYS, FLAT = 0.05, 27, 5, 20, 0.03
# Pattern, type, sentiment and rule, in order of priority.
CATALYSTS = (
    (r"definitive\s+(merger|acquisition)\s+agreement", "merger_acquisition", "bullish", "merger_agreement"),
    (r"(acquired|acquisition\s+of|to\s+be\s+acquired\s+by)", "merger_acquisition", "bullish", "acquisition"),
    (r"(quarterly|annual|fourth.quarter|third.quarter|second.quarter|first.quarter)\s+(earnings|results).{0,100}(per\s+share|EPS|revenue)", "earnings", "neutral", "earnings_release"),
    (r"(eps|earnings\s+per\s+share).{0,80}(exceeded|beat|surpassed|missed|below\s+estimates)", "earnings", "mixed", "earnings_surprise"),
    (r"(raise[sd]?|increase[sd]?|upward).{0,50}(full.year\s+)?(revenue\s+)?(guidance|outlook|forecast)", "guidance", "bullish", "guidance_raised"),
    (r"(lower[sd]?|reduce[sd]?|cut[sd]?|narrow[sd]?).{0,50}(guidance|outlook|forecast)", "guidance", "bearish", "guidance_lowered"),
    (r"(appointed|named|elected|promoted).{0,60}(chief\s+executive|chief\s+financial|president\s+and\s+ceo|ceo|cfo)\b", "management_change", "neutral", "exec_appointment"),
    (r"(resign[sed]*|step[ped]*\s+down|depart[sed]*|leaving).{0,60}(chief\s+executive|ceo|chief\s+financial|cfo)", "management_change", "bearish", "exec_departure"),
    (r"(settlement\s+agreement|agreed\s+to\s+pay|agreed\s+to\s+settle).{0,100}(million|billion|lawsuit|litigation|class\s+action)", "regulatory", "bearish", "legal_settlement"),
    (r"phase\s+[123].{0,100}(primary\s+endpoint|met.{0,20}endpoint|statistically\s+significant)", "regulatory", "bullish", "clinical_trial_positive"),
    (r"(fda\s+(approved|granted\s+approval|cleared)|510.?k\s+clearance)", "regulatory", "bullish", "fda_approval"),
    (r"(fda\s+(rejected|refused|issued\s+a\s+complete\s+response|crl)|complete\s+response\s+letter)", "regulatory", "bearish", "fda_rejection"),
    (r"(general\s+availability|ga\s+release|commercially\s+available|product\s+launch\b)", "product_launch", "bullish", "product_launch"),
    (r"(share\s+repurchase\s+program|buyback\s+program|repurchase\s+up\s+to)", "product_launch", "bullish", "buyback_program"),
)


def momentum(bars: DataFrame, *, least: int = 20) -> DataFrame:
    """As of each bar: returns over 20 and 60 rows (fewer where history is shorter), volume against the mean of the 20 rows before,
    distance from the high of 20 closes, and their scores. Null with fewer than `least` bars."""
    order, back = by_key(), lambda a, b: by_key().rowsBetween(a, b)
    x = bars.withColumn("rows", F.row_number().over(order))
    enough, first = F.col("rows") >= least, F.first("close").over(back(Window.unboundedPreceding, 0))
    ret = lambda k: F.when(enough, F.try_divide(F.col("close"), F.coalesce(F.lag("close", k).over(order), first)) * 100 - 100)
    x = x.withColumns({"ret_20": ret(20), "ret_60": ret(60), "spike": F.when(enough, F.try_divide(F.col("volume"), F.avg("volume").over(back(-20, -1)))), "drawdown": F.when(enough, F.try_divide(F.col("close"), F.max("close").over(back(-19, 0))) * 100 - 100)})
    top = lambda c, cuts: F.when(c > cuts[2], 80.0).when(c > cuts[1], 65.0).when(c >= cuts[0], 50.0).when(c.isNotNull(), 25.0)
    scores = {"score_20": top(F.col("ret_20"), RETURN_20), "score_60": top(F.col("ret_60"), RETURN_60), "spike_score": F.greatest(F.lit(0.0), F.least(F.lit(90.0), 50 + (F.col("spike") - 1) * 20)), "drawdown_score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + F.col("drawdown") * 2))}
    return x.withColumns({k: F.when(enough, v) for k, v in scores.items()})


def last_two(asof: DataFrame, facts: DataFrame, concepts: list[str]) -> DataFrame:
    """asof (symbol, as_of): of each concept the latest value at or before the day, the one before it, and when the latest was."""
    order = Window.partitionBy("symbol", "concept").orderBy("as_of_date", "fact_id")
    pairs = facts.withColumn("before", F.lag("value").over(order)).groupBy("symbol", "concept", "as_of_date").agg(F.max_by(F.struct("value", "before"), "fact_id").alias("p"))
    out = asof
    for c in concepts:
        own = pairs.filter(F.col("concept") == c).select("symbol", "as_of_date", F.col("p.value").alias(c), F.col("p.before").alias(f"{c}_before"))
        out = J.asof_join(out, own, by="symbol", left_t="as_of", right_t="as_of_date", values=[c, f"{c}_before"]).withColumnRenamed("match_t", f"{c}_at")
    return out


def quality(df: DataFrame) -> DataFrame:
    """df: income, revenue, shares, each with _before and _at. Growth, margin, dilution and sign of income with their scores; age of the
    facts, and whether they are stale."""
    n, r, r0, s, s0 = (F.col(c) for c in ("income", "revenue", "revenue_before", "shares", "shares_before"))
    growth = F.when(r0.isNotNull() & (r0 != 0), (r - r0) / F.abs(r0) * 100)
    margin = F.when((r != 0) & ~((n > 0) & (r > 0) & (n > r)), n / r * 100)
    out = df.withColumns({"income_score": F.when(n > 0, 70.0).when(n.isNotNull(), 30.0), "growth": F.when(F.abs(growth) <= 500, growth), "margin": margin, "dilution": F.when(s0 > 0, (s - s0) / s0 * 100)})
    out = out.withColumns({
        "growth_score": F.when(F.col("growth") > 20, 90.0).when(F.col("growth") > 10, 75.0).when(F.col("growth") >= 0, 60.0).when(F.col("growth").isNotNull(), 30.0),
        "margin_score": F.when(F.col("margin") > 20, 90.0).when(F.col("margin") > 10, 75.0).when(F.col("margin") > 0, 55.0).when(F.col("margin").isNotNull(), 20.0),
        "dilution_score": C.step_score(F.col("dilution"), [2.0, 5.0], [85.0, 65.0, 30.0]),
        "age": F.datediff("as_of", F.greatest("income_at", "revenue_at", "shares_at")),
    })
    return out.withColumn("confidence", F.when(F.col("age").isNull() | (F.col("age") <= STALE_DAYS), "medium").otherwise("low"))


def valuation(df: DataFrame) -> DataFrame:
    """df: close, high_52w, rows (of bars), revenue, shares, eps, equity. Price against the high of 52 weeks (20 bars at least), and
    price to sales, earnings and book within their bounds, with scores."""
    price, shares = F.col("close"), F.when(F.col("shares") >= MIN_SHARES, F.col("shares"))
    high = F.when((F.col("rows") >= 20) & (F.col("high_52w") > 0), price / F.col("high_52w") * 100)
    ps = F.when(F.col("revenue") > 0, price * shares / F.col("revenue"))
    pe = F.when(F.col("eps") > 0, price / F.col("eps"))
    pb = F.when((F.col("equity") > 0) & shares.isNotNull(), price / (F.col("equity") / shares))
    within = lambda c, b: F.when((c >= b[0]) & (c <= b[1]), c)
    out = df.withColumns({"vs_high": high, "ps": within(ps, PS_BOUNDS), "pe": within(pe, PE_BOUNDS), "pb": within(pb, PB_BOUNDS)})
    return out.withColumns({"high_score": C.clamp(100 - F.col("vs_high"), 0.0, 100.0), "ps_score": C.step_score(F.col("ps"), [1.0, 3.0, 10.0], [90.0, 70.0, 50.0, 20.0]), "pe_score": C.step_score(F.col("pe"), [10.0, 20.0, 30.0, 50.0], [90.0, 75.0, 55.0, 35.0, 15.0]), "pb_score": C.step_score(F.col("pb"), [1.0, 2.0, 5.0], [80.0, 65.0, 45.0, 20.0])})


def risk(df: DataFrame, scores: list[str]) -> DataFrame:
    """A penalty from 0 to 100: missing scores, income not positive, a price under 2, fewer than 20 bars, no filings."""
    missing = sum((F.col(c).isNull().cast("int") for c in scores), F.lit(0)) / float(len(scores))
    parts = [F.when(missing > 0.7, 35.0).when(missing > 0.4, 15.0), F.when(F.col("income") <= 0, 20.0), F.when(F.col("close") < 2.0, 20.0), F.when(F.coalesce("rows", F.lit(0)) < 20, 10.0), F.when(F.coalesce("n_filings", F.lit(0)) == 0, 15.0)]
    return df.withColumn("penalty", F.least(F.lit(100.0), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))))


def material(description: Column) -> Column:
    return F.coalesce(C.any_of([F.lower(description).contains(w) for w in MATERIAL]), F.lit(False))


def catalysts(months: DataFrame, filings: DataFrame, interest: DataFrame) -> DataFrame:
    """As of each month's end (symbol, as_of): 8-K filings of 30 days (material or routine), 10-Q and 10-K of 45 days, reports due within 14
    days, a change of short interest beyond 10%; signals and score. A filing meets the four month ends around it by an equal key."""
    around = filings.select("symbol", "form", "filing_date", "description", F.explode(F.array(*(F.last_day(F.add_months(F.trunc("filing_date", "month"), k)) for k in (-1, 0, 1, 2)))).alias("as_of"))
    age = F.datediff("as_of", "filing_date")
    is8, rep = F.col("form") == "8-K", F.col("form").isin("10-Q", "10-K")
    n = around.groupBy("symbol", "as_of").agg(F.count_if(is8 & age.between(0, 30)).alias("n_8k"), F.max(F.when(is8 & age.between(0, 30), F.col("description"))).alias("said"), F.count_if(rep & age.between(0, 45)).alias("n_reports"), F.count_if((F.col("form") == "10-Q") & age.between(-14, -1)).alias("n_due"))
    change = interest.withColumn("old", F.lag("interest").over(Window.partitionBy("symbol").orderBy("as_of"))).select("symbol", "as_of", F.when(F.col("old") > 0, (F.col("interest") - F.col("old")) / F.col("old") * 100).alias("si_change"))
    x = months.join(n, ["symbol", "as_of"], "left").join(change, ["symbol", "as_of"], "left").fillna(0, ["n_8k", "n_reports", "n_due"])
    got8, moved = F.col("n_8k") > 0, F.coalesce(F.abs("si_change") > 10, F.lit(False))
    points = [F.when(got8 & material(F.col("said")), 30.0).when(got8, 15.0), F.when(F.col("n_reports") > 0, 5.0), F.when(F.col("n_due") > 0, 25.0), F.when(moved, 15.0)]
    return x.withColumns({"score": F.least(F.lit(100.0), sum((F.coalesce(p, F.lit(0.0)) for p in points), F.lit(0.0))), "signals": sum((p.isNotNull().cast("int") for p in points), F.lit(0))})


def forward_outcomes(cands: DataFrame, bars: DataFrame, *, days: tuple[int, ...] = (1, 3, 5, 10, 20, 60, 120), frames: tuple[int, ...] = (20, 60), gains: tuple[float, ...] = (0.1, 0.2), loss: float = 0.1) -> DataFrame:
    """cands (symbol, d, close): returns to the first bar at or after each number of days, all in one as-of join; best and worst close of the
    next 20 and 60 bars; and for each gain whether one of the next 20 closes has it and none has lost `loss` (null without a next bar)."""
    asked = cands.select("symbol", "d", "close", F.explode(F.array(*map(F.lit, days))).alias("k")).withColumn("target", F.date_add("d", F.col("k")))
    found = J.asof_join(asked, bars.select("symbol", F.col("d").alias("t"), F.col("close").alias("then")), by="symbol", left_t="target", right_t="t", values=["then"], forward=True)
    points = found.groupBy("symbol", "d").agg(*(F.max(F.when(F.col("k") == k, F.try_divide("then", "close") - 1)).alias(f"ret_{k}d") for k in days))
    ahead = lambda g, k: F.try_divide(g("close").over(in_block().rowsBetween(1, k)), F.col("close")) - 1
    cols = {f"{name}_{k}": ahead(g, k) for k in frames for name, g in (("runup", F.max), ("drawdown", F.min))}
    b = framed(bars.select("symbol", "d", "close"), lambda x: x.withColumns(cols), after=max(frames))
    first = min(frames)
    hits = {f"hit_{round(100 * g)}": (F.col(f"runup_{first}") >= g) & (F.col(f"drawdown_{first}") > -loss) for g in gains}
    return points.join(b.withColumns(hits).drop("close"), ["symbol", "d"])


def episode_starts(events: DataFrame, bars: DataFrame, *, days: int = LOOKBACK_DAYS, rows: int = 5, gain: float = EPISODE_GAIN) -> DataFrame:
    """Adds to events (symbol, d) the first day and close of the earliest run of `rows` bars that gains `gain` from its first close to its last,
    begins within `days` days before the event and ends before it; null without one. The first run that begins late enough also
    ends first, so that one forward as-of join finds it."""
    last = Window.partitionBy("symbol").orderBy("d")
    runs = bars.select("symbol", F.col("d").alias("run_from"), F.col("close").alias("run_close"), F.lead("close", rows - 1).over(last).alias("top"), F.lead("d", rows - 1).over(last).alias("run_to"))
    runs = runs.filter((F.col("run_close") > 0) & (F.col("top") / F.col("run_close") - 1 >= gain))
    x = J.asof_join(events.withColumn("_from", F.date_sub("d", days)), runs, by="symbol", left_t="_from", right_t="run_from", values=["run_close", "run_to"], forward=True)
    before = F.col("run_to") < F.col("d")
    return x.select(*events.columns, F.when(before, F.col("match_t")).alias("run_from"), F.when(before, F.col("run_close")).alias("run_close"))


def lifecycle(events: DataFrame, bars: DataFrame, *, window_days: int = WINDOW_DAYS) -> DataFrame:
    """events (symbol, d): the event's bar is the first at or after its day. Returns since then and since the start of the move that led up to
    it, best and worst on the way, outcome, phase and actionability as of the symbol's last bar. Events after the last bar have insufficient data."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "d").alias("latest"), F.max("d").alias("latest_day"))
    later = Window.partitionBy("symbol").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    path = bars.select("symbol", "d", "close", F.max("close").over(later).alias("top"), F.min("close").over(later).alias("bottom"))
    x = episode_starts(events.select("symbol", "d"), bars)
    x = J.asof_join(x, path, by="symbol", left_t="d", right_t="d", values=["close", "top", "bottom"], forward=True).drop("match_t").join(last, "symbol", "left")
    ratio = lambda a, b: F.try_divide(a, b) - 1
    x = x.withColumns({"episode_start": F.coalesce("run_from", "d"), "since": ratio("latest", "close"), "since_episode": ratio("latest", F.coalesce("run_close", "close")), "runup": ratio("top", "close")})
    x = x.withColumns({"drawdown": ratio("bottom", "close"), "from_peak": ratio("latest", "top"), "elapsed": F.datediff("latest_day", "d")})
    x = x.withColumns({c: F.when(F.col("close").isNotNull(), F.col(c)) for c in ("since", "since_episode", "elapsed")})
    since, runup, elapsed = F.col("since"), F.col("runup"), F.col("elapsed")
    flat, over = F.abs(since) < FLAT, elapsed > window_days
    # fixed values: the names of outcomes, phases and actions
    outcome = (
        F.when(since.isNull(), "insufficient_data")
        .when((runup >= VALIDATED) & (since < runup / 2), "validated_then_faded")
        .when(since >= VALIDATED, "validated")
        .when(since <= FAILED, "failed")
        .when(over, "expired")
        .when(flat, "inconclusive")
        .otherwise("pending")
    )
    below = F.col("latest") < F.col("close")
    phase = (
        F.when(since.isNull(), "insufficient_data")
        .when(below & (runup > 0.02) & (since > F.col("drawdown")), "recovery_attempt")
        .when(below, "post_event_fade")
        .when(elapsed <= FIRST_DAYS, "initial_event_reaction")
        .when((elapsed > LONG_DAYS) & ~(since > 0), "post_event_fade")
        .when(over, "extended_move")
        .when((elapsed <= LONG_DAYS) & flat, "no_price_confirmation")
        .otherwise("continuation")
    )
    done = F.create_map(*(F.lit(v) for pair in {"insufficient_data": "insufficient_data", "validated": "context", "validated_then_faded": "investigate", "failed": "avoid", "expired": "expired"}.items() for v in pair))
    open_ = F.when(F.col("phase") == "initial_event_reaction", "high_priority").when(F.col("phase") == "post_event_fade", "investigate").otherwise("watch")
    return x.withColumns({"outcome": outcome, "phase": phase}).withColumn("action", F.coalesce(F.try_element_at(done, F.col("outcome")), open_))


def incomplete_subcause(df: DataFrame, today: Column) -> Column:
    """Why a company can't be scored whole: first of nine."""
    age = F.datediff(today, "last_filing")
    has = F.col("last_filing").isNotNull()
    return F.when(F.col("cik").isNull(), "missing_cik").when(F.col("active_sec") == F.lit(False), "missing_sec_companyfacts").when(F.coalesce("is_adr", F.lit(False)), "foreign_filer_or_adr").when(has & (age > STALE_DAYS), "stale_fundamentals").when(~has & F.col("market_cap").isNull(), "recent_ipo_or_short_history").when(F.col("sector").isin(*MODEL_GAPS), "sector_specific_model_gap").when(has & F.col("market_cap").isNull(), "polygon_fundamentals_missing").when(F.col("active_sec") & has, "ifrs_mapping_gap").otherwise("price_only_scored")


# Each cause's group, confidence and the fields that it rests on; what it means and what helps are in our words.
CAUSES = (
    ("universe_not_seeded", "universe_gap", "high", "was_in_universe,classification", "not in the universe, so never scored", "add the symbol to the universe"),
    ("pre_score_history", "data_gap", "high", "classification,score_join_method", "before the first score", "wait for more scores"),
    ("incomplete_fundamentals", "data_gap", "high", "tier_before_event", "fewer than two components of fundamentals", "add a source of fundamentals"),
    ("missing_cik", "data_gap", "high", "tier_before_event,companies.cik", "no filer number is mapped", "map the filer number"),
    ("missing_sec_companyfacts", "data_gap", "high", "tier_before_event,companies.cik,companies.active_sec_reporter", "a filer number, but no facts were loaded", "load the company's facts"),
    ("foreign_filer_or_adr", "data_gap", "high", "tier_before_event,companies.is_adr", "a foreign filer with other forms", "take fundamentals from another source"),
    ("stale_fundamentals", "data_gap", "high", "tier_before_event,companies.last_financial_filing_date", "the last filing is over 180 days old", "load facts again, or see whether it still reports"),
    ("recent_ipo_or_short_history", "data_gap", "medium", "tier_before_event,companies.last_financial_filing_date", "no filing is known yet", "none, history grows"),
    ("sector_specific_model_gap", "scoring_gap", "medium", "tier_before_event,companies.sector", "usual ratios don't fit the sector", "score the sector by its own model"),
    ("polygon_fundamentals_missing", "data_gap", "medium", "tier_before_event,companies.market_cap", "no market value is known", "load the company's details"),
    ("ifrs_mapping_gap", "data_gap", "medium", "tier_before_event,companies.cik,companies.active_sec_reporter", "reports, but under other concepts", "map the concepts, convert the currency"),
    ("price_only_scored", "data_gap", "low", "tier_before_event", "a market value, but no ratios", "compute ratios from the facts"),
    ("no_evidence_no_filing", "data_gap", "medium", "had_catalyst_evidence", "no text of a catalyst was found", "cover more filings and releases"),
    ("missing_earnings_context", "feature_gap", "medium", "event_date,events.event_date,events.event_type", "near earnings, without a signal of surprise", "add estimates of earnings"),
    ("sector_cluster_move", "feature_gap", "medium", "companies.sector,window_days,event_date", "peers of the sector moved as well", "compare with the sector's return"),
    ("low_catalyst_score", "scoring_gap", "medium", "scores.catalyst_score", "a weak catalyst", "look at the sources of catalysts"),
    ("low_quality_score", "scoring_gap", "low", "scores.quality_score", "weak quality", "look at the fundamentals' age"),
    ("near_threshold_no_catalyst", "near_miss", "medium", "score_before_event,scores.catalyst_score", "near the bar, without a catalyst", "better catalysts may lift it"),
    ("near_threshold_scored", "near_miss", "medium", "score_before_event,scores.catalyst_score", "near the bar", "look at the bar"),
    ("unknown", "unknown", "low", "", "the data don't say", "look into it"),
)


def explained(df: DataFrame) -> DataFrame:
    """Adds group, confidence, fields, meaning and fix of the cause (columns of these names are replaced); a cause that isn't listed counts as unknown. The list has twenty rows."""
    names = ("_cause", "group", "confidence", "fields", "meaning", "fix")
    listed = df.sparkSession.createDataFrame(CAUSES, ", ".join(f"{n} string" for n in names))
    known = F.when(F.col("cause").isin(*(c[0] for c in CAUSES)), F.col("cause")).otherwise("unknown")
    return df.drop(*names).join(F.broadcast(listed), known == F.col("_cause")).drop("_cause")


def root_cause(df: DataFrame) -> DataFrame:
    """Why a move was missed: first of ten. df has the outcome of the joins as columns."""
    low_catalyst = F.coalesce(F.col("catalyst") < 30, F.lit(False))
    cause = F.when(F.col("classification") == "universe_miss", "universe_not_seeded").when(F.col("classification") == "unscored_mover", "pre_score_history").when(F.col("tier") == "Incomplete", F.col("subcause")).when(F.col("near_earnings"), "missing_earnings_context").when(F.col("in_cluster"), "sector_cluster_move").when(~F.coalesce("evidence", F.lit(False)), "no_evidence_no_filing").when(F.col("near_threshold") & low_catalyst, "near_threshold_no_catalyst").when(F.col("near_threshold"), "near_threshold_scored").when(low_catalyst, "low_catalyst_score").when(F.col("quality") < 40, "low_quality_score").otherwise("unknown")
    return df.withColumn("cause", cause)


def catalyst_rule(text: Column) -> Column:
    """type, sentiment and rule of the first pattern that the text has, whatever its case; null without any."""
    out = F.lit(None).cast("struct<type: string, sentiment: string, rule: string>")
    for pattern, kind, sentiment, rule in reversed(CATALYSTS):
        out = F.when(text.rlike(f"(?i){pattern}"), F.struct(F.lit(kind).alias("type"), F.lit(sentiment).alias("sentiment"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def peer_returns(events: DataFrame, members: DataFrame, returns: DataFrame) -> DataFrame:
    """events (symbol, d), members (symbol, theme), many to many: of each event and theme the number, median and mean of the returns of
    the theme's other members on that day."""
    asked = events.join(members, "symbol").select(F.col("symbol").alias("own"), "theme", "d")
    peers = returns.join(members, "symbol")
    met = asked.join(peers, ["theme", "d"]).filter("symbol <> own and ret is not null")
    return met.groupBy(F.col("own").alias("symbol"), "d", "theme").agg(F.count("*").alias("peers"), F.percentile("ret", 0.5).alias("median"), F.avg("ret").alias("mean"))


def net_pnl(positions: DataFrame, funding: DataFrame, reconciled: DataFrame, *, fee: float = 0.001) -> DataFrame:
    """positions (symbol, d, entry, mark, qty, exit_day), funding (symbol, d, funding), reconciled (symbol, until): gross + funding - commission, where
    the symbol is reconciled up to the last fill; else only the gross counts and the state says so."""
    x = positions.join(funding, ["symbol", "d"], "left").join(reconciled, "symbol", "left")
    gross = (F.col("mark") - F.col("entry")) * F.col("qty")
    commission = (F.col("entry") + F.col("mark")) * F.col("qty") * fee
    done = F.coalesce(F.col("until") >= F.col("exit_day"), F.lit(False))
    net = F.when(done, gross + F.coalesce("funding", F.lit(0.0)) - commission)
    return x.withColumns({"gross": gross, "net": net, "state": F.when(done, "reconciled").otherwise("pending")})


def running_total(df: DataFrame, by: str, day: str, value: str) -> DataFrame:
    """Sums by day and their running total: the window runs over days, not rows."""
    daily = df.groupBy(by, day).agg(F.sum(value).alias("step"))
    return daily.withColumn("total", F.sum("step").over(Window.partitionBy(by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)))


def quantile_atoms(long: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, value): interior cuts by the exclusive method, rounded to 12 places, distinct, each with > and <. Values are counted
    first, so that the running counts go over distinct values; features of one value give none."""
    counts = long.filter("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("feature").orderBy("value")
    ranked = counts.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "following": F.lead("value").over(w)})
    total = counts.groupBy("feature").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("kinds > 1")
    wanted = total.select("feature", "total", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("i"))
    at = F.greatest(F.lit(1), F.least(F.col("total") - 1, F.floor(F.col("i") * (F.col("total") + 1) / bins)))
    wanted = wanted.withColumn("at", at).withColumn("delta", F.col("i") * (F.col("total") + 1) - F.col("at") * bins)
    # the at-th smallest value lies where the counts first reach `at`; the next one is it again or the value that follows
    met = wanted.join(ranked, "feature").filter((F.col("upto") >= F.col("at")) & (F.col("upto") - F.col("n") < F.col("at")))
    high = F.when(F.col("upto") > F.col("at"), F.col("value")).otherwise(F.col("following"))
    cuts = met.select("feature", F.round((F.col("value") * (bins - F.col("delta")) + high * F.col("delta")) / bins, 12).alias("cut")).distinct()
    return cuts.select("feature", F.explode(F.array(F.lit(">"), F.lit("<"))).alias("op"), "cut")


def investigation_flags(df: DataFrame) -> DataFrame:
    """Labels of a missed move in their order, of which the first is the primary one. df has the outcome of the joins as columns; where
    no label fits, the move counts as unpredictable."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    filed, low = yes("has_filing"), yes("catalyst_low")
    quiet = ~(filed & low) & ~yes("evidence") & ~filed
    labels = ((~yes("in_universe"), "not_in_universe"), (~yes("has_price"), "missing_price_data"), (~yes("has_facts"), "missing_fundamentals"), (yes("near_threshold"), "threshold_too_strict"), (filed & low & yes("material"), "text_evidence_available_not_classified"), (filed & low & yes("material"), "needs_llm_text_enrichment"), (filed & low & ~yes("material"), "routine_event_correctly_suppressed"), (quiet & yes("scored"), "no_public_catalyst_source_found"), (quiet & ~yes("scored"), "price_move_without_known_catalyst"))
    found = F.filter(F.array(*(F.when(c, name) for c, name in labels)), lambda x: x.isNotNull())
    out = df.withColumn("labels", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("truly_unpredictable"))))
    return out.withColumns({"primary_label": F.element_at("labels", 1), "text_needed": filed & low & yes("material")})
