"""Decision ladders over columns: tiers, misses, periods, costs, catalyst adjustments, market clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

# They must equal those of the tool whose results these operators match.
WEIGHTS = {"cheap": 0.30, "quality": 0.25, "catalyst": 0.25, "momentum": 0.10, "sentiment": 0.10}
RISK_WEIGHT = 0.20
URGENCY = {1: 5, 3: 4, 5: 3, 10: 3, 20: 2, 60: 1, 252: 1}
STATIC = {("high", "bullish"): 5.0, ("high", "bearish"): -5.0, ("medium", "bullish"): 3.0, ("medium", "bearish"): -3.0, ("low", "bullish"): 1.5, ("low", "bearish"): -1.5}
SCOPE = {"merger_acquisition": 1.0, "earnings_surprise": 0.85, "regulatory": 0.75, "litigation_resolution": 0.70, "management_change": 0.50, "dividend": 0.60, "share_buyback": 0.55, "guidance": 0.80, "product_launch": 0.65, "partnership": 0.60}
FUND_WORDS = {"is_etf": ("ETF", "ISHARES", "SPDR", "VANGUARD", "INVESCO", "WISDOMTREE", "POWERSHARES", "PROSHARES", "DIREXION", "GRANITESHARES"), "is_fund": (" FUND", "TRUST", "REIT", "BDC", "MLP ", "PARTNERSHIP"), "is_adr": ("ADR", " ADS")}
DROP_WORDS = ("WARRANT", "UNIT SER", "PREFERRED", "NOTE DUE", "BOND DUE", "DEP SHS", "DEP SHARES", "DEPOSITARY", "ADR")
SLIPPAGE = {1: 0.0002, 2: 0.0005, 3: 0.0010}
ROUND_TRIP_FEE = 0.0007


def case(key: Column, table: dict, default) -> Column:
    """A value looked up in a small table."""
    out = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), table.items(), F)
    return out.otherwise(F.lit(default))


def component_scores(features: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, grp, score) to one column per component (mean score), the weighted total clamped to 0..100, coverage,
    the number of components seen. Components without a score add nothing; a missing risk counts as 50."""
    out = features.filter("score is not null").groupBy(*keys).pivot("grp", [*WEIGHTS, "risk"]).agg(F.avg("score"))
    seen = sum((F.col(c).isNotNull().cast("double") * w for c, w in WEIGHTS.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in WEIGHTS.items()), F.lit(0.0)) - RISK_WEIGHT * F.coalesce("risk", F.lit(50.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in WEIGHTS), F.lit(0))
    return out.withColumns({"total": F.round(C.clamp(total, 0.0, 100.0), 6), "coverage": F.round(seen / sum(WEIGHTS.values()), 6), "observed": n})


def confidence(coverage: Column) -> Column:
    return F.when(coverage >= 0.8, "high").when(coverage >= 0.5, "medium").when(coverage > 0, "low").otherwise("none")


def assign_tier(total: Column, catalyst: Column, risk: Column, coverage: Column, observed: Column) -> Column:
    catalyst, risk = F.coalesce(catalyst, F.lit(0.0)), F.coalesce(risk, F.lit(0.0))
    a = (total >= 75) & (catalyst >= 50) & (risk <= 50) & (coverage >= 0.8)
    return F.when(risk > 75, "Reject").when(observed < 2, "Incomplete").when(a, "A").when((total >= 60) & (coverage >= 0.65), "B").when(total >= 45, "C").otherwise("Reject")


def classify_miss(df: DataFrame) -> DataFrame:
    """Label, hint and priority of a move from in_universe, scored, score, tier, has_evidence, window_days, universe."""
    near = F.coalesce((F.col("score") >= 40) & (F.col("score") < 45), F.lit(False))
    tier = F.coalesce("tier", F.lit(""))
    label = F.when(~F.col("in_universe"), "universe_miss").when(~F.col("scored"), "unscored_mover").when(near, "near_threshold").when(tier.isin("A", "B"), "scored_correct").when(tier == "C", "scored_missed").otherwise("true_miss")
    out = df.withColumn("label", label)
    la = F.col("label")
    hint = F.when(la == "universe_miss", "universe_gap").when(la == "unscored_mover", "data_gap").when(la == "near_threshold", "near_threshold").when((la == "true_miss") & (tier == "Incomplete"), "data_gap").when(la == "true_miss", "scoring_blind_spot").when((la == "scored_missed") & ~F.col("has_evidence"), "catalyst_missed").when(la == "scored_missed", "scoring_blind_spot").otherwise("unknown")
    priority = case(F.col("window_days"), URGENCY, 0) + case(F.col("universe"), {"primary": 0.3, "extended": 0.1}, 0.0) + F.when(la == "near_threshold", 0.2).otherwise(0.0)
    return out.withColumns({"hint": hint, "priority": priority})


def period_alignment(df: DataFrame) -> DataFrame:
    """Whether two period ends are of one kind: by the forms' class where both have one, else by the gap in days."""
    kind = lambda f: F.when(F.upper(F.trim(f)).isin("10-K", "10-KSB", "20-F", "40-F", "10-KT"), "annual").when(F.upper(F.trim(f)).isin("10-Q", "10-QSB", "6-K", "10-QT"), "quarterly")
    a, b = kind(F.col("form")), kind(F.col("prior_form"))
    gap = F.abs(F.datediff("period_end", "prior_end"))
    by_form = a.isNotNull() & b.isNotNull()
    period = F.when(by_form, F.when(a == b, a)).when(gap.between(335, 395), "annual").when(gap.between(75, 105), "quarterly")
    return df.withColumns({"gap_days": gap, "period_type": period, "method": F.when(by_form, "form").otherwise("gap"), "status": F.when(period.isNotNull(), "aligned").otherwise("mismatched")})


def classify_instruments(df: DataFrame) -> DataFrame:
    """Flags from the words of a name, and whether the row stays among plain equities."""
    name = F.upper(F.coalesce("name", F.lit("")))
    has = lambda words: C.any_of([F.contains(name, F.lit(w)) for w in words])
    out = df.withColumns({k: has(words) for k, words in FUND_WORDS.items()})
    shape = ~F.col("ticker").rlike(r"[.\-+]") & (F.length("ticker") <= 5)
    return out.withColumn("kept", shape & ~has(DROP_WORDS) & ~F.col("is_etf") & ~F.col("is_fund"))


def sector_label(own: Column, etf: Column) -> Column:
    """Whether the sector explains a move."""
    rel, same, big = F.abs(own - etf), own * etf > 0, F.abs(etf) >= 0.01
    return F.when(etf.isNull() | own.isNull(), "peer_cluster_only_no_etf_data").when(same & big & (rel < 0.03), "sector_etf_confirmed").when(rel >= 0.03, "ticker_outperformed_sector").when(big & same, "sector_signal_underweighted").otherwise("peer_cluster_only_no_etf_data")


def pct_move(filled: Column, realised: Column, entry: Column, now: Column) -> Column:
    return F.when(filled & realised.isNotNull(), realised * 100).when(entry > 0, (now / entry - 1) * 100)


def _word(name: str, default: str) -> Column:
    """Lower-cased; null and empty are the default."""
    return F.coalesce(F.nullif(F.lower(name), F.lit("")), F.lit(default))


def scaled_adjustment(df: DataFrame) -> DataFrame:
    """static(materiality, sentiment) * confidence * scope * (spread haircut, else 90-day decay) * risk, within +-5."""
    bad = F.coalesce(F.col("status").isin("invalid", "invalid_quote", "weak", "rejected"), F.lit(False)) | ~F.coalesce("quote_ok", F.lit(True))
    static = case(F.concat_ws("/", _word("materiality", "medium"), _word("sentiment", "neutral")), {"/".join(k): v for k, v in STATIC.items()}, 0.0)
    conf = C.clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0)
    decay = F.greatest(F.lit(0.0), 1 - F.coalesce("days_since", F.lit(0)) / 90.0)
    market = F.when(F.col("spread") < 2, 0.20).when(F.col("spread") < 5, 0.55).when(F.col("spread").isNotNull(), 0.90).otherwise(decay)
    risk = F.when(F.col("risk").isNull(), 1.0).otherwise(F.greatest(F.lit(0.5), 1 - F.col("risk") / 200.0))
    raw = C.clamp(static * conf * case(F.col("kind"), SCOPE, 0.65) * market * risk, -5.0, 5.0)
    out = df.withColumn("adjustment", F.when(bad, 0.0).otherwise(raw))
    size = F.abs("adjustment")
    return out.withColumn("impact", F.when(size >= 3.5, "high").when(size >= 1.5, "medium").when(size > 0, "low").otherwise("none"))


def slippage_tier(rank: Column) -> Column:
    return F.when(rank.isNull() | (rank > 30), 3).when(rank <= 10, 1).otherwise(2)


def trade_cost(rank: Column) -> Column:
    """Fees of a round trip and slippage on both sides."""
    return ROUND_TRIP_FEE + 2 * case(slippage_tier(rank), SLIPPAGE, SLIPPAGE[3])


def forex_closed(ts: Column) -> Column:
    """From Friday 22:00 to Sunday 22:00."""
    day, hour = F.weekday(ts), F.hour(ts)
    return (day == 5) | ((day == 4) & (hour >= 22)) | ((day == 6) & (hour < 22))


def forex_close_floor(ts: Column) -> Column:
    """The last hourly bar before the close: the latest Friday's 21:00."""
    return F.date_sub(F.to_date(ts), (F.weekday(ts) + 3) % 7).cast("timestamp") + F.expr("interval 21 hours")


def prev_weekday(day: Column) -> Column:
    """The last day from Monday to Friday strictly before."""
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def weekdays_between(a: Column, b: Column) -> Column:
    """Days from Monday to Friday in [a, b]; 0 where a is after b. Whole weeks by arithmetic, no sequence."""
    upto = lambda x: F.floor((F.unix_date(x) + 3) / 7) * 5 + F.least((F.unix_date(x) + 3) % 7, F.lit(5))  # noqa: E731 (weekdays before x, from a Monday on)
    return F.when(a > b, F.lit(0)).otherwise(upto(F.date_add(b, 1)) - upto(a)).cast("int")


def business_days(first: Column, last: Column, bounds: DataFrame, holidays: DataFrame) -> DataFrame:
    """(day, k, open): every day from `first` to `last` (of the one row of bounds), whether it is a business day (Monday to Friday, not among
    holidays (day)), and how many business days lie before it. One row a calendar day, whatever the number of rows that ask."""
    days = bounds.select(F.explode(F.sequence(first, last)).alias("day"))
    closed = holidays.select(F.col("day").alias("_h")).distinct()
    days = days.join(closed, F.col("day") == F.col("_h"), "left").select("day", ((F.weekday("day") < 5) & F.col("_h").isNull()).alias("open"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.select("day", "open", F.coalesce(F.sum(F.col("open").cast("int")).over(before), F.lit(0)).alias("k"))


def busday_add(df: DataFrame, day: str, n: int, holidays: DataFrame, *, name: str) -> DataFrame:
    """Adds the n-th business day after `day`, counted from the first one at or after it: rank and select over a calendar that reaches
    far enough (each holiday can put it off by one business day at most). Null days give null."""
    ends = df.agg(F.min(day).alias("_from"), F.max(day).alias("_to"), F.lit(0).alias("_n")).filter("_from is not null")
    more = holidays.agg(F.countDistinct("day").alias("_more"))
    reach = F.date_add("_to", (F.lit(2 * n + 14) + 2 * F.col("_more")).cast("int"))
    calendar = business_days(F.col("_from"), reach, ends.crossJoin(F.broadcast(more)), holidays)
    at = calendar.select(F.col("day").alias("_day"), (F.col("k") + n).alias("_k"))
    then = calendar.filter("open").select("k", F.col("day").alias(name))
    return df.join(at.join(then, F.col("_k") == F.col("k")).select("_day", name), F.col(day) == F.col("_day"), "left").drop("_day")
