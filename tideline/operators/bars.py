"""Window operators over bars: (symbol, d, open, high, low, close, volume, trades, taker_buy). Features look back only;
labels look forward only. Frames of bounded length run over blocks of rows (`frames`); running values are partitioned by the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from .frames import BLOCK, NUMBER, framed, in_block


def by_key(key: str = "symbol", t: str = "d") -> WindowSpec:
    return Window.partitionBy(key).orderBy(t)


def lag_returns(df: DataFrame, ks: Sequence[int]) -> DataFrame:
    """close / close k rows before - 1; NULL where the base is NULL or not positive."""
    base = {k: F.lag("close", k).over(in_block()) for k in ks}
    cols = {f"ret_{k}": F.when(b > 0, F.col("close") / b - 1) for k, b in base.items()}
    return framed(df, lambda x: x.withColumns(cols), before=max(ks))


def sma_distance(df: DataFrame, n: int, *, min_rows: int = 0) -> DataFrame:
    out = safe_ratio(F.col("close"), F.avg("close").over(in_block().rowsBetween(-(n - 1), 0))) - 1
    out = F.when(F.col(NUMBER) >= min_rows, out) if min_rows else out
    return framed(df, lambda x: x.withColumn(f"sma_dist_{n}", out), before=n - 1)


def bollinger(df: DataFrame, n: int, *, zero: float | None = None) -> DataFrame:
    w = in_block().rowsBetween(-(n - 1), 0)
    sd = F.stddev_samp("close").over(w)
    out = F.when(sd == 0, F.lit(zero).cast("double")).otherwise((F.col("close") - F.avg("close").over(w)) / (2 * sd))
    return framed(df, lambda x: x.withColumn("bollinger", out), before=n - 1)


def extreme_distance(df: DataFrame, n: int) -> DataFrame:
    """Drawdown from the high and rally from the low of n rows back and the current one, and the place between."""
    w = in_block().rowsBetween(-n, 0)
    hi, lo = F.max("close").over(w), F.min("close").over(w)
    cols = {
        "drawdown": safe_ratio(F.col("close"), hi) - 1,
        "rally": safe_ratio(F.col("close"), lo) - 1,
        "place": safe_ratio(F.col("close") - lo, hi - lo),
    }
    return framed(df, lambda x: x.withColumns(cols), before=n)


def realized_vol(df: DataFrame, n: int, *, scale: float, include_current: bool, min_obs: int = 2) -> DataFrame:
    """stddev_samp of log returns over the preceding n rows, or the trailing n with the current one, annualised."""
    step = F.ln(safe_ratio(F.col("close"), F.lag("close").over(in_block())))
    w = in_block().rowsBetween(-(n - 1), 0) if include_current else in_block().rowsBetween(-n, -1)
    sd = F.when(F.count("_lr").over(w) >= min_obs, F.stddev_samp("_lr").over(w))
    make = lambda x: x.withColumn("_lr", step).withColumn("vol", sd * float(scale) ** 0.5).drop("_lr")
    return framed(df, make, before=n + 1)


def atr(df: DataFrame, n: int) -> DataFrame:
    prev = F.lag("close").over(in_block())
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    mean = F.avg("true_range").over(in_block().rowsBetween(-(n - 1), 0))
    make = lambda x: x.withColumn("true_range", span).withColumn("atr_pct", safe_ratio(mean, F.col("close")))
    return framed(df, make, before=n)


def relative_volume(df: DataFrame, n: int, cap: float) -> DataFrame:
    mean = F.avg("volume").over(in_block().rowsBetween(-n, -1))
    out = F.when(mean > 0, F.least(F.lit(float(cap)), F.col("volume") / mean))
    return framed(df, lambda x: x.withColumn("rel_volume", out), before=n)


def rolling_slope(df: DataFrame, n: int) -> DataFrame:
    """Slope of volume on the row number over n rows by its mean; NULL before n rows."""
    w = in_block().rowsBetween(-(n - 1), 0)
    slope = F.regr_slope(F.col("volume"), F.col(NUMBER)).over(w)
    out = F.when(F.col(NUMBER) >= n, safe_ratio(slope, F.avg("volume").over(w)))
    return framed(df, lambda x: x.withColumn("volume_slope", out), before=n - 1)


def rolling_beta(df: DataFrame, bench: DataFrame, n: int, min_obs: int) -> DataFrame:
    """covar_pop / var_pop of one-row returns against the benchmark's of the same day."""
    own = lag_returns(df, [1]).select("symbol", "d", F.col("ret_1").alias("r"))
    other = lag_returns(bench, [1]).select("d", F.col("ret_1").alias("b"))
    w = in_block().rowsBetween(-(n - 1), 0)
    both = own.join(other, "d").filter(F.col("r").isNotNull() & F.col("b").isNotNull())
    beta = F.when(F.count("*").over(w) >= min_obs, safe_ratio(F.covar_pop("r", "b").over(w), F.var_pop("b").over(w)))
    return framed(both, lambda x: x.withColumn("beta", beta), before=n - 1)


def relative_return(df: DataFrame, bench: DataFrame, k: int, *, missing: float | None = None) -> DataFrame:
    own = lag_returns(df, [k])
    other = lag_returns(bench, [k]).select("d", F.col(f"ret_{k}").alias("b"))
    b = F.coalesce("b", F.lit(missing)) if missing is not None else F.col("b")
    return own.join(other, "d", "left").withColumn("rel_return", F.col(f"ret_{k}") - b).drop("b")


def candle_shape(df: DataFrame) -> DataFrame:
    span, top, bottom = F.col("high") - F.col("low"), F.greatest("open", "close"), F.least("open", "close")
    cols = {
        "body": safe_ratio(F.abs(F.col("close") - F.col("open")), span),
        "upper_wick": safe_ratio(F.col("high") - top, span),
        "lower_wick": safe_ratio(bottom - F.col("low"), span),
        "close_in_range": F.when(span == 0, 0.5).otherwise(safe_ratio(F.col("close") - F.col("low"), span)),
        "gap": safe_ratio(F.col("open"), F.lag("close").over(in_block())) - 1,
    }
    return framed(df, lambda x: x.withColumns(cols), before=1)


def streaks(df: DataFrame) -> DataFrame:
    """Consecutive bars that closed above, or below, the one before."""
    step = F.signum(F.col("close") - F.lag("close").over(by_key()))
    out = df.withColumn("_s", F.coalesce(step, F.lit(0.0)))
    out = out.withColumn("_new", (F.col("_s") != F.coalesce(F.lag("_s").over(by_key()), F.lit(0.0))).cast("int"))
    out = out.withColumn("_run", F.sum("_new").over(by_key().rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("d"))
    return out.withColumns({"up_streak": F.when(F.col("_s") > 0, n).otherwise(0), "down_streak": F.when(F.col("_s") < 0, n).otherwise(0)}).drop("_s", "_new", "_run")


def forward_labels(df: DataFrame, horizons: Sequence[int], threshold: float) -> DataFrame:
    """Per horizon h: the point return (NULL without h rows ahead), the best and worst close ahead (of what is there), and
    whether the best reaches the threshold."""
    cols = {}
    for h in horizons:
        w = in_block().rowsBetween(1, h)
        best = safe_ratio(F.max("close").over(w), F.col("close")) - 1
        cols[f"fwd_ret_{h}"] = safe_ratio(F.lead("close", h).over(in_block()), F.col("close")) - 1
        cols[f"fwd_max_{h}"] = best
        cols[f"fwd_min_{h}"] = safe_ratio(F.min("close").over(w), F.col("close")) - 1
        cols[f"hit_{h}"] = best >= threshold
    return framed(df, lambda x: x.withColumns(cols), after=max(horizons))


def knockout(df: DataFrame, tp: float, sl: float, h: int) -> DataFrame:
    """Which comes first within h bars: a high at +tp or a low at -sl; in one bar the stop."""
    up = F.array(*(F.lead("high", k).over(in_block()) for k in range(1, h + 1)))
    down = F.array(*(F.lead("low", k).over(in_block()) for k in range(1, h + 1)))
    first = lambda bars, met: F.try_element_at(F.expr(f"filter(transform({bars}, (x, i) -> if({met}, i + 1, null)), x -> x is not null)"), F.lit(1))
    stop = F.col("_down").isNotNull() & (F.col("_up").isNull() | (F.col("_down") <= F.col("_up")))
    found = {"_up": first("_u", f"x >= close * {1 + tp}D"), "_down": first("_d", f"x <= close * {1 - sl}D")}
    outcome = {
        "outcome": F.when(stop, "stop").when(F.col("_up").isNotNull(), "target").otherwise("none"),
        "bar": F.when(stop, F.col("_down")).otherwise(F.col("_up")),
    }
    make = lambda x: x.withColumns({"_u": up, "_d": down}).withColumns(found).withColumns(outcome).drop("_u", "_d", "_up", "_down")
    return framed(df, make, after=h)


def trail_line(df: DataFrame, *, activation: float, trail: float) -> DataFrame:
    """Running peak since the first bar, and the stop: below the peak by a share of the gain once armed."""
    w = by_key().rowsBetween(Window.unboundedPreceding, 0)
    entry = F.first("close").over(w)
    peak = F.max("close").over(w)
    line = F.when(peak >= entry * (1 + activation), peak - (peak - entry) * trail).otherwise(entry * (1 + activation))
    return df.withColumns({"peak": peak, "line": line})


def dominance(df: DataFrame, bench: str) -> DataFrame:
    """The benchmark's share of the day's volume, and log10 of volume * close, 1 at least."""
    day = Window.partitionBy("d")
    own = F.sum(F.when(F.col("symbol") == bench, F.col("volume"))).over(day)
    return df.withColumns({"bench_share": safe_ratio(own, F.sum("volume").over(day)), "log_dollar": F.log10(F.greatest(F.lit(1.0), F.col("volume") * F.col("close")))})


def volume_rank(df: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = df.filter((F.col("d") <= F.lit(as_of).cast("date")) & (F.col("d") > F.date_sub(F.lit(as_of).cast("date"), days)))
    mean = recent.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("dollar"))
    return mean.withColumn("rank", F.rank().over(Window.orderBy(F.col("dollar").desc())))


def breakouts(df: DataFrame, days: int = 252) -> DataFrame:
    """First bar per symbol whose close is above the highest of the preceding calendar days."""
    out = df.withColumn("_n", F.datediff("d", F.lit("1970-01-01").cast("date")))
    before = Window.partitionBy("symbol").orderBy("_n").rangeBetween(-days, -1)
    out = out.withColumn("prior_high", F.max("close").over(before)).filter(F.col("close") > F.col("prior_high"))
    return out.withColumn("_k", F.row_number().over(by_key())).filter("_k = 1").drop("_n", "_k")


def gap_days(df: DataFrame) -> DataFrame:
    """Calendar days without a bar between a symbol's first and last."""
    spans = df.groupBy("symbol").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    every = spans.select("symbol", F.explode(F.sequence("a", "b")).alias("d"))
    return every.join(df.select("symbol", "d"), ["symbol", "d"], "left_anti")


def episodes(df: DataFrame, gap: int) -> DataFrame:
    """Runs of rows no more than `gap` days apart: number, first and last day, rows, best close, and the returns of the last and
    of the best close on the first."""
    new = F.datediff("d", F.lag("d").over(by_key())) > gap
    out = df.withColumn("episode", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(by_key().rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy("symbol", "episode").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n"), F.max("close").alias("best"), (F.max_by("close", "d") / F.min_by("close", "d") - 1).alias("total_ret"), (F.max("close") / F.min_by("close", "d") - 1).alias("best_ret"))


def trailing_z(df: DataFrame, value: Column, n: int, min_hist: int) -> DataFrame:
    """(value - mean) / population deviation of the strictly prior n rows; NULL with fewer than min_hist or without spread."""
    w = in_block().rowsBetween(-n, -1)
    sd = F.stddev_pop("_v").over(w)
    z = F.when((F.count("_v").over(w) >= min_hist) & (sd > 0), (F.col("_v") - F.avg("_v").over(w)) / sd)
    return framed(df, lambda x: x.withColumn("_v", value).withColumn("z", z).drop("_v"), before=n)


def cross_rank(df: DataFrame, value: str, *, at_least: int = 5) -> DataFrame:
    """Mid-rank share (less + half of equal) / n within a day, from at_least rows."""
    day = Window.partitionBy("d")
    less = F.rank().over(day.orderBy(value)) - 1
    equal = F.count("*").over(Window.partitionBy("d", value))
    n = F.count("*").over(day)
    return df.withColumn("cross_rank", F.when(n >= at_least, (less + 0.5 * equal) / n))


def smoothed(df: DataFrame, values: dict[str, Column], n: int, *, number: str = NUMBER, within: tuple[str, ...] = (BLOCK,)) -> DataFrame:
    """Exponential means of weight 1/n by the row number. Sums run in parts of 40 n rows with weights relative to the part's
    start, and take the part before whole; what lies further back weighs less than 1e-17. So no row needs a loop or a list."""
    q, size = 1 - 1 / n, 40 * n
    out = df.withColumn("_part", F.floor(F.col(number) / size))
    off = F.col(number) - F.col("_part") * size
    inside = Window.partitionBy("symbol", *within, "_part").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("symbol", *within).orderBy("_part").rangeBetween(-1, -1)
    out = out.withColumns({f"_t_{k}": F.coalesce(v, F.lit(0.0)) / n * F.pow(F.lit(q), -off) for k, v in values.items()})
    part = lambda k: F.sum(f"_t_{k}").over(inside) + F.pow(F.lit(q), F.lit(size)) * F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0.0))
    return out.withColumns({k: F.pow(F.lit(q), off) * part(k) for k in values}).drop("_part", *(f"_t_{k}" for k in values))


def rsi_ewm(df: DataFrame, n: int = 14) -> DataFrame:
    """From exponential means of gains and losses of the close; NULL before n rows and without losses."""
    step = F.col("close") - F.lag("close").over(in_block())
    rsi = F.when((F.col(NUMBER) >= n) & (F.col("loss") > 0), 100 - 100 / (1 + F.col("gain") / F.col("loss")))

    def make(x: DataFrame) -> DataFrame:
        x = x.withColumns({"_g": F.greatest(step, F.lit(0.0)), "_l": F.greatest(-step, F.lit(0.0)), "_s": step})
        x = smoothed(x, {"gain": F.when(F.col("_s").isNotNull(), F.col("_g")), "loss": F.when(F.col("_s").isNotNull(), F.col("_l"))}, n)
        return x.withColumn("rsi", rsi).drop("_g", "_l", "_s")

    return framed(df, make, before=80 * n + 1)


def rsi_seeded(df: DataFrame, n: int = 14) -> DataFrame:
    """From log returns: the mean of the first n, then the recursion; 100 without losses, NULL before the seed."""
    lr = F.ln(safe_ratio(F.col("close"), F.lag("close").over(by_key())))
    out = df.withColumn("_lr", lr).withColumn("_rn", F.count("_lr").over(by_key().rowsBetween(Window.unboundedPreceding, 0)))
    first = by_key().rowsBetween(-(n - 1), 0)
    part = lambda c: F.when(F.col("_rn") > n, c).when((F.col("_rn") == n) & F.col("_lr").isNotNull(), F.avg(c).over(first) * n)
    out = out.withColumns({"_g": F.greatest("_lr", F.lit(0.0)), "_l": F.greatest(-F.col("_lr"), F.lit(0.0))})
    out = out.withColumns({"_pg": part(F.col("_g")), "_pl": part(F.col("_l"))})
    out = smoothed(out, {"gain": F.col("_pg"), "loss": F.col("_pl")}, n, number="_rn", within=())
    return out.withColumn("rsi", F.when(F.col("_rn") >= n, F.when(F.col("loss") > 0, 100 - 100 / (1 + F.col("gain") / F.col("loss"))).otherwise(100.0)))


def day_place(df: DataFrame, t: str, *, n: int = 8) -> DataFrame:
    """Place within the whole day's range, and the range of the n bars before. Not causal within the day."""
    day = Window.partitionBy("symbol", F.to_date(t))
    before = in_block().rowsBetween(-n, -1)
    hi, lo = F.max("high").over(day), F.min("low").over(day)
    whole = df.withColumn("day_place", safe_ratio(F.col("close") - lo, hi - lo))
    return framed(whole, lambda x: x.withColumn("prior_range", F.max("high").over(before) - F.min("low").over(before)), t=t, before=n)


def forward_excursion(df: DataFrame, horizons: Sequence[int], unit: float) -> DataFrame:
    """Highest, lowest and last of the next h bars from the close, in units; whole windows only, rows without the shortest go."""
    cols = {}
    for h in horizons:
        w = in_block().rowsBetween(1, h)
        whole = F.count("*").over(w) == h
        cols[f"up_{h}"] = F.when(whole, (F.max("high").over(w) - F.col("close")) / unit)
        cols[f"down_{h}"] = F.when(whole, (F.col("close") - F.min("low").over(w)) / unit)
        cols[f"net_{h}"] = F.when(whole, (F.lead("close", h).over(in_block()) - F.col("close")) / unit)
    return framed(df, lambda x: x.withColumns(cols), after=max(horizons)).filter(F.col(f"up_{min(horizons)}").isNotNull())


def plausible(df: DataFrame, value: str, *, n: int = 20, ratio: float = 0.2) -> DataFrame:
    """Whether a value is below a share of the median of the n rows before (a list of n at most); NULL without n rows."""
    mid = F.array_sort("_past")
    median = (F.element_at(mid, n // 2) + F.element_at(mid, n // 2 + 1)) / 2 if n % 2 == 0 else F.element_at(mid, n // 2 + 1)

    def make(x: DataFrame) -> DataFrame:
        x = x.withColumn("_past", F.collect_list(value).over(in_block().rowsBetween(-n, -1)))
        return x.withColumn("median_before", F.when(F.size("_past") == n, median)).drop("_past")

    return framed(df, make, before=n).withColumn("low", safe_ratio(F.col(value), F.col("median_before")) < ratio)


def outcome_within(df: DataFrame, days: int, min_rows: int) -> DataFrame:
    """Best and worst close in (t, t + days] where at least min_rows bars are there, else NULL. A range frame, no join."""
    w = Window.partitionBy("symbol").orderBy(F.unix_date("d")).rangeBetween(1, days)
    whole = F.count("*").over(w) >= min_rows
    return df.withColumns({"best": F.when(whole, F.max("close").over(w) / F.col("close") - 1), "worst": F.when(whole, F.min("close").over(w) / F.col("close") - 1)})


def folds(months: DataFrame, *, burn_months: int = 6) -> DataFrame:
    """Expanding folds from one row a month (test_start, n_test): each month after the burn-in tests what all before it train."""
    before = Window.orderBy("test_start").rowsBetween(Window.unboundedPreceding, -1)
    first = F.broadcast(months.agg(F.min("test_start").alias("_first")))
    out = months.withColumn("n_train", F.coalesce(F.sum("n_test").over(before), F.lit(0))).crossJoin(first)
    return out.filter(F.col("test_start") >= F.add_months("_first", burn_months)).drop("_first")
