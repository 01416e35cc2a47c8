"""Trades along their price paths: expansion by day, then the first rule that fires. Each trade is independent of others."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["symbol", "d"]


def expand(trades: DataFrame, bars: DataFrame, *, days: int, patience: int = 2) -> DataFrame:
    """trades (symbol, d, entry, ...) to a row for each day 1..days after entry. Up to `patience` missing bars in a row take the last
    close; the path ends before the next one, with `gap` set on all its rows. A trade that ends at once keeps day 0 alone."""
    t = trades.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(days)))).withColumn("day", F.date_add("d", F.col("k")))
    b = bars.select("symbol", F.col("d").alias("day"), "open", "high", "low", "close")
    w = Window.partitionBy(*KEY).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    out = t.join(b, ["symbol", "day"], "left")
    out = out.withColumn("_seen", F.last(F.when((F.col("k") == 0) | F.col("close").isNotNull(), F.col("k")), ignorenulls=True).over(w))
    own = F.when(F.col("k") == 0, F.col("entry")).otherwise(F.col("close"))
    out = out.withColumns({"_last": F.last(own, ignorenulls=True).over(w), "_end": F.min(F.when(F.col("k") - F.col("_seen") > patience, F.col("_seen"))).over(Window.partitionBy(*KEY))})
    out = out.filter(F.col("_end").isNull() | (F.col("k") <= F.col("_end")))
    fill = lambda c: F.when((F.col("k") == 0) | F.col("close").isNull(), F.col("_last")).otherwise(F.col(c)).alias(c)
    return out.select(*trades.columns, "k", "day", *(fill(c) for c in ("open", "high", "low", "close")), F.col("_end").isNotNull().alias("gap"))


def prior_peak() -> Column:
    """The highest high before this bar, the entry at least."""
    return F.greatest("entry", F.max("high").over(Window.partitionBy(*KEY).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))


def first_exit(path: DataFrame, rules: list[tuple[str, Column, Column]], *, keys: list[str] = KEY) -> DataFrame:
    """The first bar on which a rule (reason, condition, fill) fires, the earlier rule first; else the last close of the path, for
    `data_gap` or `time`. One aggregate over the path."""
    hit = F.lit(None)
    for reason, cond, fill in reversed(rules):
        hit = F.when((F.col("k") > 0) & cond, F.struct(F.lit(reason).alias("reason"), fill.alias("price"), F.col("k").alias("bar"))).otherwise(hit)
    end = F.struct(F.when(F.col("gap"), "data_gap").otherwise("time").alias("reason"), F.col("close").alias("price"), F.col("k").alias("bar"))
    out = path.withColumns({"_hit": hit, "_out": end}).groupBy(*keys).agg(F.first("entry").alias("entry"), F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("k"))).alias("h"), F.max_by("_out", "k").alias("e"))
    out = out.withColumn("x", F.coalesce("h", "e"))
    return out.select(*keys, "entry", "x.reason", "x.price", "x.bar", (F.col("x.price") / F.col("entry") - 1).alias("ret"))


def sweep(path: DataFrame, grid: Column, rules: list[tuple[str, Callable[[Column], Column], Callable[[Column], Column]]], *, carry: tuple[str, ...] = (), upto: Column | None = None) -> DataFrame:
    """first_exit for every entry of `grid`, an array of structs whose fields become columns. A trade's bars become one array (the path is by
    trade already, so nothing is shuffled) and only trades are multiplied. Rules are (reason, condition, fill) of a bar; with `upto`
    bars after that day don't count, and only trades whose path reaches it."""
    bars = F.array_sort(F.collect_list(F.struct("k", "open", "high", "low", "close")))
    x = path.groupBy(*KEY).agg(F.first("entry").alias("entry"), F.first("gap").alias("gap"), *(F.first(c).alias(c) for c in carry), bars.alias("bars"))
    x = x.withColumn("_g", F.explode(grid)).select("*", "_g.*")
    if upto is not None:
        x = x.withColumn("bars", F.filter("bars", lambda b: b.k <= upto)).filter(F.element_at("bars", -1).k == upto)
    hit = lambda b: reduce(lambda acc, rule: F.when(rule[1](b), F.struct(F.lit(rule[0]).alias("reason"), rule[2](b).alias("price"), b.k.alias("bar"))).otherwise(acc), reversed(rules), F.lit(None))
    fires = lambda b: reduce(lambda acc, rule: acc | rule[1](b), rules, F.lit(False))
    x = x.withColumns({"_first": F.get(F.filter("bars", lambda b: (b.k > 0) & F.coalesce(fires(b), F.lit(False))), F.lit(0)), "_last": F.element_at("bars", -1)})
    end = F.struct(F.when(F.col("gap"), "data_gap").otherwise("time").alias("reason"), F.col("_last.close").alias("price"), F.col("_last.k").alias("bar"))
    x = x.withColumn("_x", F.when(F.col("_first").isNotNull(), hit(F.col("_first"))).otherwise(end))
    return x.select(*[c for c in x.columns if c not in ("bars", "_g", "_first", "_last", "_x")], "_x.*", (F.col("_x.price") / F.col("entry") - 1).alias("ret"))


def target(tp: float | Column) -> tuple[str, Column, Column]:
    level = F.col("entry") * (1 + tp)
    return "tp", F.col("high") >= level, level


def stop(level: Column, name: str = "sl", *, at_open: bool = False) -> tuple[str, Column, Column]:
    """Filled at the level; with at_open at the open where the bar opens below it."""
    return name, F.col("low") <= level, F.least(level, F.col("open")) if at_open else level


def trailing(activation: float, trail: float) -> tuple[str, Column, Column]:
    """Needs a column `peak`: once the peak before this bar reached the activation, stops a share of the gain below it."""
    level = F.col("peak") - (F.col("peak") - F.col("entry")) * trail
    armed = (F.col("peak") >= F.col("entry") * (1 + activation)) & (F.col("peak") > F.col("entry"))
    return "trailing", armed & (F.col("low") <= level), level


def tiered(path: DataFrame, *, tp: float, trail: float) -> DataFrame:
    """Half leaves at the target; from the next bar on the rest trails the highest high since. Returns weighted results."""
    at = F.min(F.when((F.col("k") > 0) & (F.col("high") >= F.col("entry") * (1 + tp)), F.col("k"))).over(Window.partitionBy(*KEY))
    out = path.withColumn("tp_bar", at)
    since = F.max(F.when(F.col("k") >= F.col("tp_bar"), F.col("high"))).over(Window.partitionBy(*KEY).orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("peak", since)
    level = F.col("peak") - (F.col("peak") - F.col("entry")) * trail
    rest = first_exit(out, [("trailing", F.col("low") <= level, level)])
    half = out.groupBy(*KEY).agg(F.max("tp_bar").alias("tp_bar"))
    both = rest.join(half, KEY)
    return both.withColumn("ret", F.when(F.col("tp_bar").isNull(), F.col("ret")).otherwise(0.5 * tp + 0.5 * F.col("ret")))
