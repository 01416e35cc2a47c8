"""Runs compared along their parameters, and accounts by day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins as J


def sensitivity(runs: DataFrame, axes: list[str], by: str, metrics: list[str]) -> DataFrame:
    """The best run by `by` (ties by the axes) varied along one axis at a time: a row for each axis and each of its values, with the metrics of the run
    that has that value and the best one's others. Values without such a run have null metrics. `runs` has one row a setting; the best
    run and the values of the axes are aggregates, and neither sees more than one row a setting."""
    axis = lambda names: F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value"), *names(a)) for a in axes))).alias("x")
    order = F.struct(F.col(by).isNull(), -F.col(by), *axes)
    best = F.broadcast(runs.agg(F.min_by(F.struct(*(F.col(a).alias(f"_{a}") for a in axes)), order).alias("b")).select("b.*"))
    values = runs.select(axis(lambda a: [])).select("x.*").distinct()
    near = runs.crossJoin(best)
    same = {a: F.col(a).eqNullSafe(F.col(f"_{a}")) for a in axes}
    others = lambda a: reduce(lambda x, y: x & y, (same[o] for o in axes if o != a), F.lit(True))
    near = near.select(axis(lambda a: [others(a).alias("near"), same[a].alias("base")]), *metrics).filter("x.near").select("x.axis", "x.value", "x.base", *metrics)
    near = near.withColumnsRenamed({"axis": "_axis", "value": "_value"})
    met = values.join(near, (F.col("axis") == F.col("_axis")) & F.col("value").eqNullSafe(F.col("_value")), "left")
    return met.select("axis", "value", F.coalesce("base", F.lit(False)).alias("base"), *metrics)


def open_value(positions: DataFrame, marks: DataFrame, days: DataFrame, today: Column) -> DataFrame:
    """Per day of `days` (d): gain of the positions open at its end, at the last mark (symbol, d, price) at or before it. positions (symbol, entry_day,
    exit_day or null, entry, qty) become changes of quantity and cost, summed by symbol; each symbol has a dense calendar from its
    first entry to today, which meets sums and marks as of the day. Symbols without a mark yet add nothing."""
    change = lambda day, sign: positions.filter(F.col(day).isNotNull()).select("symbol", F.col(day).alias("t"), (sign * F.col("qty")).alias("q"), (sign * F.col("qty") * F.col("entry")).alias("c"))
    steps = change("entry_day", 1).unionByName(change("exit_day", -1)).groupBy("symbol", "t").agg(F.sum("q").alias("q"), F.sum("c").alias("c"))
    w = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # one row a symbol and day of change
    held = steps.select("symbol", "t", F.sum("q").over(w).alias("qty"), F.sum("c").over(w).alias("cost"))
    dense = positions.groupBy("symbol").agg(F.min("entry_day").alias("a")).filter(F.col("a") <= today)
    dense = dense.select("symbol", F.explode(F.sequence("a", today)).alias("d")).join(days.select("d").distinct(), "d", "left_semi")
    x = J.asof_join(dense, held, by="symbol", left_t="d", right_t="t", values=["qty", "cost"]).drop("match_t")
    x = J.asof_join(x, marks.select("symbol", F.col("d").alias("t"), "price"), by="symbol", left_t="d", right_t="t", values=["price"])
    return x.groupBy("d").agg(F.coalesce(F.sum(F.col("qty") * F.col("price") - F.col("cost")), F.lit(0.0)).alias("unrealized"))


def daily_balance(daily: DataFrame, positions: DataFrame, marks: DataFrame, *, since: Column, today: Column) -> DataFrame:
    """daily (d, equity) from `since` on, one row a reconciled day, and a preliminary row of today if it is missing: equity of the last day plus what is
    realised today (null without a day before). Per row what positions entered since then realised on the day and would gain
    open, the change of equity against the row before, and the running realised sum. Gaps between days stay gaps."""
    own = positions.filter(F.col("entry_day") >= since)
    known = daily.filter((F.col("d") >= since) & F.col("d").isNotNull()).select("d", "equity", F.lit(False).alias("preliminary"))
    missing = known.agg(F.max_by("equity", "d").alias("equity"), F.coalesce(F.max((F.col("d") == today).cast("int")), F.lit(0)).alias("seen"))
    extra = missing.filter((F.col("seen") == 0) & (today >= since)).select(today.alias("d"), "equity", F.lit(True).alias("preliminary"))
    rows = known.unionByName(extra)
    realized = own.filter("exit_day is not null").groupBy(F.col("exit_day").alias("d")).agg(F.sum("realized").alias("realized"))
    x = rows.join(realized, "d", "left").join(open_value(own, marks, rows, today), "d", "left").fillna(0.0, ["realized", "unrealized"])
    x = x.withColumn("equity", F.when(F.col("preliminary"), F.col("equity") + F.col("realized")).otherwise(F.col("equity")))
    w = Window.orderBy("d")  # one row a day
    return x.withColumns({"delta": F.col("equity") - F.lag("equity").over(w), "cumulative": F.sum("realized").over(w.rowsBetween(Window.unboundedPreceding, 0))})
