"""Event-time windows over a tape of ticks. Each works on a table and, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import running_last


def trades_window(rows: DataFrame, *, cadence: str, watermark: str | None = None) -> DataFrame:
    """Per symbol and window: sides, notional, OHLC by (time, arrival), size statistics. A maker row is a taker's sale."""
    if watermark:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)  # no watermark on timestamp_ntz
    order = F.struct("ts", "event_id")
    sold = F.col("maker")
    side = lambda c, s: F.sum(F.when(s, c).otherwise(0.0))
    out = rows.groupBy("symbol", F.window("ts", cadence).alias("w")).agg(
        side(F.col("qty"), ~sold).alias("buy_volume"), side(F.col("qty"), sold).alias("sell_volume"), F.sum(F.col("price") * F.col("qty")).alias("notional"), F.count("*").alias("n"),
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.max("qty").alias("qty_max"), F.avg("qty").alias("qty_mean"),
    )
    return out.select("symbol", F.col("w.start").alias("window_start"), *[c for c in out.columns if c not in ("symbol", "w")])


def asof_window(rows: DataFrame, *, cadence: str) -> DataFrame:
    """The latest observation of each window."""
    out = rows.groupBy("symbol", F.window("ts", cadence).alias("w")).agg(F.max_by(F.struct("price", "qty", "event_id"), F.struct("ts", "event_id")).alias("v"))
    return out.select("symbol", F.col("w.start").alias("window_start"), "v.*")


def sequence_gaps(diffs: DataFrame) -> DataFrame:
    """Rows whose previous update isn't the one before them: the interval that is missing."""
    return running_last(diffs, {"expected": F.col("u")}, by="symbol", t="u", strict=True).filter(F.col("expected").isNotNull() & (F.col("pu") != F.col("expected"))).select("symbol", "u", "pu", "expected")


def sessions(rows: DataFrame, *, gap: str) -> DataFrame:
    out = rows.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))
    return out.select("symbol", F.col("w.start").alias("session_start"), "n", "qty")


def settled(windows: DataFrame, *, cadence_s: int, now: str, lag_s: int) -> DataFrame:
    """Windows that ended lag_s seconds before `now`."""
    return windows.filter(F.col("window_start") + F.make_dt_interval(secs=F.lit(cadence_s + lag_s)) <= F.lit(now).cast("timestamp"))


def upsert(target: DataFrame, updates: DataFrame, *, keys: list[str], update_cols: list[str]) -> DataFrame:
    """Rows of both by key; where both have one, only update_cols come from the update."""
    new = updates.withColumn("_new", F.lit(True))
    t, u = target.alias("t"), new.alias("u")
    on = [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys]
    pick = lambda c: F.when(F.col("u._new") & (F.lit(c in update_cols) | F.col(f"t.{keys[0]}").isNull()), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}"))
    return t.join(u, on, "full_outer").select(*(F.coalesce(f"t.{k}", f"u.{k}").alias(k) for k in keys), *(pick(c).alias(c) for c in target.columns if c not in keys))


def insert_ignore(target: DataFrame, new: DataFrame, *, keys: list[str]) -> DataFrame:
    return target.unionByName(new.dropDuplicates(keys).join(target, keys, "left_anti"))


def stalls(beats: DataFrame, before: DataFrame, expected: DataFrame, now: DataFrame, *, interval_seconds: int, factor: int = 3) -> DataFrame:
    """beats (symbol, ts, rows) as they are, before (symbol, rows) as they were at the last check, expected (symbol), now (one row): the state of every
    symbol. `missing` has no beat; `stale` has an old one; `stalled` is fresh and was there before, but has no new rows while some fresh
    one has; if none has, it is a lull of all and `fresh`."""
    x = beats.select("symbol", "ts", F.col("rows").alias("_rows")).join(expected.select("symbol").distinct(), "symbol", "full_outer")
    x = x.join(before.select("symbol", F.col("rows").alias("_then")), "symbol", "left").crossJoin(F.broadcast(now))
    old = F.unix_micros("now") - F.unix_micros("ts") > factor * interval_seconds * 1_000_000
    x = x.withColumn("_fresh", F.coalesce(~old, F.lit(False)))
    moved = F.coalesce(F.col("_fresh") & (F.col("_rows") > F.col("_then")), F.lit(False))
    any_moved = x.agg(F.coalesce(F.bool_or(moved), F.lit(False)).alias("_any"))
    state = F.when(F.col("ts").isNull(), "missing").when(~F.col("_fresh"), "stale").when(F.col("_any") & (F.col("_rows") <= F.col("_then")), "stalled").otherwise("fresh")
    return x.crossJoin(F.broadcast(any_moved)).withColumn("state", state).drop("_rows", "_then", "_fresh", "_any", "now")
