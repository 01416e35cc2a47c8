"""Gates in batch form: which signals would have been sent, given what was sent before them. On streams see streaming/gates.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import intervals as IV
from tideline.operators import joins as J

Write = Callable[[DataFrame], DataFrame]
DAY = 86_400_000_000  # microseconds


def spaced(df: DataFrame, keys: list[str], gap_seconds: int, write: Write) -> DataFrame:
    """(keys, ts): of each key's times the first, then each that lies the gap or more after the last one chosen.

    A time that far after its predecessor is always chosen. From any time the next choice is the first one the gap or more later, found by
    a forward as-of join. Steps out of blocks of 1, 2, 4, ... gaps come from joining the steps with themselves, for entries of the blocks alone;
    then, from the longest blocks down, each choice takes its step. Rounds grow with the logarithm of the time, and no key or run is whole
    in one task. `write` stores a table and reads it back."""
    x = write(df.select(F.struct(*keys).alias("_who"), F.col("ts").cast("timestamp").alias("_when")).filter("_when is not null").distinct())
    later = F.timestamp_micros(F.unix_micros("_when") + gap_seconds * 1_000_000)
    x = J.running_last(x, {"_before": F.col("_when")}, by="_who", t="_when", strict=True)
    x = write(x.withColumn("_first", F.coalesce(F.unix_micros("_when") - F.unix_micros("_before") >= gap_seconds * 1_000_000, F.lit(True))))
    times = x.select("_who", F.col("_when").alias("_next"), "_first")
    step = J.asof_join(x.select("_who", "_when", later.alias("_to")), times, by="_who", left_t="_to", right_t="_next", values=["_first"], forward=True)
    # what is chosen anyway ends a walk
    step = write(step.filter("not _first").select("_who", "_when", F.col("match_t").alias("_next")))
    # A walk enters a block of time at a choice whose predecessor lies before the block. Blocks of twice the length have about half as many
    # entries, so that all rounds together take about twice the rows of the first
    top = x.filter("_first").select("_who", "_when")
    levels, length = [], gap_seconds * 1_000_000
    block = lambda c, n: F.floor(F.unix_micros(c) / n)
    while not step.isEmpty():
        levels.append(step)
        length *= 2
        inside = block("_when", length) == block("_next", length)
        onward = step.select("_who", F.col("_when").alias("_next"), F.col("_next").alias("_after"))
        # a step that stays in the longer block goes on with the next one, if the walk has one; then it has left the block
        far = step.join(onward, ["_who", "_next"], "left").select("_who", "_when", F.when(inside, F.col("_after")).otherwise(F.col("_next")).alias("_next"))
        entered = step.filter(~inside).select("_who", F.col("_next").alias("_when")).unionByName(top).distinct()
        step = write(far.filter("_next is not null").join(entered, ["_who", "_when"], "left_semi"))
    chosen = top
    for one in reversed(levels):
        chosen = write(chosen.unionByName(chosen.join(one, ["_who", "_when"]).select("_who", F.col("_next").alias("_when"))).distinct())
    return chosen.select("_who.*", F.col("_when").alias("ts"))


def throttled(alerts: DataFrame, heartbeat_seconds: int, write: Write) -> DataFrame:
    """alerts (symbol, ts, severity, payload; one a symbol and time): the first, each change of severity or payload, and a repeat once the
    heartbeat is due. What was sent last always has the severity and payload of the row before, so that a change is one against
    that row, and between changes the choice is that of `spaced`."""
    said = F.struct("severity", "payload")
    x = J.running_last(alerts.withColumn("_said", said), {"_last": F.col("_said")}, by="symbol", t="ts", strict=True)
    x = x.withColumn("_new", F.when(F.col("_last").isNull() | ~F.col("_last").eqNullSafe(F.col("_said")), F.col("ts")))
    x = write(J.running_last(x, {"_since": F.col("_new")}, by="symbol", t="ts").drop("_said", "_last", "_new"))
    sent = spaced(x, ["symbol", "_since"], heartbeat_seconds, write)
    return x.join(sent, ["symbol", "_since", "ts"]).drop("_since")


def cooled(signals: DataFrame, held: DataFrame, gap_seconds: int, write: Write) -> DataFrame:
    """signals (symbol, side, ts): those at least the gap after the last one sent on the symbol and side, of those that can be acted on. held
    (symbol, side, a, b in microseconds): from a up to b the side can't be, as the position is held already; such signals aren't sent and
    don't count as sent."""
    key = F.concat_ws("|", "symbol", "side")
    at = signals.select("symbol", "side", "ts").distinct().select("*", key.alias("_key"), F.unix_micros("ts").alias("a"), F.unix_micros("ts").alias("b"))
    free = IV.overlapping(at, held.select(key.alias("_key"), "a", "b"), by="_key", flag="_held", open_end=True, width=DAY).filter("not _held")
    return spaced(free, ["symbol", "side"], gap_seconds, write)
