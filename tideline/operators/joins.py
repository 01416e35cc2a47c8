"""Joins: as-of by union and a running last value (one shuffle, no range join), bucketed ranges, offsets, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType


def stretch(df: DataFrame, t: str, width: int = 65_536) -> Column:
    """The stretch of time that a row falls in: 64 days, one day or `width` numbers, by the column's type."""
    kind = df.schema[t].dataType
    if isinstance(kind, DateType):
        return F.floor(F.unix_date(t) / 64)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.floor(F.unix_seconds(F.col(t).cast("timestamp")) / 86_400)
    return F.floor(F.col(t) / width)


def running_last(df: DataFrame, values: dict[str, Column], *, by: str, t: str, then: tuple[str, ...] = (), strict: bool = False, forward: bool = False, width: int = 65_536) -> DataFrame:
    """Columns with the last value that isn't null, up to each row (strict: before it; forward: the first from it on), in the order of t and `then`. A
    key's rows are dealt by stretches of time, so that no task holds a whole key; what a stretch starts with comes from one
    row for each earlier stretch. Rows and stretches meet on the partitioning that the window has anyway."""
    named = {f"_v_{k}": v for k, v in values.items()}
    x = df.withColumn("_at", stretch(df, t, width)).withColumns(named)
    order = F.struct(t, *then)
    end = F.min_by if forward else F.max_by
    each = x.groupBy(by, "_at").agg(*(end(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(v) for v in named))
    # a min_by or max_by over no order at all is null; so is a stretch without a value
    over = Window.partitionBy(by).orderBy(F.col("_at").desc() if forward else F.col("_at")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(by, "_at", *(F.last(v, ignorenulls=True).over(over).alias(f"_b{v}") for v in named))
    # forward the order is turned round: a frame up to the end would be gone through anew for each row
    turned = [F.col(c).desc() if forward else F.col(c) for c in (t, *then)]
    w = Window.partitionBy(by, "_at").orderBy(*turned).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    x = x.withColumns({f"_i{v}": F.last(v, ignorenulls=True).over(w) for v in named})
    # keys may be null: such rows form a key of their own, as in a window
    met = x.join(each.withColumnsRenamed({by: "_by", "_at": "_then"}), F.col(by).eqNullSafe(F.col("_by")) & F.col("_at").eqNullSafe(F.col("_then")))
    return met.select(*df.columns, *(F.coalesce(f"_i_v_{k}", f"_b_v_{k}").alias(k) for k in values))


def asof_join(left: DataFrame, right: DataFrame, *, by: str, left_t: str, right_t: str, values: list[str], strict: bool = False, forward: bool = False, width: int = 65_536) -> DataFrame:
    """Each left row with the latest right row at or before (strict: before) its time, or forward the first at or after it.
    right: one row per (by, time). Both sides are put in one order per key and stretch of time; a running last value carries the match."""
    packed = F.struct(F.col(right_t).alias("match_t"), *values)
    a = left.withColumns({"_t": F.col(left_t), "_side": F.lit(1), "_r": F.lit(None)}).select(by, "_t", "_side", F.struct(*left.columns).alias("_l"))
    a = a.withColumn("_r", F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType))
    # at equal times the right row comes first where it counts
    b = right.select(by, F.col(right_t).alias("_t"), F.lit(2 if strict or forward else 0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), packed.alias("_r"))
    both = running_last(a.unionByName(b), {"_m": F.col("_r")}, by=by, t="_t", then=("_side",), forward=forward, width=width)
    return both.filter(F.col("_l").isNotNull()).select("_l.*", "_m.match_t", *(f"_m.{v}" for v in values))


def forward_extremes(left: DataFrame, bars: DataFrame, *, days: int) -> DataFrame:
    """Highest and lowest close and number of bars within (t, t + days]. Bars are dealt to buckets of `days` days, so the
    join has equal keys and each row meets two buckets."""
    a = left.select("symbol", "d", F.explode(F.array(F.floor(F.unix_date("d") / days), F.floor(F.unix_date("d") / days) + 1)).alias("bucket"))
    b = bars.select(F.col("symbol").alias("s2"), F.col("d").alias("d2"), F.col("close").alias("c2"), F.floor(F.unix_date("d") / days).alias("bucket2"))
    on = (F.col("symbol") == F.col("s2")) & (F.col("bucket") == F.col("bucket2")) & (F.col("d2") > F.col("d")) & (F.col("d2") <= F.date_add("d", days))
    return a.join(b, on).groupBy("symbol", "d").agg(F.max("c2").alias("max_close"), F.min("c2").alias("min_close"), F.count("*").alias("n_bars"))


def row_offset_join(left: DataFrame, bars: DataFrame, *, n: int) -> DataFrame:
    """Each left row with the bar n rows after its own."""
    w = Window.partitionBy("symbol").orderBy("d")
    ahead = bars.select("symbol", "d", F.lead("d", n).over(w).alias("mature_d"), F.lead("close", n).over(w).alias("mature_close"))
    return left.join(ahead, ["symbol", "d"])


def calendar_offset_join(left: DataFrame, bars: DataFrame, *, days: int) -> DataFrame:
    ahead = bars.select("symbol", F.date_sub("d", days).alias("d"), F.col("close").alias("later_close"))
    return left.join(ahead, ["symbol", "d"], "left")


def reconcile(a: DataFrame, b: DataFrame, *, on: list[str], value: str, tol: float) -> DataFrame:
    """One full join: matched, breach (differs by more than tol), only_left or only_right, with counts."""
    x, y = a.select(*on, F.col(value).alias("x")), b.select(*on, F.col(value).alias("y"))
    kind = F.when(F.col("y").isNull(), "only_left").when(F.col("x").isNull(), "only_right").when(F.abs(F.col("x") - F.col("y")) > tol, "breach").otherwise("matched")
    return x.join(y, on, "full_outer").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def hold_sum(trades: DataFrame, rates: DataFrame, *, days: int) -> DataFrame:
    """Sum and number of rates in [entry, entry + days), by day buckets."""
    a = trades.select("symbol", "d", F.explode(F.sequence(F.col("d"), F.date_add("d", days - 1))).alias("day"))
    daily = rates.groupBy("symbol", "day").agg(F.sum("rate").alias("rate"), F.count("*").alias("n"))
    found = a.join(daily, ["symbol", "day"], "left").groupBy("symbol", "d")
    return found.agg(F.coalesce(F.sum("rate"), F.lit(0.0)).alias("funding"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rates"))


def near(left: DataFrame, right: DataFrame, *, days: int) -> DataFrame:
    """Left rows with a right row of the symbol within `days` days either way: right days are spread once, then an equi semi join."""
    spread = right.select("symbol", F.explode(F.sequence(F.date_sub("t", days), F.date_add("t", days))).alias("d")).distinct()
    return left.join(spread, ["symbol", "d"], "left_semi")


def clusters(events: DataFrame, *, days: int, others: int) -> DataFrame:
    """Events with at least `others` rows of other symbols in the same group within `days` days. Counts per (group, symbol, day) are
    spread over the days around, so the join has equal keys and no pairs of events."""
    per_day = events.groupBy("grp", "symbol", "d").agg(F.count("*").alias("n"))
    spread = per_day.select("grp", "symbol", "n", F.explode(F.sequence(F.date_sub("d", days), F.date_add("d", days))).alias("d"))
    around = spread.groupBy("grp", "d").agg(F.sum("n").alias("all_n"))
    own = spread.groupBy("grp", "symbol", "d").agg(F.sum("n").alias("own_n"))
    out = events.join(around, ["grp", "d"]).join(own, ["grp", "symbol", "d"])
    return out.withColumn("others", F.col("all_n") - F.col("own_n")).filter(F.col("others") >= others).drop("all_n", "own_n")


def attach_series(df: DataFrame, series: DataFrame, *, values: list[str]) -> DataFrame:
    """The last value at or before each day, and whether it is the day's own. One shared series: matched by distinct days."""
    days = df.select("d").distinct().withColumn("_k", F.lit(0))
    hit = asof_join(days, series.withColumn("_k", F.lit(0)), by="_k", left_t="d", right_t="t", values=values)
    return df.join(hit.drop("_k").withColumn("exact", F.col("match_t") == F.col("d")), "d", "left")


def last_seen(df: DataFrame, cols: list[str], *, by: str, t: str) -> DataFrame:
    """Each column's last value so far; rows from the one on which all have been seen."""
    out = running_last(df, {f"last_{c}": F.col(c) for c in cols}, by=by, t=t)
    return out.dropna(subset=[f"last_{c}" for c in cols])
