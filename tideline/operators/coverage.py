"""Days by how much of the usual rows they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
COVERED_SHARE = 0.5
PRIOR_DAYS = 30


def weekdays_after(a: Column, b: Column) -> Column:
    """Days from Monday to Friday in (a, b]: whole weeks, and the rest by the weekday that it starts on."""
    n = F.greatest(F.datediff(b, a), F.lit(0))
    rest, start = n % 7, F.weekday(a)  # Monday is 0; the rest covers the weekdays start + 1 .. start + rest
    weekend = sum(((start + 1 <= day) & (day <= start + rest)).cast("int") for day in (F.lit(5), F.lit(6), F.lit(12)))
    return F.floor(n / 7).cast("int") * 5 + rest - weekend


def covered_day(df: DataFrame, *, by: str, day: str, today: Column, most: int = 2, prior: int = PRIOR_DAYS, share: float = COVERED_SHARE) -> DataFrame:
    """Per key: the last day, its rows, its weekdays before today, the rows asked for (a share of the mean of the `prior` days before the last
    one; without any, the last day's own), and the last day within `most` weekdays that has them. States: stale, fresh, degraded (an
    earlier day is covered) and uncovered. The windows run over one row a key and day; rows without a day don't count."""
    n = df.filter(F.col(day).isNotNull()).groupBy(by, F.col(day).alias("_d")).agg(F.count("*").alias("_n"))
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.col("_d").desc()))
    n = n.withColumns({"_back": back, "latest": F.max("_d").over(Window.partitionBy(by))}).filter(F.col("_back") <= F.greatest(F.lit(prior + 1), F.lit(most * 2 + 8)))
    mean = F.avg(F.when(F.col("_back").between(2, prior + 1), F.col("_n"))).over(Window.partitionBy(by))
    own = F.max(F.when(F.col("_back") == 1, F.col("_n"))).over(Window.partitionBy(by))
    n = n.withColumns({"n": own, "expected": F.coalesce(F.bround(mean * share, 0).cast("long"), own)})
    inside = (weekdays_after(F.col("_d"), F.col("latest")) <= most - 1) & (F.datediff("latest", "_d") <= most * 2 + 7)
    out = n.groupBy(by, "latest", "n", "expected").agg(F.max(F.when(inside & (F.col("_n") >= F.col("expected")), F.col("_d"))).alias("covered"))
    gap = weekdays_after(F.col("latest"), today)
    state = F.when(gap > most, "stale").when(F.col("covered").isNull(), "uncovered").when(F.col("covered") == F.col("latest"), "fresh").otherwise("degraded")
    return out.withColumns({"gap": gap, "state": state, "covered": F.when(gap <= most, F.col("covered"))})
