"""Exact quantiles of columns of any length: the bracket that holds a rank is narrowed by mergeable sketches, until few enough rows
are left to be counted by value. No task sees more than a bracket's distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS, ACCURACY, ENOUGH, FEW_GROUPS = 256, 10_000, 1_000_000, 10_000


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], *, by: Sequence[str] = (), enough: int = ENOUGH) -> DataFrame:
    """(by, p, q): of each group the quantiles of the values that aren't null, interpolated between the two ranks around p * (n - 1); groups
    without values give no rows. `by` is for few groups with many rows each.

    A sketch with CELLS cells (its ranks are off by 1 / ACCURACY of the rows at most, far less than a cell) says between which values a
    rank lies, with a cell and two rows to spare on both sides. Rows below are counted, rows inside are sketched again while a bracket has
    more than `enough` rows: each pass leaves about a hundredth, so that 10**11 rows take three. The rest is counted by
    value, and running counts over a bracket's values give the ranks."""
    x = df.filter(F.col(value).isNotNull()).select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), F.col(value).cast("double").alias("_v"))
    keys = [f"_g{i}" for i in range(len(by))]
    sketch = [F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", [i / CELLS for i in range(CELLS + 1)], ACCURACY).alias("_e")]
    n = x.groupBy(*keys).agg(*sketch).filter("_n > 0")
    at = n.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in probs)))).withColumn("_pos", F.col("p") * (F.col("_n") - 1))
    at = at.withColumns({"_lo": F.floor("_pos"), "_hi": F.ceil("_pos"), "_below": F.lit(0).cast("long")})
    # only a group of many rows is narrowed; the others are counted by value as they are
    cell = lambda rank: F.floor((rank - F.col("_below")) / F.greatest("_n", F.lit(1)) * CELLS).cast("int")
    edge = lambda i, out: F.when((F.col("_n") <= enough) | (i < 0) | (i > CELLS), F.col(out)).otherwise(F.get("_e", i))
    narrowed = lambda t: t.select(*keys, "p", "_pos", "_lo", "_hi", "_n", edge(cell(F.col("_lo") - 2) - 1, "_min").alias("_a"), edge(cell(F.col("_hi") + 2) + 2, "_max").alias("_b"))
    brackets = _kept(narrowed(at))
    most = brackets.agg(F.max("_n")).first()[0]
    last = None
    while most is not None and most > enough and most != last:
        met = _met(x, brackets, keys)
        inside = F.col("_v").between(F.col("_a"), F.col("_b"))
        own = F.when(inside, F.col("_v"))
        again = met.groupBy(*keys, "p", "_pos", "_lo", "_hi").agg(
            F.count_if(F.col("_v") < F.col("_a")).alias("_below"),
            F.count(own).alias("_n"),
            F.min(own).alias("_min"),
            F.max(own).alias("_max"),
            F.percentile_approx(own, [i / CELLS for i in range(CELLS + 1)], ACCURACY).alias("_e"),
        )
        # values that are all alike can't be told apart any further, and need not be
        brackets = _kept(narrowed(again))
        last, most = most, brackets.agg(F.max(F.when(F.col("_a") < F.col("_b"), F.col("_n")))).first()[0]
    spot = F.when(F.col("_v") >= F.col("_a"), F.col("_v"))
    counts = _met(x, brackets, keys).filter(F.col("_v") <= F.col("_b")).groupBy(*keys, "p", "_pos", "_lo", "_hi", spot.alias("_s")).agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*keys, "p").orderBy(F.col("_s").asc_nulls_first())
    ranked = counts.withColumn("_upto", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    value_at = lambda r: F.min(F.when(F.col("_upto") > F.col(r), F.col("_s")))
    out = ranked.groupBy(*keys, "p", "_pos", "_lo").agg(value_at("_lo").alias("_x"), value_at("_hi").alias("_y"))
    share = F.col("_pos") - F.col("_lo")
    q = F.when(share == 0, F.col("_x")).otherwise(F.col("_x") * (1 - share) + F.col("_y") * share)
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "p", q.alias("q"))


def _kept(brackets: DataFrame) -> DataFrame:
    """The brackets, computed once: one row a group and quantile."""
    rows = brackets.collect() if brackets.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else None
    return brackets if rows is None else brackets.sparkSession.createDataFrame(rows, brackets.schema)


def _met(x: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the brackets of its group."""
    few = brackets.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    small = F.broadcast(brackets) if few else brackets
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"x.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = x.alias("x").join(small.alias("b"), on) if keys else x.alias("x").crossJoin(F.broadcast(brackets).alias("b"))
    return joined.select(*(F.col(f"x.{k}").alias(k) for k in keys), "_v", *(F.col(f"b.{c}") for c in ("p", "_pos", "_lo", "_hi", "_a", "_b")))
