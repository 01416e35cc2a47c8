"""Running last values and as-of joins by stretches of time against one window a key."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators import joins as J


def rows(seed, n=600):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(900)), i, rng.random() if rng.random() < 0.05 else None) for i in range(n)]


@pytest.mark.parametrize(("strict", "forward"), [(False, False), (True, False), (False, True), (True, True)])
def test_running_last_equals_one_window(spark, strict, forward):
    x = spark.createDataFrame(rows(1), "k string, t date, i int, v double")
    w, near = Window.partitionBy("k").orderBy("t", "i"), int(strict)
    want = x.withColumn("m", F.first("v", ignorenulls=True).over(w.rowsBetween(near, Window.unboundedFollowing)) if forward else F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -near)))
    got = J.running_last(x, {"m": F.col("v")}, by="k", t="t", then=("i",), strict=strict, forward=forward)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 600
    assert J.running_last(x.limit(0), {"m": F.col("v")}, by="k", t="t", then=("i",)).count() == 0


@pytest.mark.parametrize(("strict", "forward"), [(False, False), (True, False), (False, True)])
def test_asof_equals_a_loop(spark, strict, forward):
    left = [(k, t, i) for k, t, i, _ in rows(2, 200) if k]
    right = sorted({(k, t): i for k, t, i, _ in rows(3, 60) if k}.items())
    got = J.asof_join(spark.createDataFrame(left, "k string, t date, i int"), spark.createDataFrame([(k, t, v) for (k, t), v in right], "k string, r date, v int"), by="k", left_t="t", right_t="r", values=["v"], strict=strict, forward=forward)
    fits = (lambda r, t: r >= t) if forward else (lambda r, t: r < t or (r == t and not strict))
    want = []
    for k, t, i in left:
        met = [(r, v) for (q, r), v in right if q == k and fits(r, t)]
        want.append((k, t, i, *((met[0] if forward else met[-1]) if met else (None, None))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
