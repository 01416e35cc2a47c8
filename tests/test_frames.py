"""Frames dealt by blocks against one window over the whole key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF
from tideline.operators import bars as B
from tideline.operators import frames as FR
from tideline.sources import views as V


@pytest.mark.parametrize("size", [1, 7, 64, FR.SIZE])
def test_blocks_equal_one_window(spark, size):
    rng = random.Random(size)
    keys = ["hot"] * 400 + ["thin"] * 3 + [None] * 40
    rows = [(i, rng.choice(keys), rng.choice([rng.randrange(2_000_000), 5, 70_000, None]), rng.choice([None, float(rng.randrange(50))])) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, symbol string, t long, v double").repartition(6)
    frames = {"mean": (F.avg("v"), -9, 0), "top": (F.max("v"), -4, -1), "low": (F.min("v"), 1, 6), "n": (F.count("v"), -9, 6)}
    dealt = FR.deal(df, t="t", then=("i",), before=9, after=6, size=size)
    got = FR.gather(dealt.withColumns({k: f.over(FR.in_block().rowsBetween(a, b)) for k, (f, a, b) in frames.items()}).withColumn("rn", F.col(FR.NUMBER)))
    w = Window.partitionBy("symbol").orderBy("t", "i")
    want = df.withColumns({k: f.over(w.rowsBetween(a, b)) for k, (f, a, b) in frames.items()}).withColumn("rn", F.row_number().over(w))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert got.count() == 900 and FR.gather(FR.deal(df.limit(0), t="t", before=2)).count() == 0
    widest = dealt.groupBy("symbol", FR.BLOCK).count().agg(F.max("count")).first()[0]
    assert widest <= max(size, 9) + 9 + 6


def test_a_chain_on_one_deal_equals_single_operators(spark):
    b = V.bars(spark, SF)
    chained = FR.gather(B.forward_labels(B.rsi_ewm(B.sma_distance(FR.deal(b, before=1121, after=5, size=1), 20)), [5], 0.1))
    apart = B.forward_labels(B.rsi_ewm(B.sma_distance(b, 20)), [5], 0.1)
    cols = ["symbol", "d", *(F.round(c, 7) for c in ("sma_dist_20", "rsi", "fwd_ret_5", "fwd_max_5"))]
    assert chained.select(cols).exceptAll(apart.select(cols)).count() == 0 and chained.count() == b.count()


def test_too_short_a_deal_is_an_error(spark):
    with pytest.raises(ValueError, match="reach 19 rows back"):
        B.sma_distance(FR.deal(V.bars(spark, SF), before=18), 20)
