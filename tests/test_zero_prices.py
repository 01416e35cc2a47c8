"""Ticks at a price of 0, which the small given tables lack and the larger ones have: ratios by 0 are those of floating point, as in SQL."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.oracle_check import TABLES, compare, connect
from tideline.functions import columns as C
from tideline.plans import catalog


@pytest.fixture(scope="module")
def free_ticks(spark, tmp_path_factory):
    """The given tables, with every seventh tick at 0."""
    d = tmp_path_factory.mktemp("zero")
    for t in TABLES:
        if t != "events":
            (d / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.withColumn("value", F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value"))).write.parquet(str(d / "events.parquet"))
    return str(d)


def check(spark, d, name):
    got = catalog.queries()[name](spark, d)
    assert got.count() > 0 and compare(got, connect(d).execute(catalog.oracle_sql()[name])) == ""
    return got


def test_f10_a_middle_of_zero(spark, free_ticks):
    got = check(spark, free_ticks, "f10_book_imbalance")
    assert got.filter("spread_bps = double('inf')").count() > 10


def test_float_ratio_and_round(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0), (float("nan"), 0.0)]
    got = [r.x for r in spark.createDataFrame(rows, "a double, b double").select(C.float_ratio(F.col("a"), F.col("b")).alias("x")).collect()]
    assert str(got) == "[inf, -inf, nan, None, None, 1.5, nan]"
    rows = [(199.14 / 38.4 - 1,), (1.0000025,), (-2.5e-6,), (float("inf"),), (float("nan"),), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "a double").select(C.float_round(F.col("a"), 6).alias("x")).collect()]
    assert str(got) == "[4.185937, 1.000002, -3e-06, inf, nan, None]"


def test_f1_a_close_of_zero(spark, free_ticks):
    got = check(spark, free_ticks, "f1_roc")
    assert got.filter("roc_3 = double('inf')").count() > 3 and got.filter("isnan(accel_3)").count() > 3


def test_i11_a_close_of_zero(spark, free_ticks):
    got = check(spark, free_ticks, "i11_path_labels")
    assert got.filter("mfe = double('inf')").count() > 10 and got.filter("isnan(mae)").count() > 10


def test_f11_a_close_of_zero(spark, free_ticks):
    got = check(spark, free_ticks, "f11_cross_section")
    assert got.filter("vs_median = double('inf')").count() > 3


def test_j13_a_close_of_zero(spark, free_ticks):
    check(spark, free_ticks, "j13_coin_vol")
