"""Registered queries against their own SQL in DuckDB, on the smallest tables, and invariants."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.oracle_check import compare, connect
from tideline.operators import bars as B
from tideline.operators import tape as T
from tideline.plans import catalog
from tideline.sources import views as V

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(catalog.queries()[name](spark, SF), con.execute(SQL[name])) == ""


def test_features_do_not_look_ahead(spark):
    b = V.bars(spark, SF)
    cut = b.filter("d < date '1998-01-01'")
    full = B.sma_distance(B.lag_returns(b, [5]), 20).filter("d < date '1998-01-01'").select("symbol", "d", F.round("ret_5", 9), F.round("sma_dist_20", 9))
    part = B.sma_distance(B.lag_returns(cut, [5]), 20).select("symbol", "d", F.round("ret_5", 9), F.round("sma_dist_20", 9))
    assert full.exceptAll(part).count() == 0


def test_insert_ignore_twice_is_once(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "k int, v string")
    once = T.insert_ignore(a, b, keys=["k"])
    assert sorted(map(tuple, T.insert_ignore(once, b, keys=["k"]).collect())) == [(1, "x"), (2, "y"), (3, "w")]


def test_stream_equals_batch(spark, tmp_path):
    ticks = V.ticks(spark, SF)
    ticks.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = T.trades_window(stream, cadence="1 hour", watermark="40 days").writeStream.format("memory").queryName("tw").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    batch = T.trades_window(ticks, cadence="1 hour")
    assert spark.table("tw").drop("notional", "qty_mean").exceptAll(batch.drop("notional", "qty_mean")).count() == 0
    assert spark.table("tw").count() == batch.count()
