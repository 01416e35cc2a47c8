"""Queries over whole tables: results that grow with them."""

from tests.conftest import SF
from tests.oracle_check import TABLES, compare, connect
from tideline.operators import decisions as D
from tideline.plans import catalog


def test_b15_takes_suppliers_of_all_keys(spark, tmp_path):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    (tmp_path / "supplier.parquet").unlink()
    spark.range(100).selectExpr("id as s_suppkey", "concat('Supplier#', id) as s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    whole = catalog.oracle_sql()["b15_industry_flags"]
    got = catalog.queries()["b15_industry_flags"](spark, str(tmp_path))
    assert got.count() == 100 and compare(got, connect(str(tmp_path)).execute(whole)) == ""


def test_adjustment_folds_case(spark):
    rows = [("High", "Bullish"), ("high", "bullish"), ("", ""), (None, None), ("medium", "neutral")]
    df = spark.createDataFrame(rows, "materiality string, sentiment string").selectExpr("*", "'guidance' as kind", "'valid' as status", "true as quote_ok", "0.8D as confidence", "cast(null as double) as spread", "0 as days_since", "cast(null as double) as risk")
    got = [x.adjustment for x in D.scaled_adjustment(df).collect()]
    assert got[0] == got[1] > 0 and got[2] == got[3] == got[4]


def test_i5_aggregates_levels_by_hash(spark):
    got = catalog.queries()["i5_depth_window"](spark, SF)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert compare(got, connect(SF).execute(catalog.oracle_sql()["i5_depth_window"])) == ""
