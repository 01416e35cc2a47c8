"""Market-shaped views over the given tables, as DataFrames; the oracle has its own SQL for them (plans/oracle.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def fills(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("d"), (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("price"), F.col("l_quantity").cast("double").alias("qty"), (F.col("l_returnflag") == "R").alias("maker"), *ORDER)


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars: one shuffle, open and close by the fill's unique order key."""
    key = F.struct(*ORDER)
    return fills(spark, d).groupBy("symbol", "d").agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("trades"), F.sum(F.when(~F.col("maker"), F.col("qty")).otherwise(0.0)).alias("taker_buy"))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select("event_id", F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("symbol"), "ts", F.col("value").cast("double").alias("price"), (1 + F.col("event_id") % 5).cast("double").alias("qty"), F.col("event_type").isin("error", "signup").alias("maker"), "event_type")


def filings(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    form = F.when(F.col("o_orderpriority").startswith("1"), "8-K").when(F.col("o_orderpriority").startswith("2"), "10-Q").when(F.col("o_orderpriority").startswith("3"), "10-K").otherwise("4")
    return o.select(F.concat(F.lit("S"), (F.col("o_custkey") % 10).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("filing_date"), form.alias("form"), F.col("o_orderkey").alias("accession"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("S"), (F.col("o_custkey") % 10).cast("string")).alias("symbol"), F.col("o_orderstatus").alias("concept"), F.col("o_totalprice").cast("double").alias("value"), F.to_date("o_orderdate").alias("as_of_date"), F.col("o_orderkey").alias("fact_id"))


STATED = (
    "us-gaap/Revenues", "us-gaap/RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap/SalesRevenueNet", "ifrs-full/Revenues",
    "us-gaap/WeightedAverageNumberOfDilutedSharesOutstanding", "us-gaap/CommonStockSharesOutstanding", "us-gaap/CommonStockSharesIssued",
    "us-gaap/EarningsPerShareDiluted", "us-gaap/EarningsPerShareBasic", "ifrs-full/EarningsPerShareDiluted", "us-gaap/StockholdersEquity",
    "us-gaap/LiabilitiesAndStockholdersEquity", "us-gaap/NetInterestIncome", "us-gaap/PremiumsEarnedNet",
)


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Each order as one figure of a company: concept, value of the concept's size, unit; some values and units are missing."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    concept = F.element_at(F.array(*map(F.lit, STATED)), (k % len(STATED)).cast("int") + 1)
    price = F.col("o_totalprice").cast("double")
    o = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), concept.alias("concept"), k.alias("id"), F.to_date("o_orderdate").alias("day"), price.alias("price"), F.when(k % 9 == 0, "EUR").when(k % 7 != 0, "USD").alias("unit"))
    a_share, equity, shares = (F.col("concept").contains(x) for x in ("PerShare", "Equity", "Shares"))
    value = F.when(a_share, (F.col("price") - 100_000) / 10_000).when(equity, (F.col("price") - 80_000) * 500).when(shares, F.col("price") * 20).otherwise(F.col("price") * 1000)
    return o.select("symbol", "concept", "id", "day", F.when(F.col("id") % 13 != 0, value).alias("value"), F.when(a_share, F.concat("unit", F.lit("/shares"))).otherwise(F.col("unit")).alias("unit"))


def preds(spark: SparkSession, d: str) -> DataFrame:
    """A prediction for each bar: probability from the day and symbol numbers, horizons alternating, outcome from the bars."""
    b = bars(spark, d)
    day = F.datediff("d", F.lit("1995-01-01").cast("date"))
    num = F.substring("symbol", 2, 2).cast("int")
    w = Window.partitionBy("symbol").orderBy("d").rowsBetween(1, 5)
    return b.select("symbol", "d", "close", F.try_divide(F.max("close").over(w), F.col("close")).alias("peak"), (((day * 37 + num * 101) % 1000) / F.lit(1000.0)).alias("prob"), F.when((day + num) % 2 == 0, "5d").otherwise("10d").alias("horizon"), F.year("d").alias("model")).withColumn("hit", F.col("peak") >= 2.0).withColumn("ret", F.col("peak") - 1)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Scored symbol-days: components from the day's volume, some missing; tier, window and evidence from its trades."""
    b = bars(spark, d).withColumn("num", F.col("volume").cast("bigint"))
    part = lambda m, k: F.when(F.col("num") % m != 0, (F.col("num") * k % 101).cast("double"))
    parts = {"cheap": part(7, 3), "quality": part(5, 7), "catalyst": part(4, 11), "momentum": part(3, 13), "sentiment": part(2, 17), "risk": part(9, 19)}
    return b.withColumns(parts).select("symbol", "d", "close", "trades", "num", *parts)


def hours(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of ticks, with a bid and an ask around the last price; hours without ticks are missing."""
    key = F.struct("ts", "event_id")
    return ticks(spark, d).groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("trades"), F.sum(F.when(~F.col("maker"), F.col("qty")).otherwise(0.0)).alias("taker_buy"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    return ticks(spark, d).select("symbol", "ts", "event_id", (F.col("price") - 0.05).alias("bid"), (F.col("price") + 0.05 * (1 + F.col("event_id") % 3)).alias("ask"), F.col("qty").alias("bid_qty"), (1 + F.col("event_id") % 7).cast("double").alias("ask_qty"))


def trades(spark: SparkSession, d: str) -> DataFrame:
    """Entries at the close of days with a high probability."""
    return preds(spark, d).filter("prob >= 0.9").select("symbol", "d", F.col("close").alias("entry"), "prob", "model", "horizon")
