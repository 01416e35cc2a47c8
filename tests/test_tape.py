"""Files and streams against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import SF
from tideline.sources import tape as S
from tideline.sources import views as V
from tideline.streaming import gates as G


def run_stream(df, name, folder):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", folder).start().awaitTermination()
    return df.sparkSession.table(name).collect()


def signals(spark, path, n=200):
    pick, start = random.Random(5), datetime(2024, 1, 1)
    rows = [(pick.choice("ab"), pick.choice(["buy", "sell"]), start + timedelta(minutes=17 * i), pick.choice(["low", "high"])) for i in range(n)]
    for i in range(4):  # one file a batch, in order of time
        spark.createDataFrame(rows[i * n // 4 : (i + 1) * n // 4], "symbol string, side string, ts timestamp, severity string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("symbol string, side string, ts timestamp, severity string").option("maxFilesPerTrigger", 1).parquet(path)
    return rows, stream


def test_cooldown(spark, tmp_path):
    rows, stream = signals(spark, str(tmp_path / "in"))
    got = {(x.symbol, x.side, x.ts) for x in run_stream(G.cooldown(stream, hours=4), "cool", str(tmp_path / "cp"))}
    last, want = {}, set()
    for symbol, side, ts, _ in rows:
        if (symbol, side) not in last or ts - last[symbol, side] >= timedelta(hours=4):
            last[symbol, side] = ts
            want.add((symbol, side, ts))
    assert got == want


def test_throttle(spark, tmp_path):
    rows, stream = signals(spark, str(tmp_path / "in"))
    alerts = stream.select("symbol", "ts", "severity", F.lit("p").alias("payload"))
    got = {(x.symbol, x.ts) for x in run_stream(G.throttle(alerts, heartbeat_hours=1), "thr", str(tmp_path / "cp"))}
    last, want = {}, set()
    for symbol, _, ts, severity in rows:
        if symbol not in last or last[symbol][1] != severity or ts - last[symbol][0] >= timedelta(hours=1):
            last[symbol] = (ts, severity)
            want.add((symbol, ts))
    assert got == want


def test_tape_is_written_pruned_and_compacted(spark, tmp_path):
    path = str(tmp_path / "tape")
    ticks = V.ticks(spark, SF).select("symbol", F.to_date("ts").alias("date"), "ts", "event_id", "price")
    S.write_partitioned(ticks, path, ["symbol", "date"])
    back = S.tape_scan(spark, path, ticks.schema, symbols=["U1", "U2"], after="2024-01-05 12:00:00", before="2024-01-09 00:00:00")
    want = ticks.filter("symbol in ('U1', 'U2') and ts > '2024-01-05 12:00:00' and ts <= '2024-01-09 00:00:00'")
    assert back.select(*ticks.columns).exceptAll(want).count() == 0 and back.count() == want.count() > 0
    assert "PartitionFilters: [" in back._jdf.queryExecution().toString()
    report = S.compact(spark, path, str(tmp_path / "out"), by=["symbol", "date"], sort_by=["ts", "event_id"], files=2)
    assert report.filter("not same").count() == 0 and report.count() > 0


def test_tape_stream_reads_what_the_tape_has(spark, tmp_path):
    ticks = V.ticks(spark, SF).select("symbol", "ts", "event_id", "price")
    ticks.repartition(5).write.parquet(str(tmp_path / "tape"))
    got = run_stream(S.tape_stream(spark, str(tmp_path / "tape"), ticks.schema, files=2), "tape_back", str(tmp_path / "cp"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, ticks.collect()))


def test_export_and_csv(spark, tmp_path):
    bars = V.bars(spark, SF).limit(50)
    S.export(bars, str(tmp_path / "csv"), "csv", ["symbol", "d", "open", "high", "low", "close", "volume", "none"])
    lines = spark.read.text(str(tmp_path / "csv")).unionByName(spark.createDataFrame([("S1,N/D,1,2,3,4,5",), ("S1,2020-01-01",), ("S1,2020-01-01,x,2,3,4,5",)], "value string"))
    assert S.csv_bars(lines).count() == bars.count()
    S.export(bars, str(tmp_path / "json"), "json", ["symbol", "d"])
    assert spark.read.json(str(tmp_path / "json")).columns == ["d", "symbol"]
