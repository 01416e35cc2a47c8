"""Files: partitioned tapes, snapshots, CSV and JSON rows, exports, compaction."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


_own_dir: list[tempfile.TemporaryDirectory] = []


def work_path(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all machines share; where that is unset and the master is local, in one temporary
    folder, which goes when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder which all machines share")
        if not _own_dir:
            _own_dir.append(tempfile.TemporaryDirectory(prefix="tideline-", ignore_cleanup_errors=True))
        base = _own_dir[0].name
    return f"{base}/tape-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, path: str, by: list[str], *, sort_by: list[str] | None = None, files: int | None = None) -> None:
    """Parquet under by=value folders. Rows are dealt by the partition columns and, with `files`, by a salt of that many parts, so that
    a hot partition is written by several tasks. Only the partitions that df holds are replaced."""
    keys = [F.col(c) for c in by] + ([F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(files))] if files else [])
    out = df.repartition(*keys)
    if sort_by:
        out = out.sortWithinPartitions(*by, *sort_by)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def tape_scan(spark: SparkSession, path: str, schema: StructType, *, symbols: list[str] | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """Rows with after < ts <= before. Symbols and days (one earlier than `after`) prune folders, ts is pushed to the scan."""
    out = spark.read.schema(schema).parquet(path)
    if symbols:
        out = out.filter(F.col("symbol").isin(*symbols))
    if after:
        at = F.lit(after).cast("timestamp")
        out = out.filter((F.col("date") >= F.date_sub(F.to_date(at), 1)) & (F.col("ts") > at))
    if before:
        at = F.lit(before).cast("timestamp")
        out = out.filter((F.col("date") <= F.to_date(at)) & (F.col("ts") <= at))
    return out


def read_snapshots(spark: SparkSession, path: str, *, time: str, floor: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """The columns of the snapshots at or after `floor` that meet `where`; all three reach the scan."""
    out = spark.read.parquet(path)
    out = out.filter(F.col(time) >= F.lit(floor).cast(out.schema[time].dataType))
    return (out if where is None else out.filter(where)).select(*columns)


def tape_stream(spark: SparkSession, path: str, schema: StructType, *, files: int = 64) -> DataFrame:
    """The same tape as an unbounded source: at most `files` new files a batch, progress kept by the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def store_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over what the source holds now. Each batch goes to a folder of its number, which is replaced whole: a batch that is run
    again after a failure, as its end wasn't recorded in the checkpoint, leaves what it left before."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all batches stored so far."""
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def compact(spark: SparkSession, source: str, target: str, *, by: list[str], sort_by: list[str], files: int = 1) -> DataFrame:
    """Rewrites a tape in `files` sorted files a partition, and returns rows in and out per partition from what was written."""
    before = spark.read.parquet(source)
    write_partitioned(before, target, by, sort_by=sort_by, files=files if files > 1 else None)
    n = before.groupBy(*by).agg(F.count("*").alias("rows_in"))
    m = spark.read.schema(before.schema).parquet(target).groupBy(*by).agg(F.count("*").alias("rows_out"))
    out = n.join(m, by, "full_outer")
    return out.withColumn("same", F.coalesce(F.col("rows_in") == F.col("rows_out"), F.lit(False)))


def export(df: DataFrame, path: str, fmt: str, cols: list[str]) -> None:
    """CSV with a header, or JSON lines, of a fixed list of columns; others are left out, absent ones are NULL."""
    out = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols))
    w = out.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)


def csv_bars(lines: DataFrame) -> DataFrame:
    """Lines `symbol,date,open,high,low,close,volume` to bars. The header, short lines, `N/D` dates and numbers that don't parse go;
    adjusted_close is the close."""
    p = lines.select(F.split("value", ",").alias("p"))
    at = lambda i, t: F.element_at("p", i).try_cast(t)
    out = p.filter(F.size("p") >= 7).select(F.element_at("p", 1).alias("symbol"), at(2, "date").alias("d"), *(at(i, "double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 3)))
    return out.dropna().withColumn("adjusted_close", F.col("close"))


def json_klines(rows: DataFrame, closed_before: Column) -> DataFrame:
    """A column `payload` with arrays of [open time, open, high, low, close, volume, close time] to bars; open ones go."""
    x = rows.select(F.explode(F.from_json("payload", "array<array<string>>")).alias("a"), *[c for c in rows.columns if c != "payload"])
    at = lambda i, t: F.get("a", F.lit(i)).try_cast(t)
    out = x.select(*[c for c in rows.columns if c != "payload"], at(0, "bigint").alias("open_ms"), *(at(i, "double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)), at(6, "bigint").alias("close_ms"))
    return out.dropna().filter(F.col("close_ms") <= closed_before)


def typed_rows(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Venue strings to types; empty or unreadable ones are NULL."""
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")).try_cast(t) for c, t in types.items()})


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
