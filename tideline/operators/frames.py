"""Frames of bounded length without a whole key in one task: rows are numbered within their key by counts of stretches of time, dealt
to blocks of that number, and the rows that a neighbour's frames reach are copied to its block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .joins import stretch

BLOCK, NUMBER, OWN = "_block", "_number", "_own"
SIZE = 16_384


def in_block(by: str = "symbol") -> WindowSpec:
    """The window of dealt rows: a key's block in the order of the rows."""
    return Window.partitionBy(by, BLOCK).orderBy(NUMBER)


def numbered(df: DataFrame, *, by: str, t: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows with `_number`, from 1 within each key in the order of t and `then`. A task holds one stretch of a key; what came before
    is a running sum over one row a stretch. Keys and times may be null: null is a key like others, and null times come first."""
    # null parts of a struct are equal to each other, so one column serves the aggregate, the window and the join
    x = df.withColumn("_at", F.struct(F.col(by).alias("k"), stretch(df, t).alias("s")))
    before = Window.partitionBy("_at.k").orderBy("_at.s").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy("_at").agg(F.count("*").alias("_n"))
    base = base.select(F.col("_at").alias("_then"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    x = x.withColumn("_in", F.row_number().over(Window.partitionBy("_at").orderBy(t, *then)))
    met = x.join(base, F.col("_at") == F.col("_then"))
    return met.withColumn(NUMBER, F.col("_base") + F.col("_in")).drop("_at", "_then", "_in", "_base")


def deal(df: DataFrame, *, by: str = "symbol", t: str = "d", then: tuple[str, ...] = (), before: int = 0, after: int = 0, size: int = SIZE) -> DataFrame:
    """Rows dealt to blocks of `size` (or of the longest reach, if that is more), each with copies of up to `before` rows of the block ahead of it and
    `after` rows of the next. `before` and `after` add up where frames stand on columns of other frames."""
    size = max(size, before, after)
    x = numbered(df, by=by, t=t, then=then)
    own, place = F.floor((F.col(NUMBER) - 1) / size), (F.col(NUMBER) - 1) % size
    blocks = [own]
    if before:
        blocks.append(F.when(place >= size - before, own + 1))
    if after:
        blocks.append(F.when((place < after) & (own > 0), own - 1))
    x = x.withColumn(BLOCK, F.explode(F.array_compact(F.array(*blocks)))).withColumn(OWN, F.col(BLOCK) == own)
    return x.withMetadata(BLOCK, {"before": before, "after": after, "by": by, "t": t})


def gather(df: DataFrame) -> DataFrame:
    """Each row once, without the helper columns."""
    return df.filter(OWN).drop(BLOCK, NUMBER, OWN)


def framed(df: DataFrame, make: Callable[[DataFrame], DataFrame], *, by: str = "symbol", t: str = "d", before: int = 0, after: int = 0) -> DataFrame:
    """make(df), whose frames over `in_block` reach `before` rows back and `after` ahead. Rows are dealt and gathered here, unless the
    caller has dealt them already to put several operators on one deal."""
    if BLOCK not in df.columns:
        return gather(make(deal(df, by=by, t=t, before=before, after=after)))
    room = df.schema[BLOCK].metadata
    if (room["by"], room["t"]) != (by, t) or room["before"] < before or room["after"] < after:
        raise ValueError(f"dealt as {room}, but frames by {by}, {t} reach {before} rows back and {after} ahead")
    return make(df)
