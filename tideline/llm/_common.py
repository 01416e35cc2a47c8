"""What the operators of this subpackage share: cutting lineage, folds, bounded samples, hashed byte n-grams, own column names."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share. Where that is unset, a temporary one if there is but this
    machine (a local master, as in tests); on a cluster it is an error, as no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder which all machines share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tideline-"))
    return _own_dir[0]


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the workers (once a session), so that they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tideline_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tideline-")) / "tideline_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(path))
    context._tideline_shipped = True


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs no more than rereading them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/tideline-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables which nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            if found := self.paths.pop(id(table), None):
                path = jvm.org.apache.hadoop.fs.Path(found[1])
                path.getFileSystem(conf).delete(path, True)

    def drop_others(self, *tables: DataFrame) -> None:
        """Deletes all tables of this scratch but these."""
        self.drop(*(t for t, _ in list(self.paths.values()) if not any(t is kept for kept in tables)))


def held_out(doc_id: Column) -> Column:
    """Rows with crc32 of the id's decimal text leaving 1 modulo 3 are never learned from; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unit(*cols: Column) -> Column:
    """A uniform double in (0, 1) that depends on the columns only."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it (Spark takes no account of case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def row_hash(df: DataFrame, seed: int, *names: str) -> Column:
    """A hash of the columns named (default: all). A hash skips nulls, so which ones are null is hashed, too; maps count as JSON."""
    cols = [(F.to_json(c) if _has_map(df.schema[n].dataType) else c) for n in names or df.columns for c in [F.col(f"`{n}`")]]
    return F.xxhash64(F.lit(seed), *(x for c in cols for x in (c.isNull(), c)))


MOST_ROWS, MOST_BYTES, LONGEST = 200_000, 1 << 25, 1 << 21


def sampled(df: DataFrame, classes: str, per_class: int, by: list[str], seed: int = 17, *, weight: str | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """Rows of each value of `classes`, per_class at most, chosen by a hash of the columns `by`; smaller classes come whole. First
    a share of each class passes by its hash, then the smallest hashes stay, of which each task keeps per_class at most.
    The counts by class are gathered to the driver, so `classes` must have few values (labels, languages); if many, each
    gets less, so that there are never more than `most_rows` in all. `weight` names a column to add: for how many rows
    of its class a row stands, so that weighted shares are the true ones."""
    counts = {r[0]: r[1] for r in df.groupBy(classes).count().collect()}
    per_class = max(1, min(per_class, most_rows // max(1, len(counts))))
    share, expected = F.lit(1.0), F.lit(1.0)
    for value, n in counts.items():
        if n > per_class:
            share = F.when(F.col(classes) == F.lit(value), F.lit(1.2 * per_class / n)).otherwise(share)
        expected = F.when(F.col(classes) == F.lit(value), F.lit(n / min(n, per_class))).otherwise(expected)
    draw, place = unused(df, "draw", "place")
    got = df.withColumn(draw, unit(*(c for b in by for c in (F.col(b).isNull(), F.col(b))), F.lit(seed))).filter(F.col(draw) < share)
    got = got.withColumn(place, F.row_number().over(Window.partitionBy(classes).orderBy(draw))).filter(F.col(place) <= per_class).drop(draw, place)
    return got if weight is None else got.withColumn(weight, expected)


def bounded(texts: DataFrame, classes: str, text: str, rows: int, *, most_bytes: int = MOST_BYTES, longest: int = LONGEST, seed: int = 19) -> DataFrame:
    """What of a sample of texts may come to the driver: of each class `rows` rows and `most_bytes` bytes at most, in order of a
    hash of the text, none of them longer than `longest` bytes. Each task keeps `rows` rows of a class at most."""
    draw, place, size = unused(texts, "draw", "place", "size")
    w = Window.partitionBy(classes).orderBy(draw)
    got = texts.withColumns({draw: unit(F.col(text), F.lit(seed)), size: F.octet_length(text)}).filter(F.col(size) <= longest)
    got = got.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= rows)
    return got.withColumn(size, F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col(size) <= most_bytes).drop(draw, place, size)


SIEVE_BITS = 1 << 23


def sieve(rows: DataFrame, ids: DataFrame, id_col: str = "id", *, inside: bool = True) -> DataFrame:
    """The rows whose id may be among the ids: all that are, and few others, so that a join that follows shuffles little;
    or (inside=False) the rest, which are certainly not. The sieve is a bitmap of SIEVE_BITS bits by a hash of the id, 1 MB
    whatever the number of ids, and is broadcast; with very many ids it lets more through, and the join decides."""
    spot, bucket, bits = unused(rows, "sieve_at", "sieve_bucket", "sieve_map")
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    at = ids.select(hashed("id").alias(spot))
    maps = at.groupBy(F.bitmap_bucket_number(spot).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias(bits))
    found = rows.withColumn(spot, hashed(id_col)).join(F.broadcast(maps), F.bitmap_bucket_number(spot) == F.col(bucket), "inner" if inside else "left")
    byte = f"cast(conv(hex(substring({bits}, cast(bitmap_bit_position({spot}) div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.coalesce(F.expr(f"getbit({byte}, cast(bitmap_bit_position({spot}) % 8 as int)) = 1"), F.lit(False))
    return found.filter(hit if inside else ~hit).drop(spot, bucket, bits)


_MULTIPLIERS = {2: 2654435761, 3: 2246822519, 4: 3266489917}
PAD = b"\0\0\0"


def ngram_buckets(data: bytes, bits: int) -> np.ndarray:
    """Bucket numbers of all 2-, 3- and 4-grams of the bytes (the last ones padded with zeros)."""
    if not data:
        return np.empty(0, np.int64)
    raw = np.frombuffer(data + PAD, np.uint8).astype(np.uint32)
    n = len(data)
    two = raw[:n] | (raw[1 : n + 1] << np.uint32(8))
    three = two | (raw[2 : n + 2] << np.uint32(16))
    four = three | (raw[3 : n + 3] << np.uint32(24))
    shift = np.uint32(32 - bits)
    return np.concatenate([(v * np.uint32(_MULTIPLIERS[k])) >> shift for k, v in ((2, two), (3, three), (4, four))]).astype(np.int64)


PIECE = 1 << 20


def ngram_counts(data: bytes, bits: int) -> np.ndarray:
    """How often each bucket occurs; a long text is counted piece by piece, so memory stays bounded. A piece takes
    with it the three bytes that follow, and only n-grams that begin in it count: the result is that of one go."""
    out = np.zeros(1 << bits, np.float64)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        found = ngram_buckets(data[at : at + PIECE + 3], bits).reshape(3, -1)[:, : len(piece)]
        out += np.bincount(found.ravel(), minlength=1 << bits)
    return out
