"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws an exponential key -ln(u) / quality from a digest of its id and text, so that ordering a source by key is
a sample without replacement weighted by quality. Sizes are prefix-summed in that order. A source whose target is more than its
size first gives complete epochs of all its documents, then the prefix that fits into what is left of the target, and one
document more to close the gap.

A source may hold any share of the rows: its order is cut into ranges of the key's logarithm (no range holds more than about
0.4% of a source, or `RANGE_ROWS` rows of a large one), sums by range are prefix-summed, and only rows of one range are sorted
together. Rows of one id have keys of their own unless their texts are equal, too.

Defined results: null is a source of its own, after all others; texts that are null or blank have size 0 and take 0; texts of any
length are counted whole; rows with equal ids and texts have equal keys and are ordered by size and text; a document may be taken
beyond its source's target only to close a gap; extra columns don't matter, whatever their names; an empty table gives no rows and a
table without words takes nothing. Nothing depends on the number or order of partitions, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, row_hash, unused

WORD = r"[^\x20\x09-\x0D]+"
RANGES_PER_OCTAVE, RANGE_ROWS = 64, 1_000_000
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null has none. Runs of other characters become one letter, and
    white space goes."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[^x]+", "")), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A quality weight from 0.1 to 1 that falls with the share of signs that prose seldom has."""
    signs = F.length(text) - F.length(F.translate(text, "!#$%&*|<>{}[]=_~^@\\/", ""))
    return F.lit(1.0) - 0.9 * F.least(F.lit(1.0), F.coalesce(F.try_divide(signs * 4, F.length(text)), F.lit(0.0)))


def draw(*cols: Column, seed: int = 11) -> Column:
    """A uniform double in (0, 1) from the columns' text: the first 52 bits of an MD5 digest, which SQL engines share."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[float], *, budget: float | None = None, max_epochs: float = 3.0) -> DataFrame:
    """From (source, source_size): source_rank, weight and target. The weights repeat along the sources by code point, null last.
    The budget (default: all sizes) is shared by weight; a target stops at max_epochs times the size and the excess is
    shared again by weight until none is above. That has a closed form: in order of cap by weight, sources stop
    as long as their cap is below their share of what the earlier ones leave. One row a source: small."""
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(kinds, (F.col("source_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(max_epochs))
    every, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double") if budget is None else F.lit(float(budget))
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("share", share).withColumn("stops", F.col("cap") < F.col("share") * F.col("weight"))
    level = F.max(F.when(~F.col("stops"), F.col("share"))).over(every)
    return ranked.withColumn("level", level).select("source", "source_size", "source_rank", "weight", F.when(F.col("stops") | F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float], *, doc_id: str = "doc_id", source: str = "source", size: Column, quality: Column, tie: Column, keep: Sequence[str] = (), budget: float | None = None, max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), epochs (how often the mix takes the row) and taken
    (size * epochs) for every row, and the columns of `keep`. tie: a digest of the text."""
    scratch = Scratch(docs.sparkSession)
    key = -F.log(draw(F.col(doc_id), tie, seed=seed)) / F.greatest(quality, F.lit(1e-6))
    sized = scratch.cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("key"), tie.alias("tie"), *keep))
    goals = scratch.cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget=budget, max_epochs=max_epochs))
    few = goals.count() <= BROADCAST_SOURCES  # beyond that, a shuffled join which Spark splits where it is skewed
    rows = sized.withColumnRenamed("source", "s").join(F.broadcast(goals) if few else goals, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    per_octave = max(RANGES_PER_OCTAVE, -(-sized.count() // (4 * RANGE_ROWS)))
    rows = rows.withColumn("range", F.floor(F.log2("key") * per_octave))
    by_range = rows.groupBy("source_rank", "range").agg(F.sum("size").alias("range_size"))
    ahead = F.sum("range_size").over(Window.partitionBy("source_rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    by_range = by_range.select("source_rank", "range", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    rows = rows.join(by_range, ["source_rank", "range"])
    within = F.sum("size").over(Window.partitionBy("source_rank", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1))
    full = F.least(F.lit(max_epochs), F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))).cast("long")
    rows = rows.withColumn("before", F.col("ahead") + F.coalesce(within, F.lit(0))).withColumn("full", full)
    rest = F.when(F.col("full") < max_epochs, F.col("target") - F.col("full") * F.col("source_size")).otherwise(F.lit(0.0))
    rows = scratch.cut(rows.withColumn("rest", rest).withColumn("chosen", F.col("before") + F.col("size") <= F.col("rest")))
    scratch.drop(sized, goals)
    # one more document of the others closes most of the gap that is left: the largest that fits, or the smallest of all
    gaps = rows.groupBy("source_rank").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("chosen"), F.col("size"))), F.lit(0))).alias("gap"))
    gaps = F.broadcast(gaps) if few else gaps
    pick = F.struct(F.when(F.col("size") <= F.col("gap"), F.col("size")).otherwise(-F.col("size")).alias("fit"), F.col("key"), F.col("doc_id"), F.col("tie"))
    closing = rows.filter(~F.col("chosen") & (F.col("size") > 0)).join(gaps, "source_rank").filter((F.col("gap") > 0) & (F.col("size") < 2 * F.col("gap")))
    closing = closing.groupBy("source_rank").agg(F.max(pick).alias("c")).select(F.col("source_rank").alias("c_rank"), F.col("c.key").alias("c_key"), F.col("c.doc_id").alias("c_id"), F.col("c.tie").alias("c_tie"))
    closing = F.broadcast(closing) if few else closing
    same = (F.col("source_rank") == F.col("c_rank")) & (F.col("key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_id")) & F.col("tie").eqNullSafe(F.col("c_tie"))
    out = rows.join(closing, same, "left")
    closes = F.col("c_rank").isNotNull() & ~F.col("chosen") & (F.col("size") > 0)
    out = out.withColumn("epochs", F.col("full") + (F.col("chosen") | closes).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"), *keep)


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    text = F.col("text")
    mixed = mix(docs, (5, 2, 1), size=n_words(text), quality=text_quality(text), tie=F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs")


def mixed_documents(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, with its own columns. Rows that are equal in all columns are
    copies of one document, which is repeated as often as all of them are taken. Texts are shuffled once, by document."""
    k1, k2, epochs, epoch = unused(docs, "k1", "k2", "epochs", "epoch")
    named = docs.withColumns({k1: row_hash(docs, 1), k2: row_hash(docs, 2)})
    text = F.col("text")
    mixed = mix(named.select("doc_id", "source", "text", F.col(k1).alias("k1"), F.col(k2).alias("k2")), weights, size=n_words(text), quality=text_quality(text), tie=F.concat_ws(" ", "k1", "k2"), keep=["k1", "k2"])
    taken = mixed.filter("epochs > 0").groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.sum("epochs").alias(epochs))
    return named.dropDuplicates([k1, k2]).join(taken, [k1, k2]).withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(epochs)))).drop(k1, k2, epochs, epoch)
