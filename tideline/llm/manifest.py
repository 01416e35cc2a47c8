"""Merkle manifest of a data set: a tree of digests by source, one over the sources, a proof for every row. Built-in functions only.

Nodes are labelled by the interval of leaf ranks which they cover, and by their parent's interval. A node is a sibling on the way from a
leaf to the root exactly if the leaf's rank lies in the parent's interval but not in the node's own; it is the leaf's own ancestor if it
lies in both. So one containment join gives a leaf its ancestors and all siblings, with neither pointers nor one join a level.

Levels come in bands of BAND: a node belongs to the bucket which the ancestor at the band's top covers, so that the join has an equal key
(tree, bucket) beside the containment, and a bucket holds at most ARITY ** BAND nodes of the lowest level. Trees are built
band by band upwards (one shuffle a band, in which a bucket's digests are folded as one short array); paths to the root go down
the same way, each band adding its own entries to those of the bucket. So 10**11 rows take six bands. No step depends on how many
rows a source has: a source's rows are dealt by ranges of (source, doc_id, leaf), and ranks come from counts by range.

Texts are read once and never shuffled; what moves are digests.

Defined results: nulls count as `-` and are told from the text `-` by its length before it; the null source is a tree of its own and first. A
null id comes first in its source and is never tampered. Rows of equal ids are ordered by their leaf; equal rows have equal
leaves, so that their order doesn't matter, and each gets its proof. A source of one row is its own subroot; if there is but one
source, its subroot is the root; a proof without siblings is the digest of ''. Texts of any length are hashed whole. An empty table gives no
rows. Extra columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch

ARITY, BAND = 3, 4
BROADCAST_SOURCES = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex of sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def ranked(scratch: Scratch, rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds tree (a number by group, in the order of the groups), rank (from 0 in its group) and n (rows of the group). Rows are dealt by ranges of
    group and order and sorted there; counts by range, one row a group and range, give where each range begins."""
    keys = [*group, *order]
    dealt = scratch.cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    w = Window.partitionBy(*group)
    by = dealt.groupBy(*group, part).agg(F.min("at").alias("first"), F.count("*").alias("m"))
    ahead = F.sum("m").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by = by.select(*(F.col(c).alias(f"{c}_") for c in group), F.col("part").alias("part_"), "first", F.min("first").over(w).alias("tree"), F.sum("m").over(w).alias("n"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    same = F.shiftright("at", 33) == F.col("part_")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    return scratch.cut(dealt.join(by, same).withColumn("rank", F.col("ahead") + F.col("at") - F.col("first")).select(*rows.columns, "tree", "rank", "n"))


def hashed_runs(nodes: Column) -> Column:
    """The digests of runs of ARITY nodes, the last of which may be shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), ""), 256))


def forest(scratch: Scratch, leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From leaves (tree, rank, n, digest): the roots (tree, root) and, band by band, the nodes that have a parent: tree, bucket, level, lo
    and hi (which ranks of the band's lowest level it covers), from_ and to (which ones its parent covers), digest."""
    width, none = ARITY**BAND, F.array().cast("array<string>")
    units, roots, bands = leaves.select("tree", "rank", "n", "digest"), [], []
    most = leaves.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while True:
        roots.append(units.filter("n = 1").select("tree", F.col("digest").alias("root")))
        if most <= 1:
            break
        members = F.array_sort(F.collect_list(F.struct("rank", "digest")))
        buckets = units.filter("n > 1").groupBy("tree", "n", F.floor(F.col("rank") / width).alias("bucket")).agg(F.transform(members, lambda m: m["digest"]).alias("l0"))
        for k in range(BAND):  # a tree with further buckets goes on to the band's top, else it stops where one node is left
            size = F.size(f"l{k}")
            buckets = buckets.withColumn(f"l{k + 1}", F.when((size > 1) | (F.col("n") > width) & (size > 0), hashed_runs(F.col(f"l{k}"))).otherwise(none))
        buckets, nodes = scratch.cut(buckets), None
        for k in range(BAND):
            start, span, above = F.col("bucket") * width, ARITY**k, ARITY ** (k + 1)
            level = buckets.filter(F.size(f"l{k + 1}") > 0).select("tree", "bucket", F.posexplode(f"l{k}").alias("i", "digest"))
            lo, from_ = start + F.col("i") * span, start + F.floor(F.col("i") / ARITY) * above
            level = level.select("tree", "bucket", F.lit(len(bands) * BAND + k).alias("level"), lo.alias("lo"), (lo + span - 1).alias("hi"), from_.alias("from_"), (from_ + above - 1).alias("to"), "digest")
            nodes = level if nodes is None else nodes.union(level)
        bands.append(nodes)
        top = F.coalesce(*(F.try_element_at(f"l{k}", F.lit(1)) for k in range(BAND, -1, -1)))
        units = buckets.select("tree", F.col("bucket").alias("rank"), F.ceil(F.col("n") / width).alias("n"), top.alias("digest"))
        most = -(-most // width)
    out = roots[0]
    for r in roots[1:]:
        out = out.union(r)
    return scratch.cut(out), bands


PATH = "array<struct<level:int,lo:bigint,own:boolean,digest:string>>"


def paths(scratch: Scratch, leaves: DataFrame, bands: list[DataFrame], keep: list[str]) -> DataFrame:
    """tree, the columns of `keep`, and the path of every leaf (tree, rank): from the lowest level to the tree's root the runs of nodes
    which are hashed together, as one array of level, lo, own (the leaf's ancestor or the leaf itself) and digest."""
    width, ends = ARITY**BAND, None  # ends: of each bucket of this band, the path from its top on
    bucket = F.floor(F.col("rank") / width).alias("bucket")
    for b in reversed(range(len(bands))):
        low = leaves.select("tree", "rank", bucket, *keep) if b == 0 else bands[b - 1].select("tree", F.col("bucket").alias("rank")).distinct().select("tree", "rank", bucket)
        inside = low.join(bands[b], ["tree", "bucket"], "left").filter("lo is null or rank between from_ and to")
        entry = F.when(F.col("lo").isNotNull(), F.struct("level", "lo", F.expr("rank between lo and hi").alias("own"), "digest"))
        got = inside.groupBy("tree", "bucket", "rank").agg(F.array_sort(F.collect_list(entry)).cast(PATH).alias("path"), *(F.first(c).alias(c) for c in (keep if b == 0 else [])))
        if ends is not None:
            got = got.join(ends, ["tree", "bucket"], "left").withColumn("path", F.concat("path", F.coalesce("end", F.array().cast(PATH))))
        if b == 0:
            return got.select("tree", *keep, "path")
        ends = scratch.cut(got.select("tree", F.col("rank").alias("bucket"), F.col("path").alias("end")))
    return leaves.select("tree", *keep, F.array().cast(PATH).alias("path"))


def proven(scratch: Scratch, leaves: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of `keep`, leaf, subroot, root, and the path from leaf to root of every row of leaves (source, doc_id, leaf, `keep`)."""
    rows = ranked(scratch, leaves, ["source"], ["doc_id", "leaf"])
    rows = rows.withColumn("digest", F.col("leaf"))
    roots, bands = forest(scratch, rows)
    tops = ranked(scratch, roots.select(F.col("tree").alias("of"), F.col("root").alias("digest")), [], ["of"])
    root, top_bands = forest(scratch, tops)
    above = paths(scratch, tops.withColumn("subroot", F.col("digest")), top_bands, ["of", "subroot"])
    # levels over the sources are told from those below by their number
    above = above.select("of", "subroot", F.transform("path", lambda e: e.withField("level", e["level"] + 1000)).cast(PATH).alias("above"))
    above = scratch.cut(above.crossJoin(F.broadcast(root.select("root"))))  # one row
    few = above.count() <= BROADCAST_SOURCES  # beyond that, a shuffled join which Spark splits where it is skewed
    got = paths(scratch, rows, bands, list(dict.fromkeys([*keep, "leaf"])))
    return got.join(F.broadcast(above) if few else above, F.col("tree") == F.col("of")).withColumn("path", F.concat("path", "above")).drop("tree", "of", "above")


def siblings(path: Column) -> Column:
    """The digest of the siblings' digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(F.filter(path, lambda e: ~e["own"]), lambda e: e["digest"]), ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    start = F.struct(F.lit(-1).alias("level"), F.lit("").alias("run"), leaf.alias("now"))

    def step(acc: Column, e: Column) -> Column:
        new = acc["level"] != e["level"]  # then the run before is whole, and its digest goes on
        now = F.when(new & (acc["level"] >= 0), F.sha2(acc["run"], 256)).otherwise(acc["now"])
        run = F.concat(F.when(new, F.lit("")).otherwise(acc["run"]), F.when(e["own"], now).otherwise(e["digest"]))
        return F.struct(e["level"].alias("level"), run.alias("run"), now.alias("now"))

    return F.aggregate(path, start, step, lambda acc: F.when(acc["level"] >= 0, F.sha2(acc["run"], 256)).otherwise(acc["now"]))


def manifest(docs: DataFrame, *, other_text: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root and path (see `paths`) of every row. other_text: a second text, whose leaf is
    given as other_leaf, for checking what has become of a row."""
    leaf = digest(*(field(F.col(c)) for c in FIELDS))
    more = [] if other_text is None else [digest(*(field(other_text if c == "text" else F.col(c)) for c in FIELDS)).alias("other_leaf")]
    scratch = Scratch(docs.sparkSession)
    leaves = scratch.cut(docs.select("doc_id", "source", leaf.alias("leaf"), *more))
    return proven(scratch, leaves, ["doc_id", "source", *(["other_leaf"] if more else [])])


def op12(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The manifest, and each row's proof checked against the leaf of a text that lost its line ends where the id's CRC is even."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    got = manifest(docs, other_text=F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))
    out = got.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.col("other_leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
