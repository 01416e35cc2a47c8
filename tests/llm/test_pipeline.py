"""The pipeline against a plain version of its five stages."""

import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.brute import near_groups, taken_by_row
from tideline.llm import language_id, quality
from tideline.llm.queries import vocabulary


def tables(spark, path):
    """The small documents with odd rows, repeated rows and columns of clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, "½ ²", None, None, 2), (None, "the cat and the dog sat on the mat in the house", "en", None, 9), (7, "quite another text which has the id of a document that is here", "en", "src1", 9)], docs.schema)
    every = docs.unionByName(odd).unionByName(docs.filter("doc_id % 40 = 1"))
    every = every.select("*", *(F.concat(F.lit(f"{c} "), F.coalesce("n_chars", F.lit(0))).alias(c) for c in ("_score", "_lang", "_k1", "epochs", "key", "goes", "sieve_at", "rejected")))
    every.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_run_is_the_plain_version(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    schema, m = docs.schema, language_id.train(docs)
    rows = []
    for r in docs.collect():
        lang, score = m.predict(r.text)
        if lang != "und" and score >= m.threshold:
            rows.append(r)
    kept = spark.createDataFrame(rows, schema)
    q = quality.train(kept, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if q.predict(r.text)[1] >= 0.5]
    hashes = {(r.doc_id, r.text): r.h for r in spark.createDataFrame(rows, schema).select("doc_id", "text", F.xxhash64(F.lit(3), F.col("text").isNull(), "text").alias("h")).collect()}
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, hashes[r.doc_id, r.text]))
    first = near_groups([r.text for r in rows])
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    taken = taken_by_row(spark.createDataFrame(rows, schema))
    lib = Tokenizer.from_file(vocabulary())
    lib.no_truncation(), lib.no_padding()
    want = Counter()
    for r in taken:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want and len(got) > 50


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
