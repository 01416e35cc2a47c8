"""Vector operators and the pipeline against brute force."""

import numpy as np

import corpus_pipeline
from tests.conftest import SF
from tideline.llm import near_vectors, top_k


def table(spark, x, labels):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], l) for i, (v, l) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int")


ODD = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 7]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 40)  # cuts cells into chunks
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    x = [*(base[i % 30] + rng.normal(size=16) * 0.12 * (i % 4) for i in range(400)), *([base[0]] * 90)]
    labels = [i % 30 % 3 for i in range(400)] + [0] * 80 + [None] * 10
    got = sorted(near_vectors.near_duplicates(table(spark, [*x, *ODD], [*labels, *[1] * len(ODD)])).collect())
    v = np.array(x, np.float32).astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([-1 if k is None else k for k in labels])
    near = (u @ u.T >= 0.98) & (lab[:, None] == lab[None, :]) & (lab[:, None] >= 0)
    np.fill_diagonal(near, False)
    found = np.array([r.n_links for r in got[: len(x)]])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got[len(x) :])
    assert near_vectors.near_duplicates(table(spark, [], [])).count() == 0


def test_decode_gives_the_nearest_point():
    y = np.random.default_rng(1).normal(size=(500, 8)) * 2
    p = near_vectors.decode(y)
    near = ((y - p) ** 2).sum(1)
    assert all((near <= ((y - p - r) ** 2).sum(1) + 1e-9).all() for r in near_vectors.roots()) and len(near_vectors.roots()) == 240


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(top_k, "CANDIDATES", 150)
    monkeypatch.setattr(top_k, "ASKED", 2)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(500, 20)) * rng.choice([0.2, 1.0], size=(500, 1)), 1)
    x[7:60] = x[0]
    got = top_k.op4(spark, table(spark, [*x, *ODD], [0] * (500 + len(ODD)))).collect()
    whole = np.floor(1024 * x.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 500, 100):
        score = whole @ whole[q]
        want = [(int(i), int(score[i])) for i in np.lexsort((np.arange(500), -score)) if i != q][:10]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
