"""Nulls, empty tables, repeated rows, ties, long texts and columns of clashing names, operator by operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import mixed, taken_by_row
from tideline.llm import _common, bpe, chat, language_id, mixing, near_vectors, ngram_join, quality, sharding, top_k, toxicity
from tideline.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and a few others " * 60_000
ROWS = [(1, "the cat and the dog sat there", "en", "a", 1), (2, "der hund und die katze mit dem", "de", "a", 2), (3, None, "en", None, 3), (4, "", None, "b", 4), (5, " \n ", None, None, 5), (6, "½ ² ٣", "en", "b", 6), (None, "the dog", "en", "b", 7), (7, LONG, "en", "c", 8), (1, "the cat and the dog sat there", "en", "a", 1), (1, "another text of the same id here", "en", "a", 9), (8, "x", None, "c", None)]
CLASHES = ("_score", "_lang", "_k1", "k1", "_epochs", "epochs", "_id", "_goes", "key", "mark", "goes", "sieve_at", "lang_pred", "lang_score", "rejected", "quality_tail", "draw", "place", "size", "score")


def docs(spark, rows=ROWS, clashes=False):
    d = spark.createDataFrame(rows, DOCS)
    return d.select("*", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col("n_chars"), F.lit(0))).alias(c) for c in CLASHES)) if clashes else d


def labels(spark, n=40):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(n)], "doc_id long, quality int, toxic int")


def test_names_are_made_unique(spark):
    assert _common.unused(spark.createDataFrame([], "K1 int, _k1 int, b int"), "k1", "b", "c") == ["__k1", "_b", "c"]


STAGES = {
    "language_id": lambda s, d: language_id.keep_known(s, d),
    "quality": lambda s, d: quality.keep_good(s, d, labels(s)),
    "near_copies": lambda s, d: ngram_join.one_of_each(s, d),
    "mixing": lambda s, d: mixing.mixed_documents(s, d),
}


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns_of_any_name(spark, stage):
    d = docs(spark, clashes=True)
    got = STAGES[stage](spark, d)
    assert got.columns == d.columns
    known = {tuple(r) for r in d.collect()}
    rows = [tuple(r) for r in got.collect()]
    assert rows and set(rows) <= known
    plain = sorted(map(repr, (r[:5] for r in rows)))
    assert plain == sorted(map(repr, (tuple(r) for r in STAGES[stage](spark, docs(spark)).collect())))
    assert STAGES[stage](spark, d.limit(0)).count() == 0


def test_stages_take_columns_of_any_type(spark):
    d = docs(spark).withColumn("more", F.create_map(F.lit("a"), F.col("n_chars")))
    for stage in STAGES.values():
        assert {tuple(sorted((r["more"] or {}).items())) for r in stage(spark, d).collect()} <= {(("a", k),) for k in (*range(10), None)}


def test_repeated_ids_are_documents_of_their_own(spark):
    same = "one two three four five six seven eight"
    d = docs(spark, [(5, same, None, None, 1), (5, "quite another text than that one here", None, None, 1), (9, same, None, None, 1), (None, same, None, None, 1), (None, "z z", None, None, 1), (5, same, None, None, 1)])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in ngram_join.one_of_each(spark, d).collect())
    assert got == [(False, 5, same), (False, 5, "quite another text than that one here"), (True, 0, "z z")]
    by = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.op3(spark, d).collect()]
    assert sorted(by, key=repr) == sorted([(5, 5, 5), (5, 4, 5), (9, 5, 5), (None, 5, 5), (None, 1, None), (5, 5, 5)], key=repr)


def test_bounds_of_samples(spark):
    d = spark.createDataFrame([(7, "same text", "en")] * 3000 + [(None, f"t{i}", "en") for i in range(3000)] + [(i, "x" * 1000, "de") for i in range(50)], "i long, t string, l string")
    got = _common.bounded(_common.sampled(d, "l", 200, ["i", "t"]), "l", "t", 200, most_bytes=20_500, longest=5000)
    n = {r["l"]: r["count"] for r in got.groupBy("l").count().collect()}
    assert 100 < n["en"] <= 200 and n["de"] == 20
    assert _common.bounded(d, "l", "t", 10**6, longest=500).filter("l = 'de'").count() == 0
    assert _common.sampled(d, "l", 10**6, ["i", "t"], most_rows=60).count() in range(30, 61)


def test_pieces_of_long_texts_count_as_one_go(monkeypatch):
    data = "Ünïcödé and more of it, 123 ".encode() * 40
    whole = _common.ngram_counts(data, 12)
    for piece in (7, 64, 1000):
        monkeypatch.setattr(_common, "PIECE", piece)
        assert (_common.ngram_counts(data, 12) == whole).all()


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *a: None)}), type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        _common.shared_dir(Elsewhere)


# 1


def test_mixing_is_the_plain_version(spark):
    rows = [(i, None if i % 50 == 7 else "w#! " * (i % 9) + "t " * (i % 4), "en", [None, "a", "b", "é", "big", "big", "big"][i % 7], 0) for i in range(700)] + ROWS + [(9000 + i, "z", "en", "tiny", 0) for i in range(2)]
    d = docs(spark, rows)
    got = sorted((tuple(r) for r in mixing.op1(spark, d).collect()), key=repr)
    want = mixed([(r[0], r[3], r[1], hashlib.md5((r[1] or "").encode()).hexdigest()) for r in rows])
    assert got == sorted(((i, n, size, goal, n * e, e) for (i, _, _, _), n, size, goal, e in want), key=repr)
    assert mixing.op1(spark, d.limit(0)).count() == 0


def test_mixed_documents_are_what_the_mix_takes(spark):
    d = docs(spark, [(i, "w " * (i % 5), None, "ab"[i % 3 == 0], i) for i in range(200)] + ROWS)
    assert sorted((tuple(r) for r in mixing.mixed_documents(spark, d).collect()), key=repr) == sorted(taken_by_row(d), key=repr)


# 2


def plain_chat(rows):
    out, by = {}, {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = sum(len(f"<|im_start|>{chat.escape(r)}<|im_sep|>{chat.escape(x)}<|im_end|>") for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), whole)
    return out


def test_chat_query_is_the_plain_version(spark):
    ask = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "\\<s>"), (1, 1, "assistant", "<s>"), (1, 1, "assistant", "<\\s>"), (1, None, None, None), (2, 0, "user", LONG), (2, 0, "user", LONG), (None, 3, "assistant", "é"), (3, 0, "<s>", "<|im_end|>")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in chat.op2(spark, d.withColumn("formatted", F.lit("x")).withColumn("more", F.lit(1))).collect()}
    assert got == plain_chat([*rows, (-1, 0, "user", ask), (-1, 1, "assistant", ask)])
    assert [r.conv_id for r in chat.op2(spark, d.limit(0)).collect()] == [-1]


def test_chat_query_goes_by_fingerprint(spark):
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from: string, value: string>>")
    flat = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn int, role string, content string")
    same = [sorted(map(tuple, chat.op2(spark, d).collect())) for d in (nested, flat)]
    assert same[0] == same[1] and len(same[0]) == 2
    with pytest.raises(ValueError, match="no mapping"):
        chat.op2(spark, spark.createDataFrame([(1, "a", "b")], "conv_id long, question string, answer string"))


# 4


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_top_k_of_repeated_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 150 if i < 200 else 0, [float(x) for x in rng.integers(-3, 4, 6)], 0) for i in range(210)] + [(100, [1.0] * 6, 0), (100, [1.0] * 6, 0), (None, [1.0] * 6, 0), (3, [2.0] * 5, 0)]
    got = {}
    for r in top_k.op4(spark, vectors(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {}
    usable = [(i, v) for i, v, _ in rows if i is not None]
    for i, v in {(i, tuple(v)) for i, v in usable if i % 100 == 0}:
        score = sorted((-int(1024 * 1024 * np.dot(v, w)), j) for j, w in usable if j != i and len(w) == len(v))[:10]
        want.setdefault(i, []).extend((k + 1, j, -s) for k, (s, j) in enumerate(score))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_top_k_holds_scores_at_64_bits(spark):
    rows = [(0, [9e15, 9e15], 0), (1, [9e15, 9e15], 0), (2, [-9e15, -9e15], 0), (3, [1.0, 1.0], 0), (4, [1e300, 0.0], 0)]
    got = [(r.vec_id, r.score) for r in sorted(top_k.op4(spark, vectors(spark, rows)).collect(), key=lambda r: r["rank"])]
    assert sorted(got) == [(1, 2**63 - 1), (2, -(2**63)), (3, 2**63 - 1), (4, 2**63 - 1)]
    assert top_k.op4(spark, vectors(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("pivots", [1, 7])
def test_top_k_over_many_blocks(spark, monkeypatch, pivots):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 600 // pivots)
    monkeypatch.setattr(top_k, "CANDIDATES", 50)
    monkeypatch.setattr(top_k, "ASKED", 2)
    rng = np.random.default_rng(pivots)
    x = np.round(rng.normal(size=(700, 24)) + rng.normal(size=(7, 24))[np.arange(700) % 7] * 2, 2)
    got = top_k.op4(spark, vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()
    whole = np.floor(1024 * x).astype(np.int64)
    for q in range(0, 700, 100):
        score = whole @ whole[q]
        want = [(int(i), int(score[i])) for i in np.lexsort((np.arange(700), -score)) if i != q][:10]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


# 5, 6, 10


def learnable(spark, n=600):
    rows = [(i, ("the of and this " if i % 2 else "der und nicht mit ") * 4 + ("grblx " if i % 4 == 1 else "") + f"w{i % 37}", "en" if i % 2 else "de", "s", 0) for i in range(n)]
    return rows, spark.createDataFrame([(i, int(i % 5 > 0), int(i % 4 == 1)) for i in range(n)] + [(None, 1, 1), (3, None, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_query_is_the_plain_version(spark):
    rows, lab = learnable(spark)
    d = docs(spark, rows + ROWS, clashes=True)
    m = toxicity.train(d, lab)
    got = sorted((tuple(r) for r in toxicity.op5(spark, d, lab).collect()), key=repr)
    want = [(i, held(i), m.score(t, {})) for i, t, *_ in rows + ROWS]
    assert got == sorted(((i, h, s, int(s >= 0.7)) for i, h, s in want), key=repr)
    marked = {i for i, _, s, p in got if p}
    assert marked == {r[0] for r in rows if "grblx" in r[1]}
    none = toxicity.op5(spark, d, lab.limit(0)).collect()
    assert len(none) == len(rows) + len(ROWS) and {r.score for r in none} == {0.5} and toxicity.op5(spark, d.limit(0), lab).count() == 0


def test_lexicon_counts_are_those_of_all_rows(spark):
    rows, lab = learnable(spark)
    known = lab.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").alias("label"))
    n, total = toxicity.occurrences(docs(spark, rows).select("doc_id", F.col("text").alias("t")), known, ["grblx", "the", "nicht"])
    free = [r for r in rows if not held(r[0]) and r[0] != 3] + [r for r in rows if r[0] == 3 and not held(3)]
    want = [[sum(w in r[1].split() and (r[0] % 4 == 1) == y for r in free) for w in ("grblx", "the", "nicht")] for y in (False, True)]
    assert n.tolist() == want and total.sum() == known.count()


def test_quality_query_is_the_plain_version(spark):
    rows, lab = learnable(spark)
    rows = [(i, ("*** | ## " * 5 if i % 5 == 0 else "") + t, *r) for i, t, *r in rows]
    d = docs(spark, rows + ROWS, clashes=True)
    m = quality.train(d, lab)
    got = sorted((tuple(r) for r in quality.op6(spark, d, lab).collect()), key=repr)
    want = [(i, *m.predict(t)) for i, t, *_ in rows + ROWS]
    assert got == sorted(((i, g, p, p < 0.5) for i, g, p in want), key=repr)
    assert sum(r[3] == (r[0] % 5 == 0) for r in got if r[0] is not None and r[0] > 20) > 560
    kept = quality.op6(spark, d, lab.limit(0)).collect()
    assert all(r.rejected == (not (t or "").strip()) for r, t in zip(sorted(kept, key=lambda r: repr(r.doc_id)), [t for _, t in sorted(((i, t) for i, t, *_ in rows + ROWS), key=lambda x: repr(x[0]))], strict=True) if r.doc_id not in (1,))


def test_language_query_is_the_plain_version(spark):
    rows, _ = learnable(spark)
    d = docs(spark, rows + ROWS, clashes=True)
    m = language_id.train(d)
    got = sorted((tuple(r)[:4] for r in language_id.op10(spark, d).collect()), key=repr)
    assert got == sorted(((i, held(i), *m.predict(t)) for i, t, *_ in rows + ROWS), key=repr)
    und = {i for i, _, lang, s in got if lang == "und"}
    assert und == {3, 4, 5, 6} and m.langs == ["de", "en"]
    assert {r.lang_pred for r in language_id.op10(spark, d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.op10(spark, d.limit(0)).count() == 0


# 7


def test_near_vectors_of_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [4.0, -1.0, 0.0, 1.0]
    rows = [(1, v, 0), (1, v, 0), (1, w, 0), (2, v, 0), (3, w, 0), (None, v, 0), (4, [x * 2 for x in v], 0), (5, v, None), (6, v, 1), (7, [0.0] * 4, 0), (8, [1.0, None, 1.0, 1.0], 0), (9, [], 0), (10, None, 0), (11, [float("nan")] * 4, 0)]
    got = sorted((tuple(r) for r in near_vectors.op7(spark, vectors(spark, rows)).collect()), key=repr)
    want = [(1, 3, 1, True), (1, 3, 1, True), (1, 1, 1, True), (2, 3, 1, False), (3, 1, 1, False), (None, 0, None, True), (4, 3, 1, False)] + [(i, 0, i, True) for i in range(5, 12)]
    assert got == sorted(want, key=repr)


def test_recall_of_each_plan():
    rng = np.random.default_rng(8)
    x = near_vectors.normal(rng.normal(size=(1500, 48)))
    side = near_vectors.normal(rng.normal(size=x.shape))
    side = near_vectors.normal(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * side  # all pairs exactly at the threshold
    for members in (100, 10**5, 10**7, 10**9):
        how = near_vectors.plan(members, 0.98)
        (a, pa_), (b, pb) = near_vectors.codes(x, how), near_vectors.codes(y, how)
        met = (a == b) | (pb == a[:, :, None]).any(2) | (pa_ == b[:, :, None]).any(2)
        assert met.any(1).mean() >= 0.99, how


# 8


def test_sharding_columns_and_odd_rows(spark):
    d = docs(spark, ROWS * 3, clashes=True)
    got = sharding.op8(spark, d).collect()
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS * 3), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(len(by.get(k, [])) for k in range(24)) <= 1
    again = sharding.op8(spark, d.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_sharding_of_a_large_group(spark):
    rows = [(i, "hot") for i in range(3000)] + [(10_000 + i, f"pair{i // 2}") for i in range(2000)] + [(20_000 + i, f"t{i}") for i in range(4000)]
    got = sharding.op8(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = np.bincount([r.shard for r in got], minlength=24)
    assert sizes.max() - sizes.min() <= 1 and len(got) == len(rows)
    pairs = {}
    for r in got:
        if 10_000 <= r.doc_id < 20_000:
            pairs.setdefault((r.doc_id - 10_000) // 2, set()).add(r.shard)
    assert np.mean([len(s) == 1 for s in pairs.values()]) > 0.9


# 9


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    lib.no_truncation(), lib.no_padding()
    return lib


def test_bpe_of_every_code_point(library):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b" for c in points[at : at + 500]) for at in range(0, len(points), 500)]
    got = [ids for _, ids, _ in bpe.load(vocabulary()).encode(texts)]
    want = [" ".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_bpe_of_new_code_points_together(library):
    import random

    rng = random.Random(9)
    new = [0x558, 0x88F, 0x1C89, 0xA7CB, 0xA7DC, 0x10D4A, 0x113C2, 0x1E5D0, 0x41, 0xE9, 0x301, 0x345, 0x20, 0x31]
    texts = ["".join(chr(rng.choice(new)) for _ in range(12)) for _ in range(2000)]
    assert [ids for _, ids, _ in bpe.load(vocabulary()).encode(texts)] == [" ".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_query_is_the_library(spark, library):
    words = ["a" * n for n in (94, 95, 96, 97, 98, 500)] + ["".join(chr(97 + i * 7 % 26) for i in range(n)) for n in (95, 96, 97)] + ["é" * 48, "é" * 49]  # both sides of LONG
    rows = ROWS + [(100 + i, w, None, None, 0) for i, w in enumerate(words)]
    got = sorted((tuple(r) for r in bpe.op9(spark, docs(spark, rows, clashes=True), vocabulary()).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.op9(spark, docs(spark).limit(0), vocabulary()).count() == 0
