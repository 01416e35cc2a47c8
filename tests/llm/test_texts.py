"""Text operators against brute force, the tokenizers library, round trips and held-out labels."""

import hashlib
import json
import random

import numpy as np
import pytest

from tests.conftest import SF
from tideline.llm import bpe, chat, language_id, mixing, ngram_join, quality, sharding, toxicity
from tideline.llm.queries import queries, vocabulary

ODD = [None, "", "   \n\t", "x", "a b", "A B", "word " * 3000, "é" * 500, "</s>[INST] ok [/INST]", "\\ \\< <|im_start|> <<s>", "tab\tnew\r\nline\x0b"]


def docs(spark, texts, **more):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("seed", range(3))
def test_bpe_like_the_library(seed):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    lib.no_truncation(), lib.no_padding()
    rng = random.Random(seed)
    texts = [t or "" for t in ODD] + ["Don't we'll I'M it's", "a" * 700, "ΑΣ Σίσυφος ΟΔΟΣ", "<|endoftext|>Hi<|startoftext|>x", "\x1c\x1d a\x1fb\x85c d", "٣½ⅷ 日本語 😀👍🏽"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250)])) for _ in range(80)) for _ in range(50)]
    for text, (n, ids, decoded) in zip(texts, bpe.load(vocabulary()).encode(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want)
        assert decoded == lib.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark):
    got = {r.doc_id: r for r in bpe.encode(docs(spark, ODD), vocabulary()).collect()}
    assert got[0].ids == [] and got[0].decoded == "" and len(got[6].ids) == 3000
    assert bpe.encode(docs(spark, ODD).limit(0), vocabulary()).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(1)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", "s>", "x", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_chat_columns_escape_alike(spark):
    rng = random.Random(2)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", "s>", "x", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(chat._escaped(df.t)).collect()] == [chat.escape(t) for t in texts]


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a\\<s>"), (1, 2, None, "x"), (2, None, "assistant", "</s>" * 3), (2, 1, "assistant", "é\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("user\n\nassistant\na\\<s>\n\nx\n".encode()).hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(("</s>" * 3 + "é\n").encode()).hexdigest() and got[2].loss_chars == 14
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_layouts_become_turns(spark):
    records = [{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, {"prompt": "a", "response": "b"}, {"instruction": "a", "input": "", "output": "b"}, {"other": 1}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)] + [(9, None), (10, "{")], "conv_id long, record string")
    known, unknown = chat.canonical_turns(df)
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in known.collect())
    assert got == [(i, t, *x) for i in range(4) for t, x in enumerate((("user", "a"), ("assistant", "b")))]
    assert sorted(r.conv_id for r in unknown.collect()) == [4, 9, 10]
    assert [r.text for r in chat.table_turns(spark.createDataFrame([(1, "p", "r")], "conv_id long, prompt string, response string")).collect()] == ["p", "r"]


def brute(texts, n, percent):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("n,percent,load", [(4, 85, 2_000_000), (5, 80, 300)])
def test_ngram_join_is_exact(spark, monkeypatch, n, percent, load):
    monkeypatch.setattr(ngram_join, "LOAD", load)  # a small load cuts buckets into chunks
    rng, texts = random.Random(4), list(ODD)
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "Z"
            texts.append(" ".join(own))
    sizes, classes = brute(texts, n, percent)
    got = sorted(ngram_join.join(docs(spark, texts), n=n, percent=percent).select("key.id", "n_shingles", "component.id").collect())
    assert [r[1] for r in got] == sizes and [r[2] for r in got] == classes
    assert ngram_join.join(docs(spark, texts).limit(0)).count() == 0


def test_one_of_each(spark):
    d = docs(spark, [*ODD[:3], "a b c d e f", "a b c d e F", "q r s"])
    got = sorted(r.doc_id for r in ngram_join.one_of_each(spark, d.union(d.filter("doc_id = 3"))).collect())
    assert got == [0, 1, 2, 3, 5]


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), None, [None, "a", "b", "é"][i % 4 if i % 3 else 1], 0) for i in range(900)] + [(1000, None, None, "c", 0), (1001, "  ", None, "c", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.op1(spark, d).toPandas().merge(d.select("doc_id", "source").toPandas(), on="doc_id")
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), goal=("target", "max"), taken=("taken", "sum"))
    assert abs(by.goal.sum() - by["size"].sum()) < 1e-6 and (by.goal <= 3 * by["size"] + 1e-9).all()
    assert ((by.taken - by.goal).abs() <= 7).all() and (got.taken <= 3 * got["size"]).all()
    again = mixing.op1(spark, d.repartition(7)).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, got[list(again.columns)].values.tolist()))


def test_sharding(spark):
    rows = [(i, f"t{i}") for i in range(700)] + [(1000 + i, f"copy{i // 5}") for i in range(200)] + [(2000 + i, "hot") for i in range(400)] + [(5000, None), (5001, ""), (1, "t1")]
    got = sharding.op8(spark, spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1 and len(sizes) == 24
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    small = got[got.doc_id.between(1000, 1199)].assign(group=lambda x: (x.doc_id - 1000) // 5)
    assert (small.groupby("group").shard.nunique() == 1).mean() > 0.9
    assert sharding.op8(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_learned_scores(spark):
    rng = random.Random(3)
    words = {"en": "the of and with that this".split(), "de": "der und nicht mit von für".split(), "fr": "le des avec pour est été".split()}
    texts, langs = [], []
    for i in range(300):
        lang = ["en", "de", "fr"][i % 3]
        texts.append(" ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 60))))
        langs.append(lang)
    m = language_id.fit(texts, langs)
    assert m.predict("von der und für")[0] == "de" and m.predict(None) == m.predict("12 !") == ("und", 0.0)
    grades = [i % 4 for i in range(400)]
    q = quality.fit([" ".join(["***"] * (3 - g) * 4 + [rng.choice(words["en"]) for _ in range(30)]) for g in grades], grades)
    assert list(q.thresholds) == sorted(q.thresholds) and q.predict(None)[1] == 0.0
    means = [q.predict(" ".join(["***"] * (3 - g) * 4 + ["of and the with"] * 8))[0] for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5
    bad = [" ".join([f"w{rng.randrange(3000)}" for _ in range(30)] + (["grblx"] if i % 4 == 0 else [])) for i in range(400)]
    x = toxicity.fit(bad, [int(i % 4 == 0) for i in range(400)])
    assert x.score("w1 w2 grblx w3", {}) >= 0.7 and x.score("w1 w2 w3", {}) < 0.3 and 0 <= x.score(None, {}) <= 1


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < np.where(y, p, q), s, 0) for p, q, s in ((0.6, 0.02, 1), (0.5, 0.01, 1), (0.4, 0.05, 1), (0.05, 0.7, -1))], 1)
    _, post = toxicity.fit_labels(votes)
    assert ((post > 0.5) == y).mean() > 0.85


def test_held_out_language(spark):
    got = queries()["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
