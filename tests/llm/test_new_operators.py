"""Licence scan, Merkle manifest and tokenizer alignment against plain versions, with odd rows and columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tideline.llm import alignment, licences, manifest
from tideline.llm.queries import queries, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "tree rank n at part first ahead bucket level lo hi leaf digest path subroot of row pair pairs times a b n_a licences found places n_words word".split()
LONG = "word and a few others, all rights reserved.\n" * 40_000
PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ROWS = [(1, "the cat\nand the dog", "en", "b", 1), (2, None, None, None, None), (3, "", "en", "b", 3), (None, "x\ny", "en", "b", 4), (1, "the cat\nand the dog", "en", "b", 1), (4, LONG, "en", "é", 5), (5, "-", "-", "-", 0), (6, "▁ ok", "en", "b", 6), (7, "a  b \n 日本語 😀 <|endoftext|>", "en", "b", 7)]
ROWS += [(100 + i, f"text {i}\n of many", "en", "b", i) for i in range(300)]


def clashing(d):
    return d.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


# alignment


def plain_alignment(rows):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each (doc_id, text), from the bytes at which tokens end."""
    al = alignment.load(*PATHS)
    links, out = [], []
    for text in rows:
        text = text or ""
        a, b = al.a.encode(f" {text}", add_special_tokens=False).ids, al.b.encode(text)
        bytes_a, bytes_b = [al.bytes_a[i] for i in a], [al.bytes_b[i] for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(al.bytes_a[i]) for i in a]), np.cumsum([len(al.bytes_b[i]) for i in b])
        groups, x0, y0 = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            x, y = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append((a[x0:x], b[y0:y]))
            x0, y0 = x, y
        links.append(Counter((u, v) for x, y in groups for u in x for v in y))
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), sum(links[-1].values()), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    documents, top = Counter(p for c in links for p in c), defaultdict(int)
    for (u, _), n in documents.items():
        top[u] = max(top[u], n)
    return [(*o[:4], sum(m for p, m in c.items() if documents[p] == top[p[0]]), sum(m * documents[p] for p, m in c.items()), o[4]) for o, c in zip(out, links, strict=True)]


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_alignment_counts(spark, most):
    d = spark.createDataFrame(ROWS[:40], DOCS)
    want = sorted(zip([repr(r[0]) for r in ROWS[:40]], plain_alignment([r[1] for r in ROWS[:40]]), strict=True))
    got = alignment.counted(clashing(d), *PATHS, most_pairs=most)
    assert sorted((repr(r.doc_id), tuple(r)[1:]) for r in got.collect()) == want
    assert alignment.counted(d.limit(0), *PATHS).count() == 0


def test_alignment_of_odd_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t  abcdeéß'▁日.,1\xa0　\x85<>s|́😀") for _ in range(rng.randrange(70))) for _ in range(3000)]
    texts += ["=" * 3000, " " * 999 + "x ", "don't  we'll '  s", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00 \x1c a \x1d", None, ""]
    counts, sha, pairs, times, at = alignment.load(*PATHS).digests(texts)
    want = plain_alignment(texts)
    assert [(*(int(c[k]) for c in counts), sha[k]) for k in range(len(texts))] == [(*w[:4], w[6]) for w in want]
    assert [int(times[at[k] : at[k + 1]].sum()) for k in range(len(texts))] == [w[3] for w in want]
    assert all((np.diff(pairs[at[k] : at[k + 1]]) > 0).all() for k in range(len(texts)))


def test_alignment_windows_are_cut_at_anchors_and_remembered():
    al = alignment.load(*PATHS)
    (a, b) = al.tokens(["the cat sat on the cat mat"])[0]
    windows, _ = al.cut(a, b)
    assert len(windows) == 7 and windows[1] == windows[5] and b"".join(w[0] for w in windows) == a and b"".join(w[1] for w in windows) == b
    al.windows.forget()
    al.aligned(dict.fromkeys(windows, 0))
    assert len(al.windows) == len(set(windows))


def test_alignment_without_shared_ends_counts_pairs(monkeypatch):
    monkeypatch.setattr(alignment, "LONG_GROUP", 1)
    al = alignment.load(*PATHS)
    al.windows.forget()
    texts = ["schungtzerbever antherinin", "日本語のテキスト 😀👍🏽 ééé"]
    got = al.digests(texts)
    al.windows.forget()
    assert [int(got[3][got[4][k] : got[4][k + 1]].sum()) for k in range(2)] == [w[3] for w in plain_alignment(texts)]


def test_alignment_groups(spark):
    r = alignment.align(spark.createDataFrame(ROWS[:9], DOCS), *PATHS).collect()
    for row in r:
        whole = f" {row.text}".encode()
        ends = [g.end for g in row.groups]
        assert [g.start for g in row.groups] == [0, *ends[:-1]][: len(ends)] and (not ends or ends[-1] == len(whole))
    assert r[1].groups == [] and r[7].groups == []


def test_op13_rows(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries()["op13_tokenizer_alignment"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], plain_alignment([r.text for r in rows]), strict=True))


# manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(r, text):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):  # levels of runs of three
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def way(levels, i):
        for nodes in levels[:-1]:
            yield nodes[i // 3 * 3 : i // 3 * 3 + 3], i % 3
            i //= 3

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in order}
    levels = {s: tree([leaf(r, r[1]) for r in rs]) for s, rs in trees.items()}
    top = tree([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            now, proof = leaf(r, r[1].replace("\n", "") if changed else r[1]), []
            for run, at in (*way(levels[s], i), *way(top, k)):
                proof += [d for j, d in enumerate(run) if j != at]
                now = H(*(now if j == at else d for j, d in enumerate(run)))
            out.append((r[0], leaf(r, r[1]), levels[s][-1][0], top[-1][0], H(*proof), now, now == top[-1][0]))
    return sorted(out, key=repr)


SIZES = [1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 243, 300]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[4:7], [(i, f"t\n{i}", None, f"s{n}", n) for n in SIZES for i in range(n)], [(i, "t", "x", str(i), 0) for i in range(100)]])
def test_manifest_like_a_plain_tree(spark, rows):
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    got = manifest.op12(spark, clashing(d)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)
    assert {r.verified for r in got} <= {True, False} and manifest.op12(spark, d.limit(0)).count() == 0


def test_manifest_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BROADCAST_SOURCES", 0)
    d = spark.createDataFrame(ROWS, DOCS)
    assert sorted((tuple(r) for r in manifest.op12(spark, d).collect()), key=repr) == plain_manifest(ROWS)


# licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w, ps = WORD.findall(low), []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        ps += [(s, label) for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
    starts = [s for s, _ in ps]
    return len(w), len(ps), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in ps}))


TEXTS = [None, "", " \n", "CC-BY", "ccby cc  by", "cc\x00by cc:by cc by", "All Rights\nReserved all rights all rights reserved", "GNU General Public License general public licenses", "Éall rights reserved", "cc cc by by cc by", LONG]


@pytest.mark.parametrize("block", [1 << 20, 7, 64])
def test_base_places_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(licences, "BLOCK", block)
    texts = TEXTS if block > 1000 else TEXTS[:-1] + ["x y all rights reserved " * 50 + "released under the MIT license " * 3]
    look = licences.Index(licences.templates(), dict.fromkeys((w for t in licences.templates() for w in t.words), 1.0))
    for t in texts:
        n, places = look.places(t)
        base = [p for p in places if p[3]]
        assert (n, len(base), min((p[1] for p in base), default=None), max((p[1] for p in base), default=None), ",".join(sorted({p[0] for p in base}))) == plain_base(t)
    assert sum(p[0] == "mit" for p in look.places(texts[-1])[1]) == (0 if block > 1000 else 3)


def test_notices_are_found_and_only_they(spark):
    notices = [(label, n) for label, n, _ in licences.NOTICES]
    noise = "a quiet text about something else, under the rights of all who read it. "
    texts = [noise + n.upper() + ". " + noise for _, n in notices]
    texts += [noise + " ".join(w for i, w in enumerate(n.split()) if i != 1) + " " + noise for _, n in notices if len(n.split()) > 14]  # a word lost
    texts += [noise * 3, "the license version 2 of public domain software", "mit", "Licensed under the Apache HTTP server rules"]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in licences.op11(spark, clashing(d)).collect()}
    for i, (label, _) in enumerate(notices):
        assert label in got[i].labels.split(","), label
        assert got[i].score > 0.99
    for i, (label, n) in enumerate([x for x in notices if len(x[1].split()) > 14]):
        if not any(key.split()[0] == n.split()[1] or n.split()[1] in key.split() for key in next(k for _, m, k in licences.NOTICES if m == n)):
            assert label in got[len(notices) + i].labels.split(","), label
    assert all(got[i].labels == "" and got[i].score == 0 for i in range(len(texts) - 4, len(texts)))


def test_op11_rows(spark):
    got = queries()["op11_licence_scan"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    d = spark.createDataFrame(ROWS[:8], DOCS)
    assert same(licences.op11(spark, clashing(d)), licences.op11(spark, d)) and licences.op11(spark, d.limit(0)).count() == 0


def test_document_counts(spark):
    d = spark.createDataFrame([(1, "Mit mit license",), (2, None), (2, "the LICENSE"), (None, "")], "doc_id int, text string")
    assert licences.document_counts(d, {b"mit", b"license", b"x"}) == (4, {b"mit": 1, b"license": 2})
