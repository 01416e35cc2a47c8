"""Alignment of two tokenizers' tokens over the same text, by anchors at white space.

Each text is tokenised whole by both. Where a token of either that begins with a space starts at the same byte, all tokens before
it end there in both: such verified ends are anchors, which cut a document into windows of token ids. A window's alignment
depends on its ids alone, so it is worked out once a worker and then looked up by the two id tuples, as long as
windows of these ids keep coming. Within a window the bytes at which a token of both ends cut it into groups; a link is a pair of one
token of each side in one group. Counts of id pairs over the corpus (in how many documents a pair is linked) are Spark aggregates.

Tokenising goes through a memory, too: a single space between two characters that aren't white space always begins a token of
both (the first splits its text there before merging; no token of the second has a space behind another character, which is checked
when it is loaded), so that the text between two such spaces is encoded alike wherever it stands.

Skew: a pair that nearly every document holds would be one key's rows. The pairs in most documents, `MOST_PAIRS` at most, are broadcast;
the rest, each in few documents, are joined by a shuffle. The best count by id has a row an id of the first tokenizer (65,536 at most).

Defined results: texts that are null or empty, or which one of the tokenizers doesn't give back byte for byte (a text with U+2581,
say), have no tokens: zeros and ''. Strings of special tokens in a text are plain text. Texts of any length are aligned whole. Rows are told
apart by their place, so repeated rows and ids each get their result and each count as a document; null ids pass through. An
empty table gives no rows. Extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch
from .bpe import byte_symbols

MOST_PAIRS = 500_000
LONG_WINDOW = 256  # bytes of ids; longer windows are aligned anew, as they seldom come again
KEPT = 120_000
PART, ROWS = 1 << 21, 1024  # characters and texts worked on at a time
LONG_GROUP = 1024  # links; of a longer group the pairs are counted, not listed
PIECE = 1 << 13  # new words given to a tokenizer at a time
# Fixed value: the pattern by which byte-level tokenizers of this kind split a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")  # white space for Python is so for both tokenizers, too
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ɏ]+(?:\n+[!-~À-ÖØ-öø-ɏ]+)*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_ID, _PAIR = np.dtype("<u2"), np.dtype("<u4")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Kept(dict):
    """Results by key. With KEPT of them, all become the older half, from which those asked for again are taken over."""

    def __init__(self):
        self._older: dict = {}

    def forget(self) -> None:
        self._older = {}
        self.clear()

    def missing(self, keys: Iterable) -> list:
        """The keys without a result. The others' results stay until the next call."""
        if len(self) >= KEPT:
            self._older = dict(self)
            self.clear()
        older = self._older
        new = [k for k in keys if k not in self]
        if older and new:
            self.update([(k, older[k]) for k in new if k in older])
            new = [k for k in new if k not in older]
        return new


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_path), SentencePieceProcessor(model_file=piece_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation(), self.a.no_padding()
        byte = {c: i for i, c in enumerate(byte_symbols())}
        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        entries = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece has a space behind another character: words can't be encoded one by one")
        pieces = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(n)) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.bytes_a, self.bytes_b = [entries.get(i, b"") for i in range(max(entries) + 1)], pieces
        if "ByteLevel" != spec["pre_tokenizer"]["type"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("a byte-level tokenizer with the usual pattern is needed")
        added = {t["id"] for t in spec["added_tokens"]}
        self._fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.bytes_a) if t and i not in added}, special_tokens={})
        if max(len(self.bytes_a), len(pieces)) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.len_a, self.len_b = (np.array([len(t) for t in v]) for v in (self.bytes_a, pieces))
        self.mark_a, self.mark_b = (np.array([t[:1] == b" " for t in v]) for v in (self.bytes_a, pieces))
        self.sizes = self.len_a.tolist(), self.len_b.tolist()
        self.digits = np.array([list(str(i).ljust(5, "\0").encode()) for i in range(1 << 16)], np.uint8)
        self.words, self.windows = Kept(), Kept()

    # tokens

    def _learn(self, words: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Of each word the ids of both as bytes, None where the tokens don't give it back. New words are encoded together, joined by
        spaces, and told apart by the bytes that their tokens cover; those with white space at an end, one by one. Words of
        Latin letters, ASCII and line ends, about whose classes all tables agree, go through the faster of two libraries."""
        memo = self.words
        new = memo.missing(words)
        plain, rest, odd = [], [], []
        for w in new:
            (plain if _PLAIN.fullmatch(w) else odd if w != w.strip() or not w or "▁" in w else rest).append(w)
        for some, encode in ((plain, self._fast.encode_ordinary), (rest, self._encode_a)):
            for at in range(0, len(some), PIECE):
                if not self._together(some[at : at + PIECE], encode):
                    odd += some[at : at + PIECE]
        for w in odd:
            a, b, whole = self._encode_a(f" {w}"), self.b.encode(w), f" {w}".encode()
            same = b"".join([self.bytes_a[i] for i in a]) == whole == b"".join([self.bytes_b[i] for i in b])
            memo[w] = (np.array(a, _ID).tobytes(), np.array(b, _ID).tobytes()) if same else None
        return memo

    def _encode_a(self, text: str) -> list[int]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _together(self, words: list[str], encode: Callable[[str], list[int]]) -> bool:
        """Learns words that neither begin nor end with white space; False where their tokens don't give back the text."""
        text = " ".join(words)
        a, b, joined = encode(f" {text}"), self.b.encode(text), f" {text}".encode()
        if b"".join([self.bytes_a[i] for i in a]) != joined or b"".join([self.bytes_b[i] for i in b]) != joined:
            return False
        a, b = np.array(a, _ID), np.array(b, _ID)
        ends = np.cumsum(list(map(len, words))) + np.arange(1, len(words) + 1) if text.isascii() else np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = [(2 * np.searchsorted(np.cumsum(lens[ids]), ends) + 2).tolist() for lens, ids in ((self.len_a, a), (self.len_b, b))]
        a, b = a.tobytes(), b.tobytes()
        self.words.update(zip(words, [(a[i:x], b[j:y]) for (i, x), (j, y) in zip(pairwise([0, *cuts[0]]), pairwise([0, *cuts[1]]), strict=True)], strict=True))
        return True

    def tokens(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Of each text the ids of both tokenizers, two bytes an id; none where there are no tokens."""
        split = [_CUT.split(t) if t else [] for t in texts]
        known, out = self._learn(set().union(*split)), []
        for words in split:
            got = [known[w] for w in words]
            a, b = zip(*got, strict=True) if got and None not in got else ((), ())
            out.append((b"".join(a), b"".join(b)))
        return out

    # windows

    def cut(self, a: bytes, b: bytes) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
        """The windows of texts whose ids stand one after the other (each begins with a space, so with an anchor), and at which
        token of the first tokenizer each begins."""
        if not a:
            return [], np.empty(0, np.int64)
        x, y = np.frombuffer(a, _ID), np.frombuffer(b, _ID)
        ends_x, ends_y = np.cumsum(self.len_a[x]), np.cumsum(self.len_b[y])
        at_x, at_y = np.flatnonzero(self.mark_a[x]), np.flatnonzero(self.mark_b[y])
        from_x, from_y = ends_x[at_x] - self.len_a[x[at_x]], ends_y[at_y] - self.len_b[y[at_y]]
        here = np.zeros(int(ends_x[-1]) + 1, np.uint8)
        here[from_x] = 1
        here[from_y] |= 2
        first = at_x[here[from_x] == 3]
        i, j = (2 * first).tolist(), (2 * at_y[here[from_y] == 3]).tolist()
        i.append(len(a)), j.append(len(b))
        return list(zip([a[p:q] for p, q in pairwise(i)], [b[p:q] for p, q in pairwise(j)], strict=True)), first

    def groups(self, a: list[int], b: list[int]) -> Iterator[tuple[list[int], list[int]]]:
        """The ids of each group: the shortest runs of tokens which end at the same byte in both."""
        len_a, len_b = self.sizes
        j = to_b = to_a = i0 = j0 = 0
        n = len(b)
        for i, x in enumerate(a, 1):
            to_a += len_a[x]
            while to_b < to_a and j < n:
                to_b += len_b[b[j]]
                j += 1
            if to_a == to_b:
                yield a[i0:i], b[j0:j]
                i0, j0 = i, j

    def _align_long(self, window: tuple[bytes, bytes]) -> tuple[bytes, int, int, bytes, bytes | None]:
        """What `_align` gives, for a window with a group of many links, whose pairs are counted instead of listed."""
        said, pairs, links = [], Counter(), 0
        for x, y in self.groups(*(np.frombuffer(ids, _ID).tolist() for ids in window)):
            said.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
            links += len(x) * len(y)
            right = Counter(y).items()
            for u, m in Counter(x).items():
                for v, k in right:
                    pairs[u << 16 | v] += m * k
        return ";".join(said).encode(), len(said), links, np.array(list(pairs), _PAIR).tobytes(), np.array(list(pairs.values()), np.int64).tobytes()

    def _align(self, windows: list[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, int, int, bytes, bytes | None]]:
        """Of each window its groups as text, their number, the number of links, the id pairs (the first id in the high half) and how often
        each (None: once each; a pair may come again). All windows are aligned together, one after the other."""
        a, b = (np.frombuffer(b"".join([w[k] for w in windows]), _ID).astype(np.int64) for k in (0, 1))
        at_a, at_b = (np.cumsum([0, *[len(w[k]) // 2 for w in windows]]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        here = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        here[ends_a] = 1
        here[ends_b] |= 2
        last_a, last_b = here[ends_a] == 3, here[ends_b] == 3  # the tokens that end a group
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # the group of each token
        to_a, to_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        groups = np.concatenate([[0], np.cumsum(last_a)])[at_a]  # before each window
        long = np.zeros(len(windows), bool)
        n = n_a * n_b
        if (n > LONG_GROUP).any():
            long[np.searchsorted(groups, np.flatnonzero(n > LONG_GROUP), "right") - 1] = True
            n = np.where(np.repeat(long, np.diff(groups)), 0, n)
        links = np.concatenate([[0], np.cumsum(n)])
        own = np.repeat(np.arange(len(n)), n)
        i, j = np.divmod(np.arange(links[-1]) - links[own], n_b[own])
        pairs = (a[(to_a - n_a)[own] + i] << 16 | b[(to_b - n_b)[own] + j]).astype(_PAIR).tobytes()
        # tokens in the order of the text: those of a group's first side, then those of its second
        ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        spot_a, spot_b = np.arange(len(a)) + (to_b - n_b)[of_a], np.arange(len(b)) + to_a[of_b]
        ids[spot_a], ids[spot_b] = a, b
        sign[spot_a[last_a]], sign[spot_b[last_b]] = ord("|"), ord(";")
        signs = np.column_stack([self.digits[ids], sign])
        said = signs[signs > 0].tobytes()
        ends = np.concatenate([[0], np.cumsum((signs > 0).sum(1))])[at_a + at_b].tolist()
        links, groups = links[groups].tolist(), groups.tolist()
        for k, w in enumerate(windows):
            if long[k]:
                yield self._align_long(w)
            else:
                yield said[ends[k] : ends[k + 1] - 1], groups[k + 1] - groups[k], links[k + 1] - links[k], pairs[4 * links[k] : 4 * links[k + 1]], None

    def aligned(self, windows: dict[tuple[bytes, bytes], int]) -> list[tuple]:
        """The alignments of different windows, looked up by their id tuples where they are known."""
        memo = self.windows
        new = memo.missing(windows)
        if new:
            memo.update(zip(new, self._align(new), strict=True))
        out = [memo[w] for w in windows]
        for w in [w for w in new if len(w[0]) + len(w[1]) > LONG_WINDOW]:
            del memo[w]
        return out

    def digests(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text n_a, n_b, n_groups, n_links and groups_sha256; of all of them the id pairs (text by text, ascending), how often
        each is linked, and at which pair each text begins (the end last). A word that comes again has the same tokens and
        windows, so windows are cut once for each different word of these texts."""
        split, n = [_CUT.split(t) if t else [] for t in texts], len(texts)
        different = set().union(*split)
        known = self._learn(different)
        place = {w: k for k, w in enumerate(different)}
        ids = [known[w] or (b"", b"") for w in different]
        ids_a, ids_b = [i[0] for i in ids], [i[1] for i in ids]
        a, b = (np.fromiter(map(len, i), np.int64, len(i)) // 2 for i in (ids_a, ids_b))
        windows, first = self.cut(b"".join(ids_a), b"".join(ids_b))
        number: dict[tuple[bytes, bytes], int] = {}
        own = np.array([number.setdefault(w, len(number)) for w in windows], np.int64)
        found = self.aligned(number)
        starts = np.searchsorted(first, np.cumsum([0, *a]))  # at which window each word begins
        # the texts as numbers of words; those with a word that isn't given back have none
        words, text_of = np.array([place[w] for ws in split for w in ws], np.int64), np.repeat(np.arange(n), [len(ws) for ws in split])
        lost = np.zeros(n, bool)
        lost[text_of[a[words] == 0]] = True
        words, text_of = words[~lost[text_of]], text_of[~lost[text_of]]
        total = lambda of, values: np.bincount(of, values, n).astype(np.int64)
        n_a, n_b = total(text_of, a[words]), total(text_of, b[words])
        own, text_of = own[_spread(starts[:-1][words], np.diff(starts)[words])], np.repeat(text_of, np.diff(starts)[words])
        said, cuts, each = [f[0] for f in found], np.searchsorted(text_of, np.arange(n + 1)).tolist(), own.tolist()
        sha = [hashlib.sha256(b";".join([said[k] for k in each[p:q]])).hexdigest() if p < q else "" for p, q in pairwise(cuts)]
        groups, links = (total(text_of, np.array([f[k] for f in found], np.int64)[own]) for k in (1, 2))
        # the different windows of each text and how often each comes, then their pairs
        both, often = np.unique(text_of * max(1, len(found)) + own, return_counts=True)
        text_of, own = np.divmod(both, max(1, len(found)))
        listed = [f[3] for f in found]
        pairs, sizes = np.frombuffer(b"".join(listed), _PAIR).astype(np.int64), np.fromiter(map(len, listed), np.int64, len(found)) // 4
        times = np.ones(len(pairs), np.int64)
        for k in [k for k, f in enumerate(found) if f[4]]:
            times[sizes[:k].sum() :][: sizes[k]] = np.frombuffer(found[k][4], np.int64)
        at, size = _spread((np.cumsum(sizes) - sizes)[own], sizes[own]), sizes[own]
        keys, times = np.repeat(text_of, size) << 32 | pairs[at], times[at] * np.repeat(often, size)
        order = keys.argsort()
        keys = keys[order]
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, times = keys[begin], np.add.reduceat(times[order], begin) if len(begin) else times
        return [n_a, n_b, groups, links], sha, keys & 0xFFFFFFFF, times, np.searchsorted(keys, np.arange(n + 1) << 32)

    def released(self, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
        """The batches in slices of few texts (PART characters and one text more at most), with their texts; after the last, the
        worker no longer holds what it met."""
        gc.disable()  # nothing here refers to itself, and the words remembered are many
        try:
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    some = b.slice(at, ROWS)
                    texts, i = some.column(column).to_pylist(), 0
                    while i < len(texts):
                        chars, end = 0, i
                        while end < len(texts) and (end == i or chars + len(texts[end] or "") < PART):
                            chars += len(texts[end] or "")
                            end += 1
                        yield some.slice(i, end - i), texts[i:end]
                        i = end
        finally:
            self.words.forget()
            self.windows.forget()
            gc.enable()


_loaded: dict[tuple[str, str], Aligner] = {}


def load(byte_path: str, piece_path: str) -> Aligner:
    key = byte_path, piece_path
    if key not in _loaded:
        _loaded[key] = Aligner(*key)
    return _loaded[key]


def align(docs: DataFrame, byte_path: str, piece_path: str, *, text: str = "text", groups: str = "groups") -> DataFrame:
    """Adds to every row the groups of its text: array of (a, b: the ids of both; start, end: bytes of space + text which they cover).
    A column of that name is replaced."""
    docs = docs.drop(groups)
    at_text = docs.columns.index(text)
    ids = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("a", ids), ("b", ids), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = load(byte_path, piece_path)
        for batch, texts in al.released(batches, at_text):
            out = []
            for a, b in al.tokens(texts):
                own, at = [], 0
                for x, y in al.groups(np.frombuffer(a, _ID).tolist(), np.frombuffer(b, _ID).tolist()):
                    end = at + sum(len(al.bytes_a[i]) for i in x)
                    own.append({"a": x, "b": y, "start": at, "end": end})
                    at = end
                out.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, groups])

    group = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in "ab"] + [T.StructField(n, T.LongType()) for n in ("start", "end")])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(groups, T.ArrayType(group))]))


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def summaries(docs: DataFrame, byte_path: str, piece_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links and groups_sha256 of every row, its linked id pairs (distinct, as first id * 65536 + second) and
    how often each is linked: what `align` gives, digested where it arises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = load(byte_path, piece_path)
        for batch, texts in al.released(batches, 1):
            counts, sha, pairs, times, at = al.digests(texts)
            lists = [pa.ListArray.from_arrays(at.astype(np.int32), v) for v in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(sha, pa.string()), *lists], names=["doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    longs = T.ArrayType(T.LongType())
    kinds = [chosen.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", longs), T.StructField("times", longs)]
    return chosen.mapInArrow(run, T.StructType(kinds))


def counted(docs: DataFrame, byte_path: str, piece_path: str, *, doc_id: str = "doc_id", text: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, the counts of `summaries`, n_best (links whose pair is in as many documents as any pair of its first id), count_sum (over
    links, in how many documents the pair is) and groups_sha256. The pairs in most documents, `most_pairs` at most, are broadcast."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.cut(summaries(docs, byte_path, piece_path, doc_id=doc_id, text=text).withColumn("row", F.monotonically_increasing_id()))
    counts = scratch.cut(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    first = F.shiftright("pair", 16)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    counts = counts.withColumn("a", first).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    # the least power of two which few enough pairs reach
    by_power, least, few = counts.groupBy(F.floor(F.log2("n")).alias("p")).count().orderBy(F.desc("p")).collect(), None, 0
    for r in by_power:  # 64 rows at most
        few += r["count"]
        if few > most_pairs:
            break
        least = 2 ** r["p"]
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    sums = F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")
    found, rest = [], sum(r["count"] for r in by_power)
    if least is not None:
        common = F.broadcast(counts.filter(F.col("n") >= least))
        found.append(links.join(common, "pair").groupBy("row").agg(*sums))
        rest -= few if few <= most_pairs else few - r["count"]
    if rest:
        rare = counts if least is None else counts.filter(F.col("n") < least)
        left = links if least is None else links.join(F.broadcast(counts.filter(F.col("n") >= least).select("pair")), "pair", "left_anti")
        found.append(left.join(rare, "pair").groupBy("row").agg(*sums))
    out = rows.select("row", "doc_id", *COUNTS, "groups_sha256")
    for k, f in enumerate(found):
        out = out.join(f.select("row", *(F.col(c).alias(f"{c}_{k}") for c in ("n_best", "count_sum"))), "row", "left")
    total = {c: sum((F.coalesce(F.col(f"{c}_{k}"), F.lit(0)) for k in range(len(found))), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")}
    return out.select("doc_id", *COUNTS, total["n_best"], total["count_sum"], "groups_sha256")


def op13(spark: SparkSession, docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    return counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), byte_path, piece_path)
