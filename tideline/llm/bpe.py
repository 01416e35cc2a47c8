"""BPE encoding and decoding with a contiguous rank array.

A word's parts are kept in a contiguous array beside an array with the rank of each adjacent pair. The smallest rank is
looked for by a scan, the boundary there is deleted, and the ranks on both sides are refreshed; numpy does this for many
words at once, a row each. Words over `LONG` bytes take the same merges from a heap, as repeated scans would cost the square
of their length. Words are merged once per worker and then looked up, as long as they keep coming.

The vocabulary is a file of the tokenizers library for BPE with word ends (byte-level symbols, a suffix on the last symbol,
text in NFC and lower case with white space dropped). Its path is a parameter; every worker reads it once.

Letters, cases and canonical forms are Python's; words with characters that its tables don't know yet go through the
library's own normaliser and pre-tokeniser, whose tables are newer.

Defined results: null counts as the empty text, with no tokens. Strings of special tokens inside a text become those tokens,
as in the library. White space splits words whatever their number or length; texts are encoded whole. Of equal ranks the first in the
word is merged first. Repeated rows each get their result; null ids pass through; an empty table gives no rows; extra columns pass through
`encode` (but for those of the names added) and don't matter to `digests`.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, KEEP = 96, 60_000
PART = 1 << 19  # characters encoded at a time
ROWS = 256  # texts taken out of a batch at a time
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(46)
_MARKS = frozenset(".,!?;:|")
BITS = 20  # of an id
MASK, NONE = (1 << BITS) - 1, 1 << 62
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = regex.compile(f"[{SPACE}]+")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it is printable Latin-1, else the next unused one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        self.ids = dict(model["vocab"])
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # by the pair's ids: its rank, and in the low bits the id of what it becomes
        self.ranks = {self.ids[a] << BITS | self.ids[b]: i << BITS | self.ids[a + b] for i, (a, b) in enumerate(merges)}
        symbols = byte_symbols()
        self._start, self._end = np.array([self.ids[c] for c in symbols]), np.array([self.ids[c + end] for c in symbols])
        self._keys, self._values, self._probes = _table(self.ranks)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.ids, **self.special}.items()}
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}"))
        self.words, self.pieces = Memo(), Memo()
        self._library, self._path, self._byte = None, path, {c: i for i, c in enumerate(symbols)}
        self._numbers, self._tokens = {i: f" {i}" for i in self.tokens}, {i: f" {t}" for i, t in self.tokens.items()}

    # merging

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of ids its rank with, in the low bits, the id of what it becomes; NONE where it has none."""
        key = a << BITS | b
        at = (key.astype(np.uint64) * _MIX >> _SHIFT).astype(np.int64)
        out = np.full(len(key), NONE)
        for _ in range(self._probes):
            found = self._keys[at] == key
            out[found] = self._values[at[found]]
            at += 1
        return out

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of the parts of each word."""
        out: list[list[int]] = [[] for _ in words]
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self._merge_long(w)
            elif w:
                by_width.setdefault(-(-len(w) // 4) * 4, []).append(k)
        for width, own in by_width.items():
            self._merge_short(words, own, width, out)
        return out

    def _merge_short(self, words: list[bytes], own: list[int], width: int, out: list[list[int]]) -> None:
        """A row for each word: its parts, and the ranks of adjacent parts. In each round every row finds its least rank (the
        first of equals), deletes that boundary, and refreshes the ranks on both sides; rows without any rank are done."""
        sizes = np.array([len(words[k]) for k in own])
        raw = np.frombuffer(b"".join([words[k].ljust(width, b"\0") for k in own]), np.uint8).reshape(-1, width)
        parts, rows = self._start[raw], np.arange(len(own))
        parts[rows, sizes - 1] = self._end[raw[rows, sizes - 1]]
        parts[np.arange(width) >= sizes[:, None]] = 0
        ranks = np.full((len(own), width), NONE)
        inner = np.arange(width - 1) < sizes[:, None] - 1
        ranks[:, :-1][inner] = self._pair(parts[:, :-1][inner], parts[:, 1:][inner])
        ids = np.array(own)
        while len(ids):
            rows = np.arange(len(ids))
            i = ranks.argmin(1)
            least = ranks[rows, i]
            if (done := least == NONE).any():
                for k, n, p in zip(ids[done].tolist(), sizes[done].tolist(), parts[done].tolist(), strict=True):
                    out[k] = p[:n]
                go = ~done
                ids, sizes, parts, ranks, i, least = ids[go], sizes[go], parts[go], ranks[go], i[go], least[go]
                if not len(ids):
                    break
                rows = np.arange(len(ids))
            at, w = np.arange(parts.shape[1]), parts.shape[1] - 1
            parts[rows, i] = least & MASK
            parts = parts[at != (i + 1)[:, None]].reshape(-1, w)
            ranks = ranks[at != i[:, None]].reshape(-1, w)
            sizes = sizes - 1
            right, left = i < sizes - 1, i > 0
            ranks[rows[right], i[right]] = self._pair(parts[rows[right], i[right]], parts[rows[right], i[right] + 1])
            ranks[rows[left], i[left] - 1] = self._pair(parts[rows[left], i[left] - 1], parts[rows[left], i[left]])

    def _merge_long(self, word: bytes) -> list[int]:
        parts = [*self._start[list(word)].tolist()]
        parts[-1] = int(self._end[word[-1]])
        n, get = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # starts of the next part and of the one before
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << BITS | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, a, left, right = heapq.heappop(heap)
            b = after[a]
            if b < 0 or b >= n or parts[a] != left or parts[b] != right:
                continue
            parts[a], c = r & MASK, after[b]
            after[a], after[b], parts[b] = c, -1, -1
            if c < n:
                before[c] = a
                if (r := get(parts[a] << BITS | parts[c], NONE)) != NONE:
                    heapq.heappush(heap, (r, a, parts[a], parts[c]))
            if (p := before[a]) >= 0 and (r := get(parts[p] << BITS | parts[a], NONE)) != NONE:
                heapq.heappush(heap, (r, p, parts[p], parts[a]))
        out, at = [], 0
        while at < n:
            out.append(parts[at])
            at = after[at]
        return out

    # texts

    def _pieces_of(self, word: str) -> list[str]:
        """The pieces of what lies between two spaces; special tokens stay as they are."""
        head, tail = (word[:-1], word[-1]) if word[-1:] in _MARKS else (word, "")
        if head.isalpha() and (piece := self._normal(head)).isalpha():
            return [piece, tail] if tail else [piece]
        got: list[str] = []
        for part in self._split.split(word) if self._split and "<" in word else (word,):
            if part in self.special:
                got.append(part)
            elif not part.isascii() and any(unicodedata.category(c) == "Cn" for c in part):
                got += self._library_pieces(part)
            else:
                got += self._pieces.findall(self._normal(_SPACES.sub(" ", part)))
        return got

    def _library_pieces(self, part: str) -> list[str]:
        """The pieces as the library makes them, for characters that Python's tables don't have."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        normal = self._library.normalizer.normalize_str(part)
        found = self._library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(self._byte[c] for c in piece).decode("utf-8", "surrogatepass") for piece, _ in found]

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lowers each sigma alone
        return text.lower()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of tokens, the ids joined by spaces, and the text decoded from them."""
        at = 0
        while at < len(texts):  # so many texts at a time that their new words fit in memory
            chars, end = 0, at
            while end < len(texts) and (end == at or chars + len(texts[end] or "") < PART):
                chars += len(texts[end] or "")
                end += 1
            split = [(t or "").replace("\n", " ").split(" ") for t in texts[at:end]]
            known = self._learn(set().union(*split))
            for words in split:
                ids, tokens = zip(*[known[w] for w in words], strict=True)
                joined = "".join(ids)
                yield joined.count(" "), joined[1:], "".join(tokens)[1:]
            at = end

    def _learn(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """A dict that has the ids and the tokens, each behind a space, of all these words."""
        memo, pieces = self.words, self.pieces
        memo.take_over(words)
        pieces_of = {w: self._pieces_of(w) for w in words if w not in memo}
        wanted = {p for ps in pieces_of.values() for p in ps}
        pieces.take_over(wanted)
        new = [p for p in wanted if p not in pieces and p not in self.special]
        number, token = self._numbers, self._tokens
        for p, ids in zip(new, self.merge_many([p.encode("utf-8", "surrogatepass") for p in new]), strict=True):
            pieces[p] = "".join([number[i] for i in ids]), "".join([token[i] for i in ids])
        for w, ps in pieces_of.items():
            if len(ps) == 1 and ps[0] in pieces:
                memo[w] = pieces[ps[0]]
            else:
                got = [pieces[p] if p in pieces else (number[self.special[p]], token[self.special[p]]) for p in ps]
                memo[w] = "".join([i for i, _ in got]), "".join([t for _, t in got])
        return memo

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, which is what the library gives for a file without a decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class Memo(dict):
    """Results by key. When full, all of them become the older half, from which those asked for again are taken over."""

    def __init__(self):
        self._older: dict = {}

    def forget(self) -> None:
        self._older = {}
        self.clear()

    def take_over(self, keys: set) -> None:
        if len(self) >= KEEP:
            self._older = dict(self)
            self.clear()
        older = self._older
        self.update([(k, older[k]) for k in keys if k not in self and k in older])


def _table(ranks: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """An open-addressed table of the pairs for numpy: keys, values, and the most steps that any pair takes."""
    size, most = 1 << 18, 1
    keys, values = np.full(size + 64, -1), np.zeros(size + 64, np.int64)
    home = (np.array(list(ranks), np.uint64) * _MIX >> _SHIFT).astype(np.int64).tolist()
    taken = bytearray(size + 64)
    for at, (k, v) in zip(home, ranks.items(), strict=True):
        slot = taken.index(0, at)
        taken[slot], keys[slot], values[slot], most = 1, k, v, max(most, slot - at + 1)
    return keys, values, most


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def released(bpe: Bpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last, the worker, which other work may use next, no longer holds the words it met."""
    try:
        yield from batches
    finally:
        bpe.words.forget()
        bpe.pieces.forget()


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ROWS rows, so that a task holds the tokens of few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids (array of int) and the text decoded from them to every row; columns of these names are replaced."""
    docs = docs.drop(ids, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in parts(released(bpe, batches)):
            numbers = [[int(i) for i in s.split()] for _, s, _ in bpe.encode(b.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in numbers], pa.string())], names=[*b.schema.names, ids, decoded])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]))


def digests(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: what `encode` gives, digested where it arises, so that
    no ids leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = load(path), hashlib.sha256
        for b in parts(released(bpe, batches)):
            got = [(n, sha(i.encode()).hexdigest(), sha(t.encode("utf-8")).hexdigest()) for n, i, t in bpe.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _, _ in got], pa.int64()), pa.array([i for _, i, _ in got], pa.string()), pa.array([t for _, _, t in got], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = [chosen.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return chosen.mapInArrow(run, T.StructType(kinds))


def op9(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return digests(docs, path)
