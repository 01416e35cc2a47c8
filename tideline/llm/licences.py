"""Licence scan by an index of rare words with their positions.

Templates are short notices, each with key phrases that must be there, and base phrases, which are all key. How many documents hold
each of their words is counted over the whole table (one pass, one row a word and task; the templates' words are few), which gives
every word's IDF. The index has each template's words of highest IDF, with their places in the template. A file's words are looked up
in it, so only its rarest licence words are ever followed: a word at p whose posting is at q says that the template starts at p - q.
Postings whose starts agree (within a slack that grows with the template, as words get lost or put in) are added up by IDF; where
they reach SHARE of the indexed words' sum, the words around are read: all key phrases must stand there. Of a base phrase one
word is indexed and all words must stand at their places, so that every place is found, whatever the IDF.

Both passes read a text in blocks of words that overlap by the longest template, so memory is bounded however long the text is, and
nothing is shuffled but the counts.

Defined results: null counts as the empty text, with no words and no places. Places of different phrases may overlap and all count. A
template counts once for every start at which it is first reached. coverage is 1 for a base phrase, else the share, by IDF, of the
template's words that stand in the window. Repeated rows each get their result and each count for the IDF; null ids pass through. An empty table gives no
rows. Extra columns pass through `scan` (but for the one added) and don't matter to the query, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base phrases with their labels.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
# Wordings of public licence notices (label, notice, key phrases), lower case, words only.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms", "conditions are met")),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("extent possible under law", "waived all copyright")),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
RARE, SHARE = 6, 0.5
BLOCK = 1 << 20  # bytes read at a time
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))  # all else is a space


def blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, A-Z lowered, as UTF-8, block by block."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK) if at + BLOCK < len(data) else len(data)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[list[bytes]]
    base: bool

    @property
    def slack(self) -> int:
        return 0 if self.base else 2 + len(self.words) // 8


def templates(phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str, Sequence[str]]] = NOTICES) -> list[Template]:
    split = lambda s: s.encode().split()
    return [Template(label, split(p), [split(p)], True) for label, p in phrases] + [Template(label, split(n), [split(k) for k in keys], False) for label, n, keys in notices]


class Index:
    """The rare words of the templates with their postings. weight: the IDF of every word of a template."""

    def __init__(self, found: Sequence[Template], weight: dict[bytes, float]):
        self.templates, self.weight = list(found), weight
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.reach = max((len(t.words) + 2 * t.slack for t in self.templates), default=0) + 1
        self.sums = []
        for k, t in enumerate(self.templates):
            rare = sorted(set(t.words), key=lambda w: (-weight[w], w))[: 1 if t.base else RARE]
            self.sums.append(sum(weight[w] for w in rare))
            for q, w in enumerate(t.words):
                if w in rare and not (t.base and q != t.words.index(w)):
                    self.postings.setdefault(w, []).append((k, q))

    def places(self, text: str | None) -> tuple[int, list[tuple[str, int, int, bool, float]]]:
        """The number of words, and the places in order: label, first word, number of words, base, coverage."""
        held: list[bytes] = []
        n, left, out = 0, 0, []
        stream = blocks(text)
        block = next(stream, None)
        while block is not None:
            after = next(stream, None)
            offset = n - len(held)
            n += len(block)
            held += block
            right = len(held) if after is None else max(left, len(held) - self.reach)
            out += [(label, offset + s, m, base, c) for label, s, m, base, c in self._in_block(held, left, right)]
            keep = max(0, right - self.reach)  # so many words before the next start stay
            held, left, block = held[keep:], right - keep, after
        return n, sorted(out, key=lambda p: (p[1], p[0], p[2]))

    def _in_block(self, words: list[bytes], left: int, right: int) -> Iterator[tuple[str, int, int, bool, float]]:
        """The places whose start lies in [left, right)."""
        postings, starts = self.postings, {}
        for p, w in enumerate(words):
            if w in postings:
                for k, q in postings[w]:
                    starts.setdefault(k, []).append((p - q, w))
        for k, hits in starts.items():
            t = self.templates[k]
            if t.base:
                m = len(t.words)
                for s, _ in hits:
                    if left <= s < right and words[s : s + m] == t.words:
                        yield t.label, s, m, True, 1.0
            else:
                yield from self._agreeing(t, self.sums[k], words, sorted(hits), left, right)

    def _agreeing(self, t: Template, total: float, words: list[bytes], hits: list[tuple[int, bytes]], left: int, right: int) -> Iterator[tuple[str, int, int, bool, float]]:
        """Runs of postings whose starts differ by the slack at most and whose different words weigh enough. Each run is read once."""
        often, sum_, end, read = Counter(), 0.0, 0, None
        for begin, (start, word) in enumerate(hits):
            while end < len(hits) and hits[end][0] <= start + t.slack:
                w = hits[end][1]
                sum_ += self.weight[w] if not often[w] else 0.0
                often[w] += 1
                end += 1
            if sum_ >= SHARE * total and (read is None or start > read):
                read, at = start + t.slack, max(0, start)
                window = words[max(0, start - t.slack) : start + len(t.words) + 2 * t.slack]
                if left <= at < right and all(_stands(key, window) for key in t.keys):
                    here = Counter(window)
                    whole = Counter(t.words)
                    got = sum(min(m, here[w]) * self.weight[w] for w, m in whole.items())
                    yield t.label, at, len(t.words), False, got / sum(m * self.weight[w] for w, m in whole.items())
            often[word] -= 1
            sum_ -= self.weight[word] if not often[word] else 0.0


def _stands(key: list[bytes], words: list[bytes]) -> bool:
    return b" " + b" ".join(key) + b" " in b" " + b" ".join(words) + b" "


def document_counts(docs: DataFrame, words: set[bytes], *, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of rows, and in how many of them each of these words is: one row a word and task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                own = set()
                for block in blocks(t.as_py()):
                    own |= words.intersection(block)
                counts.update(own)
                counts[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    got = docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in got}
    return counts.pop(b"", 0), counts


def index(docs: DataFrame, found: Sequence[Template] | None = None, *, text: str = "text") -> Index:
    found = templates() if found is None else found
    words = {w for t in found for w in t.words}
    n, counts = document_counts(docs, words, text=text)
    return Index(found, {w: 1.0 + math.log((1 + n) / (1 + counts.get(w, 0))) for w in words})


PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("coverage", T.DoubleType())])


def scan(docs: DataFrame, found: Sequence[Template] | None = None, *, text: str = "text", places: str = "licences") -> DataFrame:
    """Adds to every row its number of words and the places of licences in its text, in order, as one struct; a column of that name is
    replaced."""
    look = index(docs, found, text=text)
    docs = docs.drop(places)
    at = docs.columns.index(text)
    kind = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("base", pa.bool_()), ("coverage", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [look.places(t.as_py()) for t in b.column(at)]
            rows = [{"n_words": n, "places": [dict(zip(("label", "start", "n_words", "base", "coverage"), p, strict=True)) for p in ps]} for n, ps in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=[*b.schema.names, places])

    more = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(PLACE))])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(places, more)]))


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    got = scan(docs.select("doc_id", "text"), places="found").select("doc_id", F.col("found.n_words").alias("n_words"), F.col("found.places").alias("places"))
    base = F.filter("places", lambda p: p["base"])
    labels = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0))
    return got.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), score.alias("score"))
