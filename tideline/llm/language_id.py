"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A document is the average of the embeddings of its hashed byte 2-, 3- and 4-grams (ASCII letters lowered; ASCII digits,
punctuation and controls as spaces). As averaging and the softmax layer are linear before the softmax, the two matrices are
multiplied once after training, so that a document costs one count of buckets and one small product.

Defined results: a text that is null or has no letter (Unicode class L; numerals are none) is ``und`` with score 0 and is
rejected. With nothing to learn from, every text is ``und``. Of languages with equal scores the first by name is given. Texts of any
length are read whole. Repeated rows each get their result; rows without a language or an id are classified as all others, and the
former are never learned from. An empty table gives no rows. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded, held_out, ngram_counts, sampled, unused

UND = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass
class Model:
    langs: list[str]
    bits: int
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        counts = features(text, self.bits)
        return (counts @ self.table) / max(1.0, counts.sum()) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return UND, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def features(text: str, bits: int) -> np.ndarray:
    return ngram_counts(b" " + text.encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", bits)


def fit(texts: list[str], langs: list[str], *, bits: int = 14, dim: int = 16, epochs: int = 8, rate: float = 0.3, batch: int = 64, reject_share: float = 0.001, seed: int = 5) -> Model:
    """Trains on whole texts and on one random window of each (so that short texts are known too). A seventh of the
    texts fixes the temperature and the rejection threshold: the score which all but `reject_share` of them reach."""
    names = sorted(set(langs))
    if not names:
        return Model([], bits, np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng, code = np.random.default_rng(seed), {x: i for i, x in enumerate(names)}
    rows: list[tuple[np.ndarray, np.ndarray, int, bool]] = []

    def add(text: str, y: int, check: bool) -> None:
        counts = features(text, bits)
        ids = np.flatnonzero(counts)
        rows.append((ids, (counts[ids] / counts.sum()).astype(np.float32), y, check))

    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        if not text or not _LETTER.search(text):
            continue
        check, words = i % 7 == 3 and len(texts) >= 70, text.split()
        add(text, code[lang], check)
        if not check and len(words) > 8:
            width = int(rng.integers(2, 30))
            start = int(rng.integers(0, max(1, len(words) - width)))
            add(" ".join(words[start : start + width]), code[lang], False)
    learn, k = [r for r in rows if not r[3]], len(names)
    embed = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (dim, k)).astype(np.float32), np.zeros(k, np.float32)
    steps, step = max(1, epochs * -(-len(learn) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(learn))
        for at in range(0, len(order), batch):
            part = [learn[i] for i in order[at : at + batch]]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = np.stack([v @ embed[ids] for ids, v, _, _ in part])
            z = hidden @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [y for _, _, y, _ in part]] -= 1
            back = p @ soft.T
            soft -= lr * hidden.T @ p / len(part)
            for (ids, v, _, _), g in zip(part, back, strict=True):  # a step of one length for long and short texts
                embed[ids] -= (lr * v / (v @ v))[:, None] * g
    model = Model(names, bits, (embed @ soft).astype(np.float32), bias, 1.0, 0.0)
    kept = [r for r in rows if r[3]] or learn
    if not kept:
        return model
    z = np.stack([v @ model.table[ids] + bias for ids, v, _, _ in kept]).astype(np.float64)
    y = np.array([r[2] for r in kept])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    s = np.exp(z / model.temperature - (z / model.temperature).max(1, keepdims=True))
    model.threshold = float(min(0.5, np.quantile((s / s.sum(1, keepdims=True)).max(1), reject_share)))
    return model


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 700) -> Model:
    """Learns from text and lang of rows that aren't held out: `per_language` documents of each language at most, chosen by a
    hash of id and text, and no more rows, bytes and length of one text than `sampled` and `bounded` allow, bounds that hold
    whatever the size of the table. Only these come to the driver."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    got = bounded(sampled(known, "l", per_language, ["i", "t"]), "l", "t", per_language).collect()
    got.sort(key=lambda r: (str(r["i"]), r["l"], r["t"]))
    return fit([r["t"] for r in got], [r["l"] for r in got])


ADDED = ("lang_pred", "score", "rejected")


def classify(docs: DataFrame, model: Model, *, text: str = "text", added: tuple[str, str, str] = ADDED) -> DataFrame:
    """Adds lang_pred, score and rejected (or the names given) to every row, over the whole text. Existing columns of
    these names are replaced."""
    spark, docs = docs.sparkSession, docs.drop(*added)
    sent = spark.sparkContext.broadcast(model)  # its size is fixed by the number of buckets and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found = [m.predict(x.as_py()) for x in b.column(text)]
            cols = [*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x == UND or s < m.threshold for x, s in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *added])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *map(T.StructField, added, kinds)]))


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = classify(docs.select("doc_id", "text"), train(docs)).withColumn("held_out", held_out(F.col("doc_id")))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_known(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Drops the documents whose language is rejected."""
    own = tuple(unused(docs, "lang_pred", "lang_score", "lang_rejected"))
    return classify(docs, train(docs), added=own).filter(~F.col(own[2])).drop(*own)
