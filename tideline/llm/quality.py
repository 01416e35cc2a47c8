"""Quality classification: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector w for all grades and increasing thresholds. x hashes the
text: log-scaled counts of byte 2- to 4-grams at unit length, and the bins of a few shape statistics (share of distinct
words, of words that repeat the one before, of capitals, of signs, of separators, mean word length). Expected grade and tail probability follow.

Defined results: a null or blank text has the lowest grade and tail probability 0 and is rejected. Without ratings, or with
ratings of one grade, nothing is known: every text that isn't blank gets tail probability 1 and is kept. Equal texts have equal
scores. Texts of any length are read whole; repeated rows each get their result; rows without an id are scored as all others but
never learned from; ratings that are null or of unknown documents count for nothing. An empty table gives no rows. Other columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded, held_out, ngram_counts, sampled, unused

BITS, BINS, STATS = 13, 16, 6
SIZE = (1 << BITS) + BINS * STATS
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;'\"-")
_CAPITALS = bytes(range(65, 91))


def features(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass")
    out = np.zeros(SIZE, np.float32)
    counts = np.log1p(ngram_counts(data, BITS))
    out[: 1 << BITS] = counts / max(1e-9, np.sqrt(counts @ counts))
    words = text.split()
    n = max(1, len(words))
    stats = (
        len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        (len(data) - len(data.translate(None, _CAPITALS))) / len(data) * 4,
        (len(data) - len(data.translate(None, _SIGNS))) / len(data) * 4,
        (data.count(b"|") + data.count(b"\t")) / n,
        min(1.0, len(text) / n / 24),
    )
    for i, s in enumerate(stats):
        out[(1 << BITS) + i * BINS + min(BINS - 1, int(s * BINS))] = 0.5
    return out


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, text: str) -> np.ndarray:
        """P(grade > grades[k]) for every k but the last."""
        return 1 / (1 + np.exp(self.thresholds - features(text) @ self.weights))

    def predict(self, text: str | None) -> tuple[float, float]:
        """Expected grade, and the probability of the highest grade."""
        if text is None or not text.strip():
            return float(self.grades[0]) if self.grades else 0.0, 0.0
        if len(self.grades) < 2:
            return float(self.grades[0]) if self.grades else 0.0, 1.0
        over = self.above(text)
        return float(self.grades[0] + np.diff(self.grades) @ over), float(over[-1])


def fit(texts: list[str], grades: list[int], weights: list[float] | None = None, *, epochs: int = 12, rate: float = 2.0, l2: float = 1e-5, batch: int = 64, seed: int = 3) -> Model:
    """Maximum likelihood by stochastic gradient descent (Adagrad); thresholds stay in order as their gaps are exponentials.
    weights: for how many rows each one stands; the thresholds follow the weighted shares of the grades."""
    known = sorted({int(g) for g in grades})
    if len(known) < 2:
        return Model(known, np.zeros(SIZE), np.zeros(0))
    x = np.stack([features(t) if t else np.zeros(SIZE, np.float32) for t in texts])
    y, k = np.array([known.index(int(g)) for g in grades]), len(known)
    v = np.ones(len(y)) if weights is None else np.array(weights) / np.mean(weights)
    share = np.cumsum(np.bincount(y, v, minlength=k))[:-1] / len(y)
    cuts = np.log(share / (1 - share))
    first, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 1e-3))
    w, sums, rng = np.zeros(SIZE), np.full(SIZE + k - 1, 1e-6), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            cuts = np.cumsum(np.concatenate([[first], np.exp(gaps)]))
            below = 1 / (1 + np.exp(np.clip((x[rows] @ w)[:, None] - cuts, -40, 40)))  # P(grade <= k)
            full = np.hstack([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))])
            slope = np.hstack([np.zeros((len(rows), 1)), below * (1 - below), np.zeros((len(rows), 1))])
            i = np.arange(len(rows))
            p = np.maximum(full[i, y[rows] + 1] - full[i, y[rows]], 1e-9)
            up, low = v[rows] * slope[i, y[rows] + 1] / p, v[rows] * slope[i, y[rows]] / p
            by_cut = np.zeros((len(rows), k - 1))
            for j in range(k - 1):
                by_cut[:, j] = np.where(y[rows] == j, up, 0) - np.where(y[rows] == j + 1, low, 0)
            gw = x[rows].T @ (up - low) / len(rows) + l2 * w
            gc = -by_cut.mean(0)
            tail = np.cumsum(gc[::-1])[::-1]
            g = np.concatenate([gw, [tail[0]], tail[1:] * np.exp(gaps)])
            sums += g * g
            move = g / np.sqrt(sums) * rate * 0.1
            w -= move[:SIZE]
            first -= move[SIZE]
            gaps -= move[SIZE + 1 :]
    return Model(known, w, np.cumsum(np.concatenate([[first], np.exp(gaps)])))


def train(docs: DataFrame, ratings: DataFrame, *, grade: str = "quality", text: str = "text", per_grade: int = 1500) -> Model:
    """Learns from rated documents that aren't held out, `per_grade` of each grade at most, each weighted by the rows it
    stands for, as `keep_at` is a cut of probabilities under the true shares. As the chosen ids are bounded by that, they are
    broadcast, and the texts aren't shuffled; `bounded` limits what comes to the driver where ids repeat or texts are long."""
    rated = ratings.filter(F.col(grade).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(grade).cast("int").alias("grade"))
    chosen = F.broadcast(sampled(rated, "grade", per_grade, ["doc_id"], weight="weight"))
    got = bounded(docs.select("doc_id", F.col(text).alias("t")).join(chosen, "doc_id").filter(F.col("t").isNotNull()), "grade", "t", per_grade).collect()
    got.sort(key=lambda r: (r["doc_id"], r["grade"], r["t"]))
    return fit([r["t"] for r in got], [r["grade"] for r in got], [r["weight"] for r in got])


ADDED = ("expected_grade", "tail_prob", "rejected")


def score(docs: DataFrame, model: Model, *, text: str = "text", keep_at: float = 0.5, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """Adds expected_grade, tail_prob and rejected (tail_prob under `keep_at`), or the names given, to every row, over
    whole texts. Existing columns of these names are replaced."""
    docs = docs.drop(*added)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found = [m.predict(x.as_py()) for x in b.column(text)]
            cols = [*b.columns, pa.array([g for g, _ in found], pa.float64()), pa.array([p for _, p in found], pa.float64()), pa.array([p < keep_at for _, p in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *added])

    kinds = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *map(T.StructField, added, kinds)]))


def op6(spark: SparkSession, docs: DataFrame, ratings: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), train(docs, ratings)).select("doc_id", "expected_grade", "tail_prob", "rejected")


def keep_good(spark: SparkSession, docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Drops the documents that are rejected."""
    own = tuple(unused(docs, "quality_grade", "quality_tail", "quality_rejected"))
    return score(docs, train(docs, ratings), added=own).filter(~F.col(own[2])).drop(*own)
