"""Toxicity: weak supervision. Many lexicon and pattern voters, a generative label model over their votes, and a linear
classifier trained on the posterior labels.

Lexicon voters are words and word beginnings (4 to 6 letters) that occur almost only in documents labelled toxic, besides a short
list of insults. Candidates come from a bounded sample of the labelled rows that may be learned from; how often each occurs
under either label is then counted over all of those rows, and only what holds there becomes a voter. Pattern voters are regular
expressions. Each votes toxic where it occurs and abstains elsewhere; one voter votes clean where nothing of theirs occurs.
The label model (EM over a binary latent label) estimates how often each voter votes under either label, and discounts
voters by their correlation with the others under the same label. The classifier is a logistic regression on the presence of
tokens.

Bounds of the model, whatever the size of the table: `per_label` sampled rows of each label (within the bytes of `bounded`),
`most` mined voters out of `6 * most` counted candidates, `background` further tokens.

Defined results: null and empty texts score the classifier's intercept (0 without any toxic label, 0.5 without any label). Texts are
read whole, and long and repeated ones score the same as one copy, as only presence counts; repeated rows each get their result;
rows without an id are scored and never learned from; labels that are null or of unknown documents count for nothing, and where labels
of one document differ, both count; equal tokens counts are taken in the order of the tokens; an empty table gives no rows; other columns
pass through untouched (but for one of the name that is added).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded, held_out, sampled

_WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
# A starting lexicon of common insults; what the corpus itself uses is mined.
SEEDS = ("idiot", "moron", "stupid", "worthless", "pathetic", "loser", "scum", "trash", "disgusting", "imbecile", "dumb", "garbage")
PATTERNS = {
    "address": re.compile(r"\b(?:you|he|she|they)(?: are|'re| is|'s) (?:an? |such an? |so |all )?(?:" + "|".join(SEEDS) + r")"),
    "command": re.compile(r"\b(?:shut up|get lost|drop dead|go to hell)\b"),
    "masked": re.compile(r"\b[a-z]\*{2,}[a-z]*\b"),
    "hate": re.compile(r"\b(?:hate|despise) (?:you|him|her|them|those)\b"),
    "pair": re.compile(r"\b(?:" + "|".join(SEEDS) + r")\W+(?:" + "|".join(SEEDS) + r")\b"),
}


def tokens(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n))


def token_set(text: str | None) -> frozenset[str]:
    words = set(_WORD.findall((text or "").lower()))
    return frozenset(t for w in words for t in tokens(w))


@dataclass
class LabelModel:
    """P(vote | label) of each voter, and how much each counts."""

    prior: float
    voted: np.ndarray  # 2 x voters: P(it votes | label)
    discount: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = votes != 0
        one, zero = np.log(self.voted[1]), np.log(self.voted[0])
        z = np.log(self.prior / (1 - self.prior)) + on @ ((one - zero) * self.discount)  # who abstains says nothing
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_labels(votes: np.ndarray, *, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    """votes: rows x voters, 1 toxic, -1 clean, 0 abstains. Needs no labels: it starts from the sum of the votes."""
    m = votes.shape[1]
    q = np.clip(0.5 + 0.45 * np.sign(votes.sum(1)), 0.05, 0.95)
    on, side, model = (votes != 0).astype(float), votes.max(0) > 0, None
    some = on.any(1)  # rows without any vote say nothing about voters, and would only repeat the prior
    # the balance of the labels is that of the votes: left free, it drifts, as who abstains counts for neither
    prior = float(np.clip((votes.sum(1) > 0)[some].mean() if some.any() else 0.5, 0.02, 0.98))
    for _ in range(rounds):
        weight = np.stack([1 - q, q]) * some
        total = weight.sum(1) + 1e-9
        voted = np.clip((weight @ on + 0.05) / (total[:, None] + 1), 1e-4, 1 - 1e-4)
        # a voter is never believed to vote against its own side
        voted[1] = np.where(side, np.maximum(voted[1], voted[0] * 1.01), np.minimum(voted[1], voted[0] / 1.01))
        voted = np.clip(voted, 1e-4, 1 - 1e-4)
        together = np.zeros((m, m))
        for y in (0, 1):
            d = (on - voted[y]) * np.sqrt(weight[y])[:, None]
            cov = d.T @ d / total[y]
            sd = np.sqrt(np.diag(cov)) + 1e-6
            together += cov / np.outer(sd, sd) * total[y] / max(1, some.sum())
        np.fill_diagonal(together, 0)
        discount = np.maximum(0.5, 1 / (1 + np.where(together > 0.3, together, 0).sum(1)))
        model = LabelModel(prior, voted, discount)
        q = model.posterior(votes)
    return model, q


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None, memo: dict[str, tuple[str, ...]]) -> float:
        found: set[str] = set()
        for w in set(_WORD.findall((text or "").lower())):
            got = memo.get(w)
            if got is None:
                if len(memo) >= 200_000:
                    memo.clear()
                got = memo[w] = tuple(t for t in tokens(w) if t in self.weights)
            if got:
                found.update(got)
        z = self.bias + sum(self.weights[t] for t in sorted(found))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


#: tokens -> how many documents of label 0 and 1 have each (2 x tokens), and how many documents each label has
Counts = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def _telling(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of each token (2 x tokens counts) a score if it occurs almost only under label 1, else 0."""
    zero, one = n
    lift = ((one + 0.5) / (total[1] + 1)) / ((zero + 0.5) / (total[0] + 1))
    good = (one >= max(3, round(0.004 * total[1]))) & (lift >= 6) & (one >= 8 * zero)
    return np.where(good, one * np.log(np.maximum(lift, 1.0)), 0.0)


def mine(names: list[str], n: np.ndarray, total: np.ndarray, has: Callable[[list[int]], np.ndarray], counts: Counts | None, *, most: int = 96) -> list[str]:
    """Tokens that occur almost only under label 1, the most telling first, and none whose documents a taken one has
    already (nine in ten of them). n: counts in the sample; counts: those over all rows; has: documents by tokens."""
    whole = np.array([1.0 if t.endswith("~") else 1.1 for t in names])  # a whole word rather than its beginning
    rank = _telling(n, total) * whole
    chosen = sorted(np.flatnonzero(rank > 0).tolist(), key=lambda i: (-rank[i], names[i]))[: 6 * most]
    if counts is not None and chosen:
        rank = _telling(*counts([names[i] for i in chosen])) * whole[chosen]
        order = sorted(np.flatnonzero(rank > 0).tolist(), key=lambda i: (-rank[i], names[chosen[i]]))
        chosen = [chosen[i] for i in order]
    hits = has(chosen).astype(np.float32)
    both, taken = hits.T @ hits, []
    for i in range(len(chosen)):
        if len(taken) < most and all(both[i, j] < 0.9 * both[i, i] for j in taken):
            taken.append(i)
    return [names[chosen[i]] for i in taken]


def fit(texts: list[str], labels: list[int], counts: Counts | None = None, *, l2: float = 0.01, background: int = 64, l2_background: float = 20.0) -> Model:
    """Copies and near copies (equal smallest token hashes) count once, else the words of an often copied text would vote.
    Tokens are numbered, so that a document is an array of numbers."""
    number: dict[str, int] = {}
    sets, ys, shapes, seen = [], [], [], set()
    for text, y in zip(texts, labels, strict=True):
        s = token_set(text)
        sketch = tuple(sorted(xxhash.xxh64_intdigest(t) for t in s)[:4])
        if sketch not in seen:
            seen.add(sketch)
            sets.append(np.sort(np.array([number.setdefault(t, len(number)) for t in sorted(s)], np.int32)))
            ys.append(int(y))
            low = (text or "").lower()
            shapes.append([bool(p.search(low)) for p in PATTERNS.values()])
    y = np.array(ys)
    if not len(y) or len(set(ys)) < 2:
        return Model({}, -40.0 if len(y) and not y.any() else 0.0)
    names = list(number)

    def has(columns: list[int]) -> np.ndarray:
        at = np.full(len(names), -1)
        at[columns] = np.arange(len(columns))
        out = np.zeros((len(sets), len(columns)), bool)
        for row, s in zip(out, sets, strict=True):
            found = at[s]
            row[found[found >= 0]] = True
        return out

    df = lambda rows: np.bincount(np.concatenate([sets[i] for i in rows] or [np.empty(0, np.int32)]), minlength=len(names))
    n = np.stack([df(np.flatnonzero(y == k)) for k in (0, 1)])
    lexicon = list(dict.fromkeys([*mine(names, n, np.bincount(y, minlength=2), has, counts), *(t for t in SEEDS if t in number)]))
    hits, forms = has([number[t] for t in lexicon]).astype(float), np.array(shapes, float)
    none = 1 - np.maximum(hits.max(1, initial=0), forms.max(1))
    votes = np.hstack([hits, forms, -none[:, None]])
    votes = votes[:, np.abs(votes).sum(0) > 0]
    _, q = fit_labels(votes)
    # tokens that go with the posterior, and frequent ones as a background
    every, pos = n.sum(0), df(np.flatnonzero(q > 0.5))
    m, npos = len(sets), float((q > 0.5).sum())
    gain = np.abs(np.log(((pos + 0.5) / (npos + 1)) / ((every - pos + 0.5) / (m - npos + 1)))) * every
    often = sorted(np.flatnonzero(every >= max(10, 0.01 * m)).tolist(), key=lambda i: (-gain[i], names[i]))[:background]
    use = list(dict.fromkeys([*lexicon, *(names[i] for i in often)]))
    held = np.array([l2 if i < len(lexicon) else l2_background for i in range(len(use))])  # penalties
    x = has([number[t] for t in use]).astype(float)
    w, b = np.zeros(len(use)), math.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3))
    full = np.hstack([x, np.ones((m, 1))])
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        r, h = p - q, np.maximum(p * (1 - p), 1e-4)
        hess = full.T @ (full * h[:, None]) + np.diag([*held, 1e-6])
        move = np.linalg.solve(hess, full.T @ r + np.array([*(held * w), 0.0]))
        w, b = w - move[:-1], b - move[-1]
        if np.abs(move).max() < 1e-5:
            break
    return Model({t: float(v) for t, v in zip(use, w, strict=True) if abs(v) > 1e-6}, float(b))


def occurrences(docs: DataFrame, known: DataFrame, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many documents of label 0 and 1 have each of the tokens, over all rows of known (doc_id, label), and the rows of
    each label. The texts aren't shuffled: each becomes the few tokens it has, which then meet its labels."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(wanted)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, memo = sent.value, {}
        for b in batches:
            ids, found = [], []
            for i, text in zip(b.column("doc_id"), b.column("t"), strict=True):
                hits: set[int] = set()
                for w in set(_WORD.findall((text.as_py() or "").lower())):
                    got = memo.get(w)
                    if got is None:
                        if len(memo) >= 200_000:
                            memo.clear()
                        got = memo[w] = tuple(at[t] for t in tokens(w) if t in at)
                    hits.update(got)
                if hits:
                    ids.append(i.as_py())
                    found.append(sorted(hits))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "hits"])

    texts = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "t")
    found = texts.mapInArrow(run, T.StructType([texts.schema["doc_id"], T.StructField("hits", T.ArrayType(T.IntegerType()))]))
    out, total = np.zeros((2, len(wanted))), np.zeros(2)
    for token, label, n in found.join(known, "doc_id").select(F.explode("hits").alias("token"), "label").groupBy("token", "label").count().collect():
        out[label, token] = n
    for label, n in known.groupBy("label").count().collect():
        total[label] = n
    return out, total


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", text: str = "text", per_label: int = 3000) -> Model:
    """Learns from labelled documents that aren't held out, `per_label` of each label at most (see `bounded` for bytes); their ids
    are bounded by that and broadcast, so that texts aren't shuffled. Candidates of the lexicon are counted over all rows."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", (F.col(label).cast("int") > 0).cast("int").alias("label"))
    texts = docs.select("doc_id", F.col(text).alias("t"))
    chosen = F.broadcast(sampled(known, "label", per_label, ["doc_id"]))
    got = bounded(texts.join(chosen, "doc_id").filter(F.col("t").isNotNull()), "label", "t", per_label).collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["t"]))
    return fit([r["t"] for r in got], [r["label"] for r in got], lambda wanted: occurrences(texts, known, wanted))


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "toxicity") -> DataFrame:
    """Adds the score to every row, over the whole text; a column of that name is replaced."""
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = sent.value, {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(x.as_py(), memo) for x in b.column(text)], pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op5(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs.select("doc_id", "text"), train(docs, labels), name="score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
