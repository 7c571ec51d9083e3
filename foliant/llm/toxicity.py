"""Toxicity by cumulative-link ordinal regression.

P(grade >= j) = logistic(w . x - theta_j) with one weight vector for all thresholds theta_1 <= theta_2 <= ...;
x says which words a text has, by 64-bit hashes. Labels say only whether a text is toxic; toxic texts are
graded by how many distinct marker words they have, markers being words far more frequent in toxic
texts. The fit is proximal gradient with an L1 penalty on a bounded sample of labelled rows,
so few words have a weight, and they are all that is sent to the executors; their weights are then fitted
again without the penalty, which would draw them to 0. Near copies within the sample count once, since the
words of one copied text say nothing of others. Every whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField

from foliant.llm.common import Words, map_texts, mixed, places
from foliant.llm.sample import chosen

SAMPLE, FEATURES = 8000, 1000
GRADES, PENALTY, STEPS = 3, 3e-4, 400
#: Least P(grade >= 1) of a text that is called toxic.
TOXIC = 0.3
#: Chi-square of a word and the label, and texts that have the word, from which it may be a feature.
FEATURE_CHI, LEAST_DF = 25.0, 8
#: Minimum hashes of a text, and how many two copies share.
HASHES, SHARED = 16, 8


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # rising


def word_sets(texts: pa.Array) -> list[np.ndarray]:
    """Of each text the hashes of its distinct words, rising."""
    w = Words(texts)
    ends = np.cumsum(w.counts())
    return [np.unique(w.hash[a:b]) for a, b in zip(np.concatenate(([0], ends)).tolist(), ends.tolist(), strict=False)]


def distinct(words: list[np.ndarray]) -> list[int]:
    """Places of the texts (by their words) that share fewer than SHARED of HASHES minimum hashes with each one before."""
    seen: dict[tuple[int, int], list[int]] = {}
    keep = []
    for i, h in enumerate(words):
        least = [int(mixed(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)).min()) if len(h) else 0 for k in range(HASHES)]
        shared: dict[int, int] = {}
        for key in enumerate(least):
            for j in seen.get(key, ()):
                shared[j] = shared.get(j, 0) + 1
        if max(shared.values(), default=0) < SHARED:
            keep.append(i)
            for key in enumerate(least):
                seen.setdefault(key, []).append(i)
    return keep


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tails(eta: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= j) for each j."""
    return _logistic(eta[:, None] - thresholds[None, :])


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int = GRADES, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds that minimise the mean negative log likelihood and penalty * |w|."""
    n, d = x.shape
    w = np.zeros(d)
    theta = np.array([np.log((np.sum(y < j) + 1) / (np.sum(y >= j) + 1)) for j in range(1, grades + 1)])
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(grades))
    look, t, rate = w.copy(), 1.0, 4.0 / max(1.0, float((x**2).sum(1).max(initial=1.0)))
    for _ in range(steps):
        eta = x @ look
        s = np.concatenate((np.ones((n, 1)), tails(eta, theta), np.zeros((n, 1))), axis=1)
        p = np.maximum(s[np.arange(n), y] - s[np.arange(n), y + 1], 1e-12)
        slope = s * (1 - s)
        up, down = slope[np.arange(n), y] / p, slope[np.arange(n), y + 1] / p
        g = x.T @ (down - up) / n  # of the loss by w
        new = look - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / after * (new - w), new, after
        g_theta = np.array([(np.where(y == j, up, 0) - np.where(y + 1 == j, down, 0)).sum() / n for j in range(1, grades + 1)])
        theta = np.maximum.accumulate(theta - np.clip(g_theta, -1, 1))
    return w, theta


def train(texts: list[str], labels: list[int], features: int = FEATURES) -> Model:
    return learn([h for i in range(0, len(texts), 256) for h in word_sets(pa.array(texts[i : i + 256], pa.string()))], labels, features)


def learn(words: list[np.ndarray], labels: list[int], features: int = FEATURES) -> Model:
    """From the word sets of texts with 0 or 1. With one class only there are no weights and the thresholds say how rare the other is."""
    own = distinct(words)
    n = len(own)
    of = np.repeat(np.arange(n), [len(words[i]) for i in own]) if n else np.zeros(0, np.int64)
    h = np.concatenate([words[i] for i in own]) if n else np.zeros(0, np.uint64)
    y = np.array([labels[i] for i in own], np.int64) > 0
    if not n or not y.any() or y.all():
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 40.0 if not y.any() else -40.0))
    known, at = np.unique(h, return_inverse=True)
    df, pos = np.bincount(at), np.bincount(at, y[of])
    n1 = int(y.sum())
    want = df * n1 / n
    chi = (pos - want) ** 2 / np.maximum(want * (1 - n1 / n) * (1 - df / n), 1e-9)
    chosen = np.flatnonzero((chi >= FEATURE_CHI) & (df >= LEAST_DF) & (pos > want))
    chosen = np.sort(chosen[np.argsort(-chi[chosen], kind="stable")[:features]])
    place = np.full(len(known), -1)
    place[chosen] = np.arange(len(chosen))
    have = place[at] >= 0
    x = np.zeros((n, len(chosen)))
    x[of[have], place[at[have]]] = 1
    first, _ = fit_ordinal(x, y.astype(np.int64), 1)
    markers = x[:, first > 0].sum(1).astype(np.int64)  # words that a fit to the labels alone needs
    grade = np.where(y, np.clip(markers, 1, GRADES), 0)
    w, _ = fit_ordinal(x, grade)
    keep = np.flatnonzero(w)
    w, theta = fit_ordinal(x[:, keep], grade, penalty=0.0)
    return Model(known[chosen[keep]], w, theta)


def score(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns carry of every row, toxicity (P(grade >= 1)), severity (the expected grade), grade (the likeliest) and toxic.

    A null or empty text has no words, so the grade that thresholds alone give; very long ones are read whole. Of equally likely
    grades the lowest is taken. Repeated rows stay, and equal texts have equal scores; an empty table gives an empty result;
    an input column named as a new one gives way to it, and others are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.thresholds))

    def make():
        words, weights, thresholds = sent.value

        def work(texts: pa.Array):
            w = Words(texts)
            at = places(words, w.hash)
            hit = np.flatnonzero(at >= 0)
            pair = np.unique(w.of[hit] * max(1, len(words)) + at[hit])
            eta = np.bincount(pair // max(1, len(words)), weights[pair % max(1, len(words))] if len(words) else None, w.n_texts).astype(float)
            s = tails(eta, thresholds)
            mass = np.concatenate((np.ones((len(s), 1)), s), 1) - np.concatenate((s, np.zeros((len(s), 1))), 1)
            return s[:, 0], s.sum(1), mass.argmax(1), s[:, 0] >= TOXIC

        return work

    return map_texts(docs, [text], carry, [StructField("toxicity", DoubleType()), StructField("severity", DoubleType()), StructField("grade", IntegerType()), StructField("toxic", BooleanType())], make)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from at most sample labelled rows, of which the driver sees hashes of their distinct words, and scores all of docs. Without labels nothing is toxic."""
    few = chosen(docs, labels, "toxic", sample)
    if few is None:
        return score(docs, learn([], []))
    make = lambda: lambda t: [[h.view(np.int64) for h in word_sets(t)]]
    got = map_texts(few, ["t"], ["k", "y"], [StructField("h", ArrayType(LongType()))], make).orderBy("k").toArrow()
    return score(docs, learn([np.array(x, np.int64).view(np.uint64) for x in got.column("h").to_pylist()], got.column("y").to_pylist()))
