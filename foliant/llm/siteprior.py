"""Quality by hierarchical empirical Bayes.

A logistic regression on the form of a text, fitted to a bounded sample of labelled rows, gives each document
its evidence: the log likelihood ratio of good against bad. Sums of its probabilities by site and by path of a
site (grouped aggregation with partial sums, so a hot site is as good as any) give the priors: a site's rate is
shrunk toward the global one, a path's toward its site's, each by a strength that the spread between
groups tells (moments). A document's own part is left out of its prior. The posterior adds the evidence
to the log odds of the path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from foliant.llm.common import Words, byte_table, checkpointed, column, dealt_join, hot_keys, map_texts, utf8
from foliant.llm.sample import chosen

SAMPLE, RIDGE = 4000, 1e-3
#: Bounds of the strength of a prior, in documents, and of a rate.
STRENGTH, EDGE = (1.0, 1e4), 1e-3
KEPT = 0.5
TOKENS = byte_table(lambda b: b != 32 and not 9 <= b <= 13 and b > 0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant
    base: float  # log odds of good in the sample


def form(texts: pa.Array) -> np.ndarray:
    """What a text looks like: a row of numbers for each."""
    raw, ends = utf8(texts)
    w = Words(texts, TOKENS)
    n, size = w.n_texts, np.maximum(np.diff(ends), 1).astype(float)
    words = np.maximum(w.counts(), 1).astype(float)
    of_byte = np.repeat(np.arange(n), np.diff(ends))

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of_byte[mask], minlength=n) / size

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(w.of[mask], minlength=n) / words

    letter = (raw >= 128) | ((raw | 32) >= 97) & ((raw | 32) <= 122)
    letters = np.concatenate(([0], np.cumsum(letter)))
    length, good = w.end - w.start, letters[w.end] - letters[w.start]
    distinct = np.unique(np.stack((w.of.astype(np.uint64), w.hash)), axis=1)[0] if len(w.hash) else np.zeros(0)
    lines = Words(texts, byte_table(lambda b: b not in (0, 10, 13)))
    n_lines = np.maximum(lines.counts(), 1).astype(float)
    kinds = np.unique(np.stack((lines.of.astype(np.uint64), lines.hash)), axis=1)[0] if len(lines.hash) else np.zeros(0)
    return np.stack(
        (
            np.log(words), np.log(size / words), share(letter), share((raw >= 48) & (raw <= 57)), share((raw >= 65) & (raw <= 90)),
            of_words(good == 0), of_words(length - good >= 2), of_words(good == length), of_words(length >= 20),
            np.bincount(distinct.astype(np.int64), minlength=n) / words, np.bincount(kinds.astype(np.int64), minlength=n) / n_lines, np.log(n_lines), np.log(words / n_lines),
        ),
        axis=1,
    )


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> Model:
    """Logistic regression by Newton steps."""
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-9)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rate = (y.sum() + 1) / (len(y) + 2)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(steps if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, z.T @ (y - p) / len(y) - ridge * w), -5, 5)
    base = float(np.log(rate / (1 - rate)))
    if not 0 < y.sum() < len(y):
        w[-1] = base
    return Model(mean, scale, w, base)


def evidence(docs: DataFrame, model: Model, text: str, carry: tuple[str, ...]) -> DataFrame:
    """Columns carry of every row and llr, the log likelihood ratio of good against bad."""
    sent = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights, model.base))

    def make():
        mean, scale, weights, base = sent.value
        return lambda texts: [np.clip(((form(texts) - mean) / scale) @ weights[:-1] + weights[-1] - base, -20, 20)]

    return map_texts(docs, [text], carry, [StructField("llr", DoubleType())], make, slice_bytes=1 << 20)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, parent: str) -> float:
    """How many documents a parent's rate is worth to its groups (n, good): from the spread of their rates beyond chance."""
    r = groups.filter("n > 1").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(parent), 2)).alias("spread"),
        F.sum(F.col(parent) * (1 - F.col(parent))).alias("chance"), F.sum((F.col("n") - 1) * F.col(parent) * (1 - F.col(parent))).alias("more"),
    ).first()
    if not r or not r.more or r.spread is None or r.spread <= r.chance:
        return STRENGTH[1]
    return float(min(STRENGTH[1], max(STRENGTH[0], r.more / (r.spread - r.chance) - 1)))


def quality(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE, label: str = "quality") -> DataFrame:
    """doc_id, quality (posterior of good), site_prior, path_prior and keep (quality >= KEPT) of every row.

    Null is a site and a path of its own; a null text is empty; without labels the evidence is 0 and all
    is kept that the prior keeps. Very long texts are read whole. Repeated rows stay, and count as often; rows that are alike have equal
    results. An empty table gives an empty result. Only key, text, site and path are read, so other columns may have any name.
    """
    few = chosen(docs, labels, label, sample, text, key)
    x, y = np.zeros((0, 13)), []
    if few is not None:
        got = map_texts(few, ["t"], ["k", "y"], [StructField("x", ArrayType(DoubleType()))], lambda: lambda t: [list(form(t))], slice_bytes=1 << 20).orderBy("k").toArrow()
        x, y = np.array(got.column("x").to_pylist(), float).reshape(-1, 13), got.column("y").to_pylist()
    model = fit(x, np.array(y, float))
    own = docs.select(column(key).alias("doc_id"), column(text).alias("_text"), column(site).cast("string").alias("s"), column(path).cast("string").alias("p"))
    own = own.select("doc_id", "_text", *(F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(c, F.lit(""))).alias(c) for c in "sp"))
    seen = checkpointed(evidence(own, model, "_text", ("doc_id", "s", "p")).withColumn("good", 1 / (1 + F.exp(-(F.col("llr") + model.base)))))
    paths = seen.groupBy("s", "p").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    sites = paths.groupBy("s").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = sites.agg(F.sum("n"), F.sum("good")).first()
    rate = total[1] / total[0] if total[0] else 0.5
    k_site = strength(sites.withColumn("rate", F.lit(rate)), "rate")
    sites = sites.select("s", F.col("n").alias("site_n"), F.col("good").alias("site_good")).withColumn("rate", (F.col("site_good") + k_site * rate) / (F.col("site_n") + k_site))
    paths = paths.join(sites, "s")
    k_path = strength(paths, "rate")
    # the rows of a hot path are dealt to several tasks
    at = F.struct("s", "p").alias("at")
    hot = hot_keys(paths.select(at, F.col("n").alias("m")), "at", total[0] or 0)
    given = paths.select(at, F.col("n").alias("path_n"), F.col("good").alias("path_good"), "site_n", "site_good")
    rows = dealt_join(seen.select("doc_id", "llr", "good", at, F.xxhash64("doc_id", "llr").alias("h")), given, "at", hot, "h")
    site_prior = (F.col("site_good") - F.col("good") + k_site * rate) / (F.col("site_n") - 1 + k_site)
    path_prior = (F.col("path_good") - F.col("good") + k_path * F.col("site_prior")) / (F.col("path_n") - 1 + k_path)
    rows = rows.withColumn("site_prior", site_prior).withColumn("path_prior", path_prior)
    posterior = 1 / (1 + F.exp(-(F.col("llr") + _logit(F.col("path_prior")))))
    return rows.select("doc_id", posterior.alias("quality"), "site_prior", "path_prior", (posterior >= KEPT).alias("keep"))
