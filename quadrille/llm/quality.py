"""Operator 4: document quality by regularised quadratic discriminant analysis of text statistics."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import remainder

STATISTICS = ("word_length", "upper", "symbols", "digits", "distinct", "adjacent", "top", "zip", "line", "tail", "short")
_KIND = np.zeros(256, dtype=np.uint8)  # 0 letter or other byte, 1 upper case, 2 digit, 3 symbol, 4 white space, 5 plain stop
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
_KIND[[46, 44, 39, 45]] = 5
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def statistics(text: str | None) -> list[float]:
    """Logarithms of ratios over a whole text, so that none is far from normal.

    Each ratio is smoothed by pseudo-observations at an ordinary rate, about twenty words of them, so that a text of
    a few words looks ordinary rather than extreme.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=6) if raw else np.zeros(6)
    letters = kinds[0] + kinds[1]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    tail = sum(1 for w in words if _KIND[w[-1]] == 3)
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(raw[i : i + (1 << 20)])) for i in range(0, size, 1 << 20)) + len(packer.flush())
    ratio = lambda a, b, rate, k: float(np.log((a + rate * k) / (b + k)))
    return [
        ratio(letters, n, 5.0, 20), ratio(kinds[1], letters, 0.03, 100), ratio(kinds[3], size, 0.005, 120),
        ratio(kinds[2], size, 0.005, 120), ratio(len(counts), n, 0.8, 20), ratio(adjacent, n, 0.01, 20),
        ratio(max(counts.values(), default=0), n, 0.08, 20), ratio(packed, size, 0.5, 120),
        ratio(n, raw.count(b"\n") + 1, 60.0, 1), ratio(tail, n, 0.02, 20), ratio(sum(1 for w in words if len(w) <= 3), n, 0.3, 20),
    ]


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunken covariances, and log terms that do not depend on x."""

    mean: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray
    share: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1: difference of Mahalanobis log densities and priors."""
        if not len(self.mean):
            return np.full(len(x), np.log((self.share + 1e-9) / (1 - self.share + 1e-9)))
        d = [self.constant[c] - 0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return d[1] - d[0]


def discriminant(n: list[float], sums: list[np.ndarray], products: list[np.ndarray], shrink: float = 0.05) -> Discriminant:
    """From counts, sums and sums of outer products by class; covariances shrink towards the pooled diagonal."""
    share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    if min(n) < 2:
        return Discriminant(np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), share)
    mean = np.stack([sums[c] / n[c] for c in (0, 1)])
    cov = [products[c] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = np.diag(np.diag((n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1]))) + 1e-3 * np.eye(len(mean[0]))
    inverse, constant = [], []
    for c in (0, 1):
        weight = (shrink * 1000 + 1) / (n[c] + 1000) + shrink  # more shrinkage for small classes
        low = np.linalg.cholesky((1 - min(1, weight)) * cov[c] + min(1, weight) * pooled)
        inverse.append(np.linalg.inv(low))
        constant.append(np.log(n[c] / (n[0] + n[1])) - np.log(np.diag(low)).sum())
    return Discriminant(mean, np.stack(inverse), np.array(constant), share)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, fold: int | None = 1, folds: int = 3,
        label: str = "quality") -> Discriminant:
    """Discriminant of ``labels[label]`` (0 or 1), learnt from about ``max_rows`` labelled rows at most.

    The rows are those whose hashed id falls under a rate that the number of labels gives.  Rows whose
    crc32(doc_id as text) mod ``folds`` is ``fold`` are never learnt from (None: all may be).  Null labels, and labels
    without a document, are ignored; a document with several labels counts with each.  The sample is bounded, so it
    is broadcast; class sums and sums of products are aggregated in Spark.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("__y"))
    if fold is not None:
        known = known.filter(remainder("doc_id", folds) != fold)
    rate = min(1.0, max_rows / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    @F.pandas_udf("array<double>")
    def of(text: pd.Series) -> pd.Series:
        return text.map(statistics)

    k = len(STATISTICS)
    x = [F.col("x")[i] for i in range(k)]
    sums = rows.select("__y", of("text").alias("x")).groupBy("__y").agg(
        F.count("*").alias("n"), F.array(*[F.sum(a) for a in x]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(k) for j in range(k)]).alias("p")).collect()  # two rows
    got = {r["__y"]: r for r in sums}
    n = [float(got[c]["n"]) if c in got else 0.0 for c in (0, 1)]
    s = [np.array(got[c]["s"]) if c in got else np.zeros(k) for c in (0, 1)]
    p = [np.array(got[c]["p"]).reshape(k, k) if c in got else np.zeros((k, k)) for c in (0, 1)]
    return discriminant(n, s, p)


def score(model: Discriminant, text: Column) -> Column:
    """Probability of label 1 for whole texts; a null text scores as the empty text does."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        z = np.clip(model.log_odds(np.array([statistics(t) for t in texts])), -700, 700)
        return pd.Series(1 / (1 + np.exp(-z)))

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, fold: int | None = 1, folds: int = 3) -> DataFrame:
    """``docs`` with new columns held_out, score and predicted; only the text decides the score.

    No labels at all, or a class of fewer than two: every score is the share of label 1, 0.5 without labels.  Null
    ids are not held out.  Repeated rows score alike; an empty table gives an empty result.  Further columns stay; the new ones replace
    columns of their names.
    """
    model = fit(docs, labels, max_rows, fold, folds)
    held = F.coalesce(remainder("doc_id", folds) == (folds if fold is None else fold), F.lit(False))
    return (docs.withColumns({"held_out": held, "score": score(model, F.col("text"))})
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
