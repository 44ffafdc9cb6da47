"""Operator 2: toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import checkpointed, remainder

TOKEN = re.compile(r"[^\W_]+", re.UNICODE)
#: A word's features: itself and, behind a mark, its beginnings of these lengths, for inflected and made-up forms.
BEGINNINGS = (4, 5)
#: Features are hashed to so many columns.
COLUMNS = 1 << 20
#: Times that a word must raise the odds of a toxic text, two standard errors off, to count for its grade.
TELLING = 4
#: Words whose weighted columns a worker remembers at most.
CACHE_WORDS = 300_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def columns_of(word: str) -> list[int]:
    names = [word] + ["^" + word[:n] for n in BEGINNINGS if len(word) > n]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % COLUMNS for n in names]


def counted(text: str | None) -> Counter[int]:
    """Occurrences of each column in a whole text."""
    out: Counter[int] = Counter()
    for w, n in Counter(tokens(text)).items():
        for c in columns_of(w):
            out[c] += n
    return out


@dataclass
class Ordinal:
    """Weights that all thresholds share, of the columns that have one, and thresholds in rising order."""

    weights: dict[int, float]
    cuts: np.ndarray
    words: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def over(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j: logistic of the margin less the threshold."""
        p = 1 / (1 + np.exp(-np.clip(margin[:, None] - self.cuts[None, :], -500, 500)))
        return np.where(np.isinf(self.cuts), self.cuts < 0, p)

    def margin(self, text: str | None) -> float:
        """Sum over the columns of weight * log2(1 + occurrences)."""
        found: dict[int, int] = {}
        for w, n in Counter(tokens(text)).items():
            has = self.words.get(w)
            if has is None:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                has = self.words[w] = tuple(c for c in columns_of(w) if c in self.weights)
            for c in has:
                found[c] = found.get(c, 0) + n
        return float(sum(self.weights[c] * np.log2(1 + n) for c, n in sorted(found.items())))


@dataclass
class Sparse:
    """A matrix as rows, columns and values of what is not zero."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def _blocks(self) -> Iterator[slice]:
        """The values in parts, so that products take little memory beside them."""
        return (slice(at, at + (1 << 20)) for at in range(0, len(self.row), 1 << 20))

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        for s in self._blocks():
            row = self.row[s]
            low, high = row[0], row[-1] + 1  # rows come in order
            out[low:high] += np.bincount(row - low, weights=self.value[s] * w[self.col[s]], minlength=high - low)
        return out

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1])
        for s in self._blocks():
            out += np.bincount(self.col[s], weights=self.value[s] * r[self.row[s]], minlength=self.shape[1])
        return out

    def rows_by_column(self, rows: np.ndarray) -> np.ndarray:
        """How many of the marked rows have each column."""
        return sum((np.bincount(self.col[s], weights=rows[self.row[s]], minlength=self.shape[1]) for s in self._blocks()), np.zeros(self.shape[1]))

    def of_columns(self, columns: np.ndarray) -> Sparse:
        place = np.full(self.shape[1], -1, dtype=np.int32)
        place[columns] = np.arange(len(columns))
        at = np.concatenate([np.flatnonzero(place[self.col[s]] >= 0) + s.start for s in self._blocks()] + [np.zeros(0, dtype=np.int64)])
        return Sparse(self.row[at], place[self.col[at]], self.value[at], (self.shape[0], len(columns)))


def _loss(margin: np.ndarray, cut: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of grades, and its slopes by each row's margin and by the cut's parameters.

    ``cut`` has the first threshold and logarithms of the steps to the next ones, so that their order always holds.
    """
    n, k = len(y), len(cut)
    steps = np.exp(cut[1:])
    cuts = cut[0] + np.concatenate(([0.0], np.cumsum(steps)))
    p = 1 / (1 + np.exp(-np.clip(margin[:, None] - cuts[None, :], -500, 500)))
    at = np.arange(n)
    full = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
    mass = np.maximum(full[at, y] - full[at, y + 1], 1e-12)
    slope = np.concatenate((np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))), axis=1)
    hi, lo = slope[at, y] / mass, slope[at, y + 1] / mass
    by_cut = (np.bincount(y, weights=hi, minlength=k + 2) - np.bincount(y + 1, weights=lo, minlength=k + 2))[1:-1] / n
    by_step = np.cumsum(by_cut[::-1])[::-1]
    return float(-np.log(mass).mean()), -(hi - lo) / n, np.concatenate((by_step[:1], by_step[1:] * steps))


def fit_ordinal(x: Sparse, y: np.ndarray, grades: int, lasso: float = 0.0, ridge: float = 1e-4, steps: int = 120,
                tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link (proportional odds) model over all columns, penalised by both norms.

    Accelerated proximal steps on the columns that may have a weight: those whose slope exceeds ``lasso``.  After each
    solution all columns are looked at again, and those that now exceed it come in, until none does; so no column is left out that the penalty does not set to zero.
    """
    n, k = x.shape
    above = np.array([(y > j).mean() for j in range(grades - 1)])
    start = np.sort(-np.log((above * n + 0.5) / (n - above * n + 0.5)))
    cut = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    weights, active = np.zeros(k), np.zeros(0, dtype=np.int64)
    for _ in range(50):
        _, slope, _ = _loss(x.times(weights), cut, y)
        wanted = np.abs(x.transposed_times(slope) + ridge * weights) > lasso * (1 + tolerance) + tolerance * 1e-2
        wanted[active] = False
        if not wanted.any():
            break
        active = np.sort(np.concatenate((active, np.flatnonzero(wanted))))
        own = x.of_columns(active)
        theta, cut = _solve(own, y, weights[active], cut, lasso, ridge, steps)
        weights[:] = 0
        weights[active] = theta
    if not len(active):
        _, cut = _solve(x.of_columns(active), y, np.zeros(0), cut, lasso, ridge, steps)
    return weights, cut[0] + np.concatenate(([0.0], np.cumsum(np.exp(cut[1:]))))


def _solve(x: Sparse, y: np.ndarray, w: np.ndarray, cut: np.ndarray, lasso: float, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient with momentum, restarted where it overshoots; the step length adapts.  Without lasso, BFGS."""
    k, rate = len(w), 1.0
    now = np.concatenate((w, cut))

    smooth = lambda t: _smooth(x, y, t, ridge)
    if not lasso:
        now = _descend(smooth, now)
        return now[:k], now[k:]
    ahead, momentum, best = now, 1.0, np.inf
    for _ in range(steps):
        f, g = smooth(ahead)
        while True:
            new = ahead - rate * g
            new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * lasso, 0)
            d = new - ahead
            at = smooth(new)[0]
            if at <= f + g @ d + (d @ d) / (2 * rate) + 1e-12 or rate < 1e-8:
                break
            rate /= 2
        value = at + lasso * np.abs(new[:k]).sum()
        if value > best:  # overshot: again from here, without momentum
            ahead, momentum = now, 1.0
            best = np.inf
            continue
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / faster * (new - now)
        if np.isfinite(best) and best - value < 1e-10 and np.abs(new - now).max(initial=0) < 1e-6:
            now = new
            break
        now, momentum, best, rate = new, faster, value, rate * 1.2
    return now[:k], now[k:]


def _smooth(x: Sparse, y: np.ndarray, t: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Loss with the ridge, and its slope, of weights and cut parameters in one vector."""
    k = x.shape[1]
    loss, by_row, by_cut = _loss(x.times(t[:k]) if k else np.zeros(len(y)), t[k:], y)
    by_w = x.transposed_times(by_row) + ridge * t[:k] if k else np.zeros(0)
    return loss + 0.5 * ridge * float(t[:k] @ t[:k]), np.concatenate((by_w, by_cut))


def _descend(smooth, t: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Least point by BFGS with halved steps."""
    f, g = smooth(t)
    inverse = np.eye(len(t)) / max(1e-12, np.abs(g).max(initial=0))
    for _ in range(rounds):
        step = -inverse @ g
        if g @ step >= 0:
            step, inverse = -g, np.eye(len(t))
        rate = 1.0
        while (got := smooth(t + rate * step))[0] > f + 1e-4 * rate * (g @ step) and rate > 1e-10:
            rate /= 2
        d, e = rate * step, got[1] - g
        if rate <= 1e-10 or f - got[0] < 1e-10 and np.abs(got[1]).max(initial=0) < 1e-7:
            return t + d if got[0] <= f else t
        t, (f, g) = t + d, got
        if d @ e > 1e-16:
            r = 1 / (d @ e)
            left = inverse @ e
            inverse += (1 + r * (e @ left)) * r * np.outer(d, d) - r * (np.outer(left, d) + np.outer(d, left))
    return t


def _mark(text: str | None) -> int:
    """The least hash of a text's five-word shingles, which near copies mostly share and other texts do not."""
    w = tokens(text)
    return min((zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 4))), default=0)


def telling(x: Sparse, toxic: np.ndarray, clean: np.ndarray) -> set[int]:
    """Columns that by themselves, each in a two by two table of texts, raise the odds of a toxic text ``TELLING`` times."""
    bad, good = x.rows_by_column(toxic) + 0.5, x.rows_by_column(clean) + 0.5
    odds = np.log(bad / (toxic.sum() + 1 - bad)) - np.log(good / (clean.sum() + 1 - good))
    return set(np.flatnonzero(odds - 2 * np.sqrt(1 / bad + 1 / good) > np.log(TELLING)).tolist())


def _model(x: Sparse, y: np.ndarray, grades: int, lasso: float, ridge: float) -> Ordinal:
    if not (y > 0).any() or (y > 0).all():
        return Ordinal({}, np.full(grades - 1, np.inf if not (y > 0).any() else -np.inf))
    chosen = np.flatnonzero(fit_ordinal(x, y, grades, lasso / np.sqrt(len(y)))[0])
    # the first penalty says which columns count, and shrinks them; what they weigh is learnt without it
    w, cuts = fit_ordinal(x.of_columns(chosen), y, grades, ridge=ridge)
    return Ordinal({int(c): float(v) for c, v in zip(chosen, w)}, cuts)


def fit(docs: DataFrame, labels: DataFrame, grades: int = 4, max_rows: int = 20_000, fold: int | None = 1, folds: int = 3,
        label: str = "toxic", lasso: float = 0.2, ridge: float = 1e-5) -> Ordinal:
    """Learnt from about ``max_rows`` labelled rows at most, never from the rows of the held-out fold.

    Features are all words and beginnings of words, hashed; none is chosen beforehand, the penalty sets weights to zero.
    ``labels[label]`` is 0 or a grade.  Where it is only 0 and 1, the grades of toxic rows are measured by rows that
    have not seen them: the rows are halved by hash, each half says which words are toxic by themselves (:func:`telling`),
    and a toxic row's grade is the number of its words, from 1 to ``grades`` - 1, of which the other half says so.
    Clean rows are grade 0.  Near copies in the sample count once.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.greatest(F.lit(0), F.least(F.lit(grades - 1), F.col(label))).cast("int").alias("__y"))
    if fold is not None:
        known = known.filter(remainder("doc_id", folds) != fold)
    rate = min(1.0, max_rows / max(1, known.count()))
    sample = checkpointed(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20))))
    small = sample.count() <= 4 * max_rows  # else one id has very many labels
    rows = docs.select("doc_id", "text").join(F.broadcast(sample) if small else sample, "doc_id").select("text", "__y")

    @F.pandas_udf("long")
    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(_mark).astype("int64")

    # copies of one text are one witness: else every word of a much copied toxic text would look toxic
    rows = checkpointed(rows.withColumn("mark", mark("text")).dropDuplicates(["mark", "__y"]))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [counted(t.as_py()) for t in batch.column(0)]
            cols = [np.fromiter(c.keys(), dtype=np.int32, count=len(c)).tobytes() for c in got]
            values = [np.log2(1 + np.fromiter(c.values(), dtype=np.float32, count=len(c))).astype(np.float32).tobytes() for c in got]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(cols, pa.binary()), pa.array(values, pa.binary())],
                                             names=["mark", "y", "c", "v"])

    held = rows.select("text", "__y", "mark").mapInArrow(sparse, "mark long, y int, c binary, v binary")
    got = held.toPandas().sort_values(["mark", "y"], ignore_index=True)  # at most max_rows rows of numbers, in one order
    y, half = got["y"].to_numpy(dtype=int), got["mark"].to_numpy(dtype=int) % 2
    size = got["c"].map(len).to_numpy(dtype=int) // 4
    x = Sparse(np.repeat(np.arange(len(got), dtype=np.int32), size), np.frombuffer(b"".join(got["c"]), dtype=np.int32),
               np.frombuffer(b"".join(got["v"]), dtype=np.float32), (len(got), COLUMNS))
    got = got[["mark"]]
    if y.max(initial=0) <= 1 and grades > 2 and len(y):
        halves = [telling(x, (half == h) & (y > 0), (half == h) & (y == 0)) for h in (0, 1)]

        @F.pandas_udf("int")
        def measured(texts: pd.Series, marks: pd.Series) -> pd.Series:
            return pd.Series([sum(not halves[1 - m % 2].isdisjoint(columns_of(w)) for w in tokens(t)) for t, m in zip(texts, marks)], dtype="int32")

        counts = rows.filter("__y > 0").select("mark", measured("text", "mark").alias("n")).toPandas()
        n = got[["mark"]].merge(counts, on="mark", how="left")["n"].to_numpy(dtype=float)
        y = np.where(y > 0, np.clip(np.nan_to_num(n), 1, grades - 1).astype(int), 0)
    return _model(x, y, grades, lasso, ridge)


def score(model: Ordinal, text: Column) -> Column:
    """Struct of severity (expected grade) and score (probability of any grade over 0) for whole texts."""

    @F.pandas_udf("severity double, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        over = model.over(np.array([model.margin(t) for t in texts], dtype=float).reshape(-1))
        return pd.DataFrame({"severity": over.sum(axis=1), "score": over[:, 0]})

    return of(text)


def severity(docs: DataFrame, labels: DataFrame, grades: int = 4, max_rows: int = 20_000, fold: int | None = 1, folds: int = 3) -> DataFrame:
    """``docs`` with new columns held_out, severity (0 to ``grades`` - 1), score (0 to 1) and predicted (score >= 0.5).

    Null and empty texts have no features: their severity is what the thresholds alone give.  Without labels, or
    without toxic ones, every severity is 0.  Null ids are not held out.  An empty table gives an empty result.  Further columns stay; the new ones replace
    columns of their names.
    """
    model = fit(docs, labels, grades, max_rows, fold=fold, folds=folds)
    held = F.coalesce(remainder("doc_id", folds) == (folds if fold is None else fold), F.lit(False))
    return (docs.withColumn("__s", score(model, F.col("text")))
            .withColumns({"held_out": held, "severity": F.col("__s.severity"), "score": F.col("__s.score"),
                          "predicted": (F.col("__s.score") >= 0.5).cast("int")}).drop("__s"))
