"""Operator 7: language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import HashIndex, remainder

#: Bytes of the longest contexts, and what stands before a text's first byte: no byte of any text.
DEPTH, START = 5, 0xFF
#: Languages whose trees share one index, so that a position is looked up once for all of them.
GROUP = 8
#: Positions scored at once, which bounds a worker's memory for long texts.
CHUNK = 400_000
_ASCII_LETTER = re.compile("[A-Za-z]")
_GAP = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are coded, of all texts, and where each text's end.

    Before a text stand ``DEPTH`` starts.  A-Z are lower-cased, a run of ASCII bytes that are no letters is one space,
    and a text ends with one.
    """
    raw = np.frombuffer(b"".join([bytes([START]) * DEPTH + t.encode("utf-8", "surrogatepass").lower() + b" " for t in texts]), dtype=np.uint8)
    gap = _GAP[raw]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    ends = np.cumsum(np.fromiter((DEPTH + 1 + len(t.encode("utf-8", "surrogatepass")) for t in texts), dtype=np.int64, count=len(texts)))
    return np.where(gap, np.uint8(32), raw)[keep], np.cumsum(keep)[ends - 1] if len(texts) else ends


def grams(sym: np.ndarray) -> np.ndarray:
    """Each byte from the ``DEPTH``-th on with the ``DEPTH`` before it, eight bits each, the last one lowest."""
    n = max(0, len(sym) - DEPTH)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(DEPTH + 1):
        out = (out << np.uint64(8)) | sym[i : i + n]
    return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 8 * (order + 1)) - 1)


@dataclass
class Tree:
    """One language's contexts: by order 0 to ``DEPTH``, the grams (context and byte) with the bits of the byte where it was seen
    there, and the contexts with the bits of the escape to the context shorter by its first byte.

    Escape method C with full exclusion: in a context seen n times with d distinct successors, one seen c times has
    c / (n + d); the other d / (n + d) goes to the bytes not seen there, as the shorter context shares it out.
    The shortest context has the uniform distribution over 256 bytes under it.
    """

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def tree(key: np.ndarray, count: np.ndarray) -> Tree:
    """From the different grams of the longest contexts, and how often each occurs."""
    out = Tree([], [], [], [])
    shorter, below = np.zeros(0, np.uint64), np.zeros(0)
    for order in range(DEPTH + 1):
        gram, at = np.unique(key & _mask(order), return_inverse=True)
        c = np.bincount(at, weights=count, minlength=len(gram))
        context, of = np.unique(gram >> np.uint64(8), return_inverse=True)
        n, d = np.bincount(of, weights=c, minlength=len(context)), np.bincount(of, minlength=len(context)).astype(float)
        escape = np.where(d < 256, d, 0.0)  # with all bytes seen there is nothing to escape to
        share = c / (n + escape)[of]
        # what the shorter context gives to the bytes seen here, which it has seen too
        lower = np.full(len(gram), 1 / 256) if not order else below[np.searchsorted(shorter, gram & _mask(order - 1))]
        left = 1 - np.bincount(of, weights=lower, minlength=len(context))
        out.grams.append(gram)
        out.bits.append(-np.log2(share))
        out.contexts.append(context)
        out.escapes.append(np.where(d < 256, -np.log2(np.where(d < 256, escape / (n + escape) / np.where(d < 256, left, 1), 1)), 0.0))
        shorter, below = gram, share
    return out


@dataclass
class Level:
    """The grams of one order that any language of a group has: their index, each language's whole bits of the last byte coded
    from that context on, and, for the grams as contexts, of the escape, which is 0 where a language has no such context."""

    index: HashIndex
    bits: np.ndarray
    escapes: np.ndarray


@dataclass
class Trees:
    """The frozen statistics of up to ``GROUP`` languages, merged."""

    levels: list[Level]
    root: np.ndarray  # escape bits of the empty context

    @classmethod
    def merged(cls, trees: list[Tree]) -> Trees:
        root = np.array([t.escapes[0][0] for t in trees])
        levels: list[Level] = []
        before = None
        for order in range(DEPTH + 1):
            # starts alone are contexts, though no byte of a text
            key = np.unique(np.concatenate([t.grams[order] for t in trees] + [np.array([_mask(order)])] * (order < DEPTH)))
            bits = np.empty((len(key), len(trees)))
            escapes = np.zeros((len(key), len(trees)))
            for i, t in enumerate(trees):
                # not seen: the escape of its context, if that is known, and the bits from the shorter context
                low = np.full(len(key), 8.0) if not order else before[0][np.searchsorted(before[1], key & _mask(order - 1)), i]
                context = key >> np.uint64(8)
                low = low + _at(t.contexts[order], t.escapes[order], context, 0.0)
                bits[:, i] = _at(t.grams[order], t.bits[order], key, low)
                if order < DEPTH:
                    escapes[:, i] = _at(t.contexts[order + 1], t.escapes[order + 1], key, 0.0)
            levels.append(Level(HashIndex(key), bits.astype(np.float32), escapes.astype(np.float32)))
            before = bits, key
        return cls(levels, root)

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each position in each language: what is found for the longest known gram, and the escapes down to it."""
        out = np.zeros((len(gram), len(self.root)), dtype=np.float32)
        open_ = np.arange(len(gram))
        for order in range(DEPTH, -1, -1):
            at = self.levels[order].index.find(gram[open_] & _mask(order))
            found = at >= 0
            out[open_[found]] += self.levels[order].bits[at[found]]
            open_ = open_[~found]
            if not len(open_):
                return out
            if order:
                above = self.levels[order - 1]
                at = above.index.find((gram[open_] >> np.uint64(8)) & _mask(order - 1))
                known = at >= 0
                out[open_[known]] += above.escapes[at[known]]
        out[open_] += (self.root + 8.0).astype(np.float32)
        return out


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other) -> np.ndarray:
    """The values of the wanted among sorted keys, ``other`` for those that are none."""
    if not len(keys):
        return np.broadcast_to(other, len(wanted)).astype(float)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


@dataclass
class Ppm:
    """Frozen statistics of all languages, in groups."""

    languages: list[str]
    groups: list[Trees]

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text in each language."""
        sym, ends = coded(texts)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        for at in range(DEPTH, len(sym), CHUNK):
            stop = min(len(sym), at + CHUNK)
            gram = grams(sym[at - DEPTH : stop])
            # texts of this chunk, and their first positions after their starts
            first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, stop, side="left")
            own = np.searchsorted(ends, np.arange(at, stop), side="right") - first
            real = np.arange(at, stop) - starts[first + own] >= DEPTH
            gram, own = gram[real], own[real]
            lo = np.searchsorted(own, np.arange(last - first))
            for g, trees in enumerate(self.groups):
                sums = np.concatenate((np.zeros((1, len(trees.root))), np.cumsum(trees.code_lengths(gram), axis=0, dtype=np.float64)))
                hi = np.concatenate((lo[1:], [len(gram)]))
                total[first:last, GROUP * g : GROUP * g + len(trees.root)] += sums[hi] - sums[lo]
        return total


def fit(docs: DataFrame, max_bytes: int = 3_000_000, total_bytes: int = 60_000_000, fold: int | None = 0, folds: int = 5,
        max_languages: int = 1_000) -> Ppm:
    """Byte context trees of depth ``DEPTH`` for every language, learnt from about ``max_bytes`` bytes of text each.

    The texts are those of non-null lang whose hashed id falls under the language's rate; never those whose
    crc32(doc_id as text) mod ``folds`` is ``fold``.  Over all languages they are about ``total_bytes`` at most, which bounds
    the statistics.  Whole texts are counted, in Spark; every gram of them counts, over all 256 bytes.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if fold is not None:
        known = known.filter(remainder("doc_id", folds) != fold)
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).orderBy("lang").limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Ppm([], [])
    most = min(max_bytes, total_bytes // len(languages))
    rates = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(min(1.0, most / max(1, r["size"])) * (1 << 20)) or 1))])
    place = F.create_map(*[x for i, c in enumerate(languages) for x in (F.lit(c), F.lit(i))])
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rates[F.col("lang")])
    sample = sample.select(place[F.col("lang")].alias("l"), "text")

    def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each: dict[int, list[str]] = {}
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                each.setdefault(l, []).append(t.as_py())
            for l, texts in each.items():
                parts = [grams(coded([t])[0]) for t in texts]
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), l)), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], names=["l", "k", "n"])

    counts = sample.mapInArrow(gram_counts, "l long, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # bounded by total_bytes
    trees = []
    for i in range(len(languages)):
        own = got[got["l"] == i]
        if not len(own):  # no text was drawn: as a text without bytes
            own = pd.DataFrame({"k": grams(coded([""])[0]).astype(np.int64), "n": [1]})
        trees.append(tree(own["k"].to_numpy(np.int64).astype(np.uint64), own["n"].to_numpy(float)))
    return Ppm(languages, [Trees.merged(trees[g : g + GROUP]) for g in range(0, len(trees), GROUP)])


def predict(docs: DataFrame, model: Ppm, text: Column) -> Column:
    """Struct of lang_pred and score for whole texts.

    lang_pred has the shortest code length, ties to the smaller name; ``und`` with score 0 if the text is null or has
    no letter, or nothing was learnt.  score is the posterior of lang_pred under equal priors.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by total_bytes

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        model = held.value
        name, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t is not None and model.languages and has_letter(t)]
        block, size = [], 0
        for x, i in enumerate(at):
            block.append(i)
            size += len(texts.iloc[i])
            if size < CHUNK and x + 1 < len(at):
                continue
            bits = model.code_lengths([texts.iloc[j] for j in block])
            best = np.argmin(bits, axis=1)
            least = bits[np.arange(len(block)), best][:, None]
            name[block] = [model.languages[b] for b in best]
            score[block] = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=1)
            block, size = [], 0
        return pd.DataFrame({"lang_pred": name, "score": score})

    return of(text)


def identify(docs: DataFrame, max_bytes: int = 3_000_000, fold: int | None = 0, folds: int = 5) -> DataFrame:
    """``docs`` with new columns held_out, lang_pred and score; only the text decides a prediction.

    Null ids are not held out and never learnt from.  An empty table gives an empty result.  Further columns stay; the new ones replace
    columns of their names.
    """
    model = fit(docs, max_bytes, fold=fold, folds=folds)
    held = F.coalesce(remainder("doc_id", folds) == (folds if fold is None else fold), F.lit(False))
    return (docs.withColumn("__p", predict(docs, model, F.col("text")))
            .withColumns({"held_out": held, "lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score")}).drop("__p"))
