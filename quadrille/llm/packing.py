"""Operator 6: best-fit packing of token sequences, certified by dual-feasible-function bounds."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import HashIndex, checkpointed

#: Words, and parts of words, whose ids a worker remembers at most, in each of two generations: some 170 bytes each.
CACHE_WORDS, CACHE_PARTS = 400_000, 300_000
#: Texts looked up together, in characters.
BLOCK_CHARS = 4_000_000
#: Normaliser and pre-tokenizer, as the tokenizer's file has them, under which words and their parts stand alone.
_SPLITS = [
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]
#: What such a tokenizer makes of words in ASCII and Latin-1 letters, once they are lower-cased; others are not plain.
_PARTS = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+|\n")
_NOT_PLAIN = re.compile(r"[^\n\x21-\x7eÀ-ÖØ-öø-ÿ]|<\|")


def _plain(words: list[str]) -> tuple[list[str], list[str]]:
    """Words of ASCII and Latin-1 letters without the marks of special tokens, and the others."""
    line = "\n".join(words)
    bad: set[str] = set()
    at = 0
    while m := _NOT_PLAIN.search(line, at):
        at = line.find("\n", m.start()) + 1 or len(line) + 1
        bad.add(line[line.rfind("\n", 0, m.start()) + 1 : at - 1])
    return ([w for w in words if w not in bad], list(bad)) if bad else (words, [])


class Merges:
    """Byte-pair merges of many words at once, as the tokenizers library makes them from the same file.

    In each word the pair of lowest rank, the leftmost of equal ones, becomes one symbol until no pair has a rank.
    Words are rows of a matrix.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.uint64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.uint64)
        self.pairs = HashIndex(left << np.uint64(32) | right)  # by rank
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        # bytes as the vocabulary writes them: printable ones as themselves, the rest from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[chars[b] + suffix] for b in range(256)], dtype=np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rank = self.pairs.find(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
        return np.where(rank >= 0, rank, self.NONE)

    def of(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order and the number of each; word i is the bytes of ``raw`` up to ``ends[i]``, no word empty."""
        starts = np.concatenate(([0], ends[:-1]))
        size = ends - starts
        base = self.inner[raw]
        base[ends - 1] = self.last[raw[ends - 1]]
        number = np.zeros(len(ends), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        # words of like lengths together, so that rows are mostly full
        lo = 0
        while lo < len(order):
            width = int(size[order[lo]])
            hi = min(int(np.searchsorted(size[order], width + width // 4, side="right")), lo + max(1, 2_000_000 // width))
            rows = order[lo:hi]
            lo, width = hi, int(size[order[hi - 1]])
            at = starts[rows][:, None] + np.arange(width)
            inside = np.arange(width) < size[rows][:, None]
            sym = np.where(inside, base[np.minimum(at, len(base) - 1)], 0)
            rank = np.full((len(rows), width), self.NONE)
            pair = inside[:, 1:]
            rank[:, :-1][pair] = self.ranks(sym[:, :-1][pair], sym[:, 1:][pair])
            length = size[rows].copy()
            live = np.arange(len(rows))
            while True:
                best = np.argmin(rank, axis=1)
                found = rank[np.arange(len(live)), best]
                more = found != self.NONE
                if not more.all():
                    stop = ~more
                    done.append((rows[live[stop]], sym[stop]))
                    number[rows[live[stop]]] = length[stop]
                    live, sym, rank, best, found, length = (x[more] for x in (live, sym, rank, best, found, length))
                if not len(live):
                    break
                i = np.arange(len(live))
                sym[i, best] = self.made[found]
                # what is right of the pair moves up by one
                move = np.arange(sym.shape[1] - 1) > best[:, None]
                sym[:, :-1] = np.where(move, sym[:, 1:], sym[:, :-1])
                rank[:, :-1] = np.where(move, rank[:, 1:], rank[:, :-1])
                length -= 1
                sym, rank = sym[:, : length.max()], rank[:, : length.max()]
                rank[i, length - 1] = self.NONE
                before = np.flatnonzero(best > 0)
                rank[before, best[before] - 1] = self.ranks(sym[before, best[before] - 1], sym[before, best[before]])
                after = np.flatnonzero(best < length - 1)
                rank[after, best[after]] = self.ranks(sym[after, best[after]], sym[after, best[after] + 1])
        first = np.cumsum(number) - number
        out = np.zeros(int(number.sum()), dtype="<u4")
        for rows, sym in done:
            inside = np.arange(sym.shape[1]) < number[rows][:, None]
            out[(first[rows][:, None] + np.arange(sym.shape[1]))[inside]] = sym[inside]
        return out, number


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, through caches of words and of their parts.

    A tokenizer whose file has the normaliser and pre-tokenizer of ``_SPLITS``, and whose tokens mark the ends of
    words, never crosses a space or newline: a text's ids are those of its space-separated words in order, and a plain
    word's those of its parts (letters, single digits, the rest) in order.  New words are split all at once, and new
    parts merged all at once (:class:`Merges`).  Any other tokenizer encodes whole texts, and words that are not plain
    are encoded by the library.  Caches change no result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        model = file["model"]
        self.split = [file["normalizer"], file["pre_tokenizer"]] == _SPLITS and model["type"] == "BPE" and bool(
            model.get("end_of_word_suffix")) and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if self.split:
            self.merges = Merges(model)
            self.cache: dict[str, bytes] = {}
            self.old: dict[str, bytes] = {}
            self.parts: dict[str, bytes] = {"\n": b""}
            self.old_parts: dict[str, bytes] = {}

    def _encoded(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, parts: list[str]) -> list[bytes]:
        raw = np.frombuffer(("\n".join(parts) + "\n").encode("utf-8"), dtype=np.uint8)
        breaks = raw == 10
        ends = np.flatnonzero(breaks)
        ids, number = self.merges.of(raw[~breaks], ends - np.arange(len(ends)))
        held, at = ids.tobytes(), (4 * np.cumsum(number)).tolist()
        return [held[a:b] for a, b in zip([0, *at], at)]

    def _learn(self, words: set[str]) -> None:
        cache, old = self.cache, self.old
        if old:
            again = words.intersection(old)
            cache.update((w, old[w]) for w in again)
            words = words - again
        plain, other = _plain(list(words))
        cache.update((w, self._encoded(w)) for w in other)
        if not plain:
            return
        flat = _PARTS.findall("\n".join(plain).lower() + "\n")
        needed = set(flat)
        missing = needed.difference(self.parts)
        if len(self.parts) + len(missing) > CACHE_PARTS:
            self.parts, self.old_parts = {"\n": b""}, self.parts
            missing = needed - {"\n"}
        if self.old_parts:
            again = missing.intersection(self.old_parts)
            self.parts.update((p, self.old_parts[p]) for p in again)
            missing -= again
        if missing:
            unknown = list(missing)
            self.parts.update(zip(unknown, self._merged(unknown)))
        each = list(map(self.parts.__getitem__, flat))
        raw = b"".join(each)
        # where the words end among all ids: at the newlines, which alone have none
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        ends = np.cumsum(sizes)[sizes == 0].tolist()
        cache.update(zip(plain, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def rest(self) -> None:
        """Between tasks: lets the older generation go, as the worker stays and others need its memory."""
        if self.split:
            self.old, self.old_parts = {}, {}

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.split:
            return [self._encoded(t) for t in texts]
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            found, open_, size = [], [], 0
            get = self.cache.get
            while at < len(texts) and (size < BLOCK_CHARS or not found):
                words = texts[at].replace("\n", " ").split(" ")
                ids = list(map(get, words))
                if None in ids:
                    places = [i for i, x in enumerate(ids) if x is None]
                    open_.append((ids, places, [words[i] for i in places]))
                found.append(ids)
                size += len(texts[at])
                at += 1
            if open_:
                new = set().union(*(w for _, _, w in open_))
                if len(self.cache) + len(new) > CACHE_WORDS:
                    self.cache, self.old = {}, self.cache
                self._learn(new)
                for ids, places, words in open_:
                    for i, x in zip(places, map(self.cache.__getitem__, words)):
                        ids[i] = x
            out += map(b"".join, found)
        return out


_TOKENIZERS: dict[str, WordIds] = {}


def _words(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids and ``end_id``, cut at ``capacity``.

    ``tokenizer`` is the path of a tokenizers file that every executor can open.  Null text is empty: one piece that
    holds ``end_id`` alone.  Whole texts are tokenized; the cut loses no id.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end, width = np.asarray([end_id], dtype="<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for batch in batches:
            names, cols = [f.split()[0] for f in kind.split(", ")], [[] for _ in range(6 if with_ids else 5)]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), words.of(texts)):
                ids += end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    row = (doc, k // width, k // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").tolist() if with_ids else None)
                    for c, v in zip(cols, row):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        words.rest()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, kind)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most bins that a family of dual feasible functions proves necessary.

    For each threshold t up to half the capacity: lengths over capacity - t count as whole bins and lengths under t
    as nothing (Martello and Toth's bound).  For each k up to 20: a length x counts as floor((k + 1) x) / k, or as
    itself where (k + 1) x is whole (Fekete and Schepers).  t = 0 is the plain sum.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    words, number = np.cumsum(count * size), np.cumsum(count)
    t = np.arange(0, capacity // 2 + 1)
    whole = number[-1] - number[capacity - t]
    middle = words[capacity - t] - np.where(t > 0, words[np.maximum(t - 1, 0)], 0)
    best = int(np.max(whole - (-middle // capacity)))
    for k in range(1, 21):
        x = (k + 1) * size
        scaled = np.where(x % capacity == 0, k * size, (x // capacity) * capacity)  # in units of capacity * k
        best = max(best, -(-int((count * scaled).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins; the fullest bin that has room takes the next length."""
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order].tolist()
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    mask = bins = 0
    for item, size in zip(order.tolist(), sizes):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, b, bins = capacity, bins, bins + 1
        where[item], offset[item] = b, capacity - free
        if free - size:
            room[free - size].append(b)
            mask |= 1 << (free - size)
    return where, offset, bins


def pack(items: DataFrame, capacity: int = 2048, part_rows: int = 100_000, rounds: int = 6) -> DataFrame:
    """``items`` (a column length of 1 to ``capacity``, and any others) with new columns sequence_id, offset and certified.

    Rows are dealt evenly to partitions of about ``part_rows``, and each is packed by best-fit decreasing.  A
    partition whose number of bins equals its lower bound is certified: it settles, but for its emptiest bin.  A
    partition with a gap settles nothing.  What has not settled is exchanged: it is dealt anew, over fewer
    partitions, and packed again, until one partition holds the rest or ``rounds`` are over; then all settles.  So
    at most the last partitions add bins beyond the sum of what is certified.  ``certified`` says of each row whether its
    sequence settled in a partition that met its bound; so what ``rounds`` settled without a certificate can be seen.
    A partition is held in memory by one task, its size does not grow with the table.  Offsets in a sequence are
    gapless from 0.
    """
    items = items.drop("sequence_id", "offset", "certified", "settled")
    names = items.columns
    schema = items.select(*names).schema.add("sequence_id", "long").add("offset", "long").add("certified", "boolean").add("settled", "boolean")
    left, done = checkpointed(items), []
    rows = left.count()
    for at in range(rounds):
        parts = max(1, math.ceil(rows / part_rows))
        last = parts == 1 or at == rounds - 1

        def run(batches: Iterator[pa.RecordBatch], at=at, last=last) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            whole = pa.Table.from_batches(got).combine_chunks()
            lengths = whole.column("length").to_numpy().astype(np.int64)
            where, offset, bins = best_fit_decreasing(lengths, capacity)
            settled, certified = np.full(len(lengths), last), bins == lower_bound(lengths, capacity)
            if not last and certified:
                fill = np.bincount(where, weights=lengths, minlength=bins)
                settled = where != int(np.argmin(fill))
            base = (at << 56) | (TaskContext.get().partitionId() << 32)
            for name, x in (("sequence_id", where + base), ("offset", offset), ("certified", np.full(len(lengths), certified)),
                            ("settled", settled)):
                whole = whole.append_column(name, pa.array(x))
            yield from whole.to_batches(max_chunksize=100_000)

        packed = checkpointed(left.repartition(parts).mapInArrow(run, schema))
        done.append(packed.filter("settled").drop("settled"))
        left = packed.filter("not settled").select(*names)
        if last:
            break
        rows = left.count()
        if not rows:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents tokenized, cut and packed: one row per piece with its sequence_id and offset (see :func:`pack`).

    Null ids stay null; rows that repeat an id are packed as they are, each its own document.  An empty table gives
    an empty result; further columns are ignored.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, with_ids, id_column, text_column), capacity)
