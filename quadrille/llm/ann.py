"""Operator 9: maximum inner product search by score-aware anisotropic quantisation and four-bit table scans."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import checkpointed

CENTERS = 16  # four bits
SCAN_ROWS = 4_096  # codes scanned at once
EXACT_PAIRS = 100_000  # pairs of query and row scored at once


@dataclass
class Index:
    """Coarse list centres, and sixteen codewords for each subspace of the residual to the list's centre."""

    lists: np.ndarray  # (lists, dim)
    words: np.ndarray  # (subspaces, CENTERS, width)
    width: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Nearest list centre of each vector."""
        return np.argmax(x @ self.lists.T - 0.5 * (self.lists**2).sum(axis=1), axis=1)

    def encode(self, x: np.ndarray, at: np.ndarray, eta: float) -> np.ndarray:
        """Codes (n, subspaces) of the residuals, by coordinate descent on the anisotropic loss."""
        return encode(self.pad(x), self.pad(x - self.lists[at]), self.words, eta)

    def pad(self, x: np.ndarray) -> np.ndarray:
        extra = self.words.shape[0] * self.width - x.shape[1]
        return np.pad(x, ((0, 0), (0, extra))) if extra else x

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with every codeword, summed for pairs of subspaces: (queries, bytes, 256)."""
        m = self.words.shape[0]
        one = np.einsum("qmw,mcw->qmc", self.pad(q).reshape(len(q), m, self.width), self.words).astype(np.float32)
        return (one[:, 1::2, :, None] + one[:, 0::2, None, :]).reshape(len(q), m // 2, 256)


def encode(x: np.ndarray, residual: np.ndarray, words: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codeword of each subspace that makes |e|^2 + (eta - 1) <e, x/|x|>^2 small, e the error of the whole residual.

    The part of the error along the vector itself, which moves large inner products, costs ``eta`` times the rest.
    """
    n, (m, _, w) = len(x), words.shape
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    r, u = residual.reshape(n, m, w), unit.reshape(n, m, w)
    codes = np.empty((n, m), dtype=np.uint8)
    along = np.zeros((n, m))
    square = (words**2).sum(axis=2)
    for j in range(m):
        codes[:, j] = np.argmin(square[j] - 2 * r[:, j] @ words[j].T, axis=1)
        along[:, j] = ((r[:, j] - words[j][codes[:, j]]) * u[:, j]).sum(axis=1)
    total = along.sum(axis=1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[:, j]
            err = (r[:, j] * u[:, j]).sum(axis=1, keepdims=True) - u[:, j] @ words[j].T
            cost = square[j] - 2 * r[:, j] @ words[j].T + (eta - 1) * (rest[:, None] + err) ** 2
            codes[:, j] = np.argmin(cost, axis=1)
            along[:, j] = err[np.arange(n), codes[:, j]]
            total = rest + along[:, j]
    return codes


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centre = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, at, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), size=k)])
    return centre


def train(x: np.ndarray, lists: int, width: int = 2, eta: float = 4.0, seed: int = 0, rounds: int = 6) -> Index:
    """Centres by k-means, then codewords by alternating anisotropic encoding and weighted least squares.

    With codes fixed, the loss is quadratic in each codeword: the rows coded by it give normal equations with the
    weight matrix I + (eta - 1) u u^T of each row's own direction u, the other subspaces' errors held.
    """
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    centre = _kmeans(x, lists, rng)
    m = 2 * math.ceil(x.shape[1] / (2 * width))
    index = Index(centre, np.zeros((m, CENTERS, width)), width)
    full = index.pad(x)
    residual = index.pad(x - centre[index.assign(x)])
    r = residual.reshape(len(x), m, width)
    u = (full / np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-30)).reshape(r.shape)
    index.words = np.stack([_kmeans(r[:, j], CENTERS, rng) for j in range(m)])
    for _ in range(rounds):
        codes = encode(full, residual, index.words, eta)
        chosen = index.words[np.arange(m)[None, :], codes]
        along = ((r - chosen) * u).sum(axis=2)
        total = along.sum(axis=1)
        for j in range(m):
            c, rest, uj = codes[:, j], total - along[:, j], u[:, j]
            # sum over rows of (I + (eta - 1) u u^T) w = r + (eta - 1) (rest + <r, u>) u
            outer = np.zeros((CENTERS, width, width))
            np.add.at(outer, c, (eta - 1) * uj[:, :, None] * uj[:, None, :])
            right = np.zeros((CENTERS, width))
            np.add.at(right, c, r[:, j] + (eta - 1) * (rest + (r[:, j] * uj).sum(axis=1))[:, None] * uj)
            n = np.bincount(c, minlength=CENTERS)
            left = outer + (n + 1e-9)[:, None, None] * np.eye(width)
            new = np.linalg.solve(left, right[:, :, None])[:, :, 0]
            index.words[j] = np.where(n[:, None] > 0, new, index.words[j])
            along[:, j] = ((r[:, j] - index.words[j][c]) * uj).sum(axis=1)
            total = rest + along[:, j]
    return index


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, rows) of residuals: one table lookup a byte, that is two subspaces."""
    out = np.zeros((len(tables), len(packed)), dtype=np.float32)
    for b in range(packed.shape[1]):
        out += np.take(tables[:, b], packed[:, b], axis=1)
    return out


def _whole_rows(x: np.ndarray) -> np.ndarray:
    """Each row as one opaque value, to compare rows as a whole."""
    x = np.ascontiguousarray(x)
    return x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()


def search_part(index: Index, qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, at: np.ndarray, packed: np.ndarray,
                k: int, rerank: int, probes: int | None = None, own: np.ndarray | None = None, rows_: np.ndarray | None = None,
                ) -> tuple[np.ndarray, ...]:
    """Best ``k`` of some rows for each query: all codes are scanned, all rows of the best ``rerank`` codes scored exactly.

    ``at`` and ``packed`` are the rows' lists and codes.  Ties go to smaller ids.  ``own`` and ``rows_`` number the queries'
    and the rows' own rows, which ids may not; the result is the queries' ids, rows' ids, scores and queries' rows.
    """
    own, rows_ = (qid, vid) if own is None or rows_ is None else (own, rows_)
    # of equal vectors only those of the k + 1 smallest ids can be among a query's k best, its own id being none
    same = np.unique(_whole_rows(v), return_inverse=True)[1]
    order = np.lexsort((vid, same))
    first = np.diff(same[order], prepend=-1) != 0
    nth = np.cumsum(first | (np.diff(vid[order], prepend=vid[order][:1]) != 0))
    stay = order[nth - nth[first][np.cumsum(first) - 1] <= k]
    stay = stay[np.argsort(vid[stay], kind="stable")]
    vid, v, at, packed, rows_ = vid[stay], v[stay], at[stay], packed[stay], rows_[stay]
    both = np.concatenate((at.astype("<i4")[:, None].view(np.uint8), packed), axis=1)
    _, head, code = np.unique(_whole_rows(both), return_index=True, return_inverse=True)
    rows, size = np.argsort(code, kind="stable"), np.bincount(code)
    start, most = np.cumsum(size) - size, rerank + 1  # one more, as a query's own row may hold a code
    out_q, out_v, out_s, out_o = [], [], [], []
    for a in range(0, len(q), 256):
        tables, block, ids, mine = index.tables(q[a : a + 256]), q[a : a + 256], qid[a : a + 256], own[a : a + 256]
        centre = block @ index.lists.T
        if probes is not None and probes < centre.shape[1]:
            np.put_along_axis(centre, np.argsort(-centre, axis=1, kind="stable")[:, probes:], -np.inf, axis=1)
        best = np.zeros((len(block), 0), dtype=np.float32)
        where = np.zeros((len(block), 0), dtype=np.int64)
        for lo in range(0, len(head), SCAN_ROWS):
            h = head[lo : lo + SCAN_ROWS]
            got = scan(tables, packed[h]) + centre[:, at[h]].astype(np.float32)
            best = np.concatenate((best, got), axis=1)
            where = np.concatenate((where, np.broadcast_to(np.arange(lo, lo + len(h)), got.shape)), axis=1)
            if best.shape[1] > most:
                keep = np.argpartition(-best, most - 1, axis=1)[:, :most]
                best, where = np.take_along_axis(best, keep, axis=1), np.take_along_axis(where, keep, axis=1)
        for b in range(0, len(block), 16):  # few at once, as one code may hold many rows
            i, j = np.nonzero(~np.isneginf(best[b : b + 16]))
            c = where[b + i, j]
            n = size[c]
            i = b + np.repeat(i, n)
            r = rows[np.repeat(start[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            other = mine[i] != rows_[r]
            i, r = i[other], r[other]
            exact = np.concatenate([np.zeros(0)] + [(v[r[x : x + EXACT_PAIRS]] * block[i[x : x + EXACT_PAIRS]]).sum(axis=1)
                                                    for x in range(0, len(r), EXACT_PAIRS)])
            order = np.lexsort((vid[r], -exact, i))
            i, r, exact = i[order], r[order], exact[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            out_q.append(ids[i[top]])
            out_v.append(vid[r[top]])
            out_s.append(exact[top])
            out_o.append(mine[i[top]])
    return tuple(np.concatenate(x) for x in (out_q, out_v, out_s, out_o))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
            sample: int = 20_000, list_rows: int | None = None, max_lists: int = 4_096, probes: int | None = None, rerank: int = 200,
            eta: float = 4.0, part_rows: int = 50_000, seed: int = 0) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: for rows whose id ``every`` divides, ``k`` of the largest inner products.

    Candidates are all rows but the query's own.  Lists are half the square root of the number of rows, or one for
    ``list_rows`` rows, and ``max_lists`` at most; the index is fitted on about ``sample`` rows or 20 a list, chosen by
    hashed id, and every row is encoded against the nearest of the lists' centres.  Rows are dealt by hashed id into parts of
    about ``part_rows`` or fewer, and so are queries.  Each part scans the four-bit codes of all its rows and scores
    all rows of the best ``rerank`` codes exactly in double precision, so copies of a vector push no other row out.
    Every query meets every list: its best rows lie in most of them, so the work grows as queries times rows.
    ``probes`` leaves out the rows of all but the query's best lists.  Ties go to the smaller id.

    Null ids, and vectors that are null, empty or zero, hold null or non-finite components, or are of another length
    than most, take no part.  Each row of an id that repeats is a query of its own, with its own ranks, and a candidate
    of the others.  Further columns are ignored.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    dim, total = lengths[0]["d"], lengths[0]["count"]
    rows = rows.filter(F.size(v) == dim).select("id", v.cast("array<double>").alias("v"))
    wanted = max(1, min(max_lists, total // list_rows if list_rows else math.isqrt(total) // 2))
    sample = max(sample, 20 * wanted)
    rate = int(min(1.0, sample / total) * (1 << 20)) or 1
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate).toPandas()
    some = some.sort_values("id")["v"] if len(some) else rows.limit(sample).toPandas()["v"]
    lists = max(1, min(wanted, len(some) // 20))
    held = vectors.sparkSession.sparkContext.broadcast(train(np.stack(some.to_numpy()), lists, eta=eta, seed=seed))  # bounded by max_lists

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            at = index.assign(x)
            code = index.encode(x, at, eta)
            packed = (code[:, 0::2] | (code[:, 1::2] << 4)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), batch.column(0), batch.column(1), pa.array([p.tobytes() for p in packed], pa.binary())],
                names=["l", "id", "v", "code"])

    coded_rows = rows.mapInArrow(coded, "l int, id long, v array<double>, code binary")
    coded_rows = checkpointed(coded_rows.withColumn("row", F.monotonically_increasing_id()))
    asked = coded_rows.filter(F.col("id") % every == 0).select("id", "v", "row")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-total // part_rows), min(cores, -(-total // 1_000)))
    turns = max(1, -(-asked.count() // part_rows))

    def deal(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """With its own part by hashed id, copied to every part of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        else:
            packed = np.stack([np.frombuffer(c, np.uint8) for c in left.column("code").to_pylist()])
            got = search_part(held.value, right.column("id").to_numpy(), _matrix(right.column("v").combine_chunks()),
                              left.column("id").to_numpy(), _matrix(left.column("v").combine_chunks()),
                              left.column("l").to_numpy(), packed, k, rerank, probes, right.column("row").to_numpy(), left.column("row").to_numpy())
        return pa.table({"query_id": pa.array(got[0]), "vec_id": pa.array(got[1]), "score": pa.array(got[2]), "row": pa.array(got[3])})

    found = (deal(coded_rows, "p", parts, "o", turns).groupBy("p", "o").cogroup(deal(asked, "o", turns, "p", parts).groupBy("p", "o"))
             .applyInArrow(search, "query_id long, vec_id long, score double, row long"))
    ranks = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
