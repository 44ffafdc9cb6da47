"""Operator 1: SimHash near-deduplication by a binary trie self-join."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import checkpointed, swept
from quadrille.llm.components import connected_components

SEED = 42
#: Node pairs with at most so many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 64
#: Node pairs handled at once, which bounds a task's memory.
FRONTIER = 500_000


#: Minima of a text's sketch, and how many of them make a routing key.
MINIMA, KEYS, KEY_MINIMA = 128, 16, 3
#: Bytes of shingle sets that a task gathers before it joins them.
SET_BYTES = 64 << 20
_ODD = (np.random.default_rng(7).integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``shingle`` words, repeats included, in blocks; nothing for a text without words.

    A-Z are lower-cased and words are runs of anything but ASCII white space, which is what ``bytes`` methods do.
    A text of fewer words is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    tail = ends[min(shingle, len(words)) - 1 :]
    digest, block = xxhash.xxh64_intdigest, 1 << 16
    for at in range(0, n, block):
        spans = zip(starts[at : min(n, at + block)].tolist(), tail[at : at + block].tolist())
        yield np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash: a bit is set if more than half the shingle hashes have it; 0 for a text without words."""
    return _majority(shingle_hashes(text, shingle))


def _majority(blocks: Iterable[np.ndarray]) -> int:
    total, n = np.zeros(64, dtype=np.int64), 0
    for h in blocks:
        n += len(h)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def set_digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the shingle hashes under each of ``MINIMA`` permutations as 32-bit numbers.

    Two texts agree in a minimum with a probability that is the Jaccard similarity of their shingle sets.
    """
    least = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    low = ((hashes >> np.uint64(32)) ^ hashes).astype(np.uint32)
    for at in range(0, len(low), 4096):
        x = low[at : at + 4096, None] * _ODD
        least = np.minimum(least, (x ^ (x >> np.uint32(15))).min(axis=0))
    return least


def set_sketches(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """Rows ``(doc_id, fp, same, set_fp, keys, minima)``: same is the digest of the shingle set and set_fp its SimHash.

    ``keys`` are the minima that keys are made of, whole; ``minima`` the low byte of every minimum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for t in batch.column(1):
                blocks = list(shingle_hashes(t.as_py(), shingle))
                own = np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))
                least = minima(own)
                got.append((_majority(blocks), set_digest(own), _majority([own]),
                            least[: KEYS * KEY_MINIMA].tobytes(), least.astype(np.uint8).tobytes()))
            longs = [pa.array(np.array([g[i] for g in got], dtype=np.uint64).view(np.int64)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, *(pa.array([g[i] for g in got], pa.binary()) for i in (3, 4))],
                                             names=["doc_id", "fp", "same", "set_fp", "keys", "minima"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, same long, set_fp long, keys binary, minima binary")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """Rows ``(doc_id, fp)``; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` runs of bits, as even as can be: shift and width of each."""
    edges = [round(bits * i / parts) for i in range(parts + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(parts)]


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


class _Forest:
    """Union-find over positions, fed with arrays of pairs; remembers the pairs that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            open_ = ra != rb
            a, b, lo, hi = a[open_], b[open_], np.minimum(ra, rb)[open_], np.maximum(ra, rb)[open_]
            if not len(a):
                return
            # of the pairs that would move one root, one does so now; the rest are looked at again
            _, first = np.unique(hi, return_index=True)
            self.links.append(np.stack([a[first], b[first]], axis=1))
            self.size += len(first)
            self.parent[hi[first]] = lo[first]
            self.parent = _find(self.parent)


def trie_links(values: np.ndarray, groups: np.ndarray, max_bits: int, alike: Callable | None = None) -> np.ndarray:
    """Index pairs that join all values of one group within ``max_bits`` differing bits of each other.

    ``values`` (uint64) are sorted within runs of equal ``groups``; every run is the root of a binary trie whose
    nodes are ranges of the sorted array.  Pairs of nodes are walked together from (root, root), the bits in which
    their prefixes differ add up, and a pair over ``max_bits`` is dropped.  Links inside one tree of the forest
    built so far are not returned: a pair whose leaves are all in one tree is dropped too, so a ball of n near
    copies gives n - 1 links, not n * n / 2.  ``alike``: says of index arrays which of their pairs are to be linked, of those within the budget.
    """
    n = len(values)
    forest = _Forest(n)
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if n else np.zeros(0, np.int64)
    ends = np.concatenate((starts[1:], [n])) if n else starts
    stack = [(63, starts, ends, starts, ends, np.zeros(len(starts), dtype=np.int8))]
    change, links = np.zeros(n, dtype=np.int64), 0
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, *(x[half:] for x in (a0, a1, b0, b1, err))), (bit, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        same = (a0 == b0) & (a1 == b1)
        open_ = ~(same & (a1 - a0 < 2))
        # prune what is one tree already: a node's leaves are if the sum of changes of root along it is zero.  Trees
        # only grow, so old sums miss some and err on none; they are taken anew once enough links have come.
        if forest.size > links + n // 16 or (forest.size > links and len(a0) > n // 16):
            change, links = np.concatenate(([0], np.cumsum(forest.parent[1:] != forest.parent[:-1]))), forest.size
        if len(a0) and links:
            whole = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (forest.parent[a0] == forest.parent[b0])
            open_ &= ~whole
        a0, a1, b0, b1, err, same = (x[open_] for x in (a0, a1, b0, b1, err, same))
        leaf = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (bit < 0)
        if leaf.any():
            _compare(values, forest, a0[leaf], a1[leaf], b0[leaf], b1[leaf], max_bits, alike)
        a0, a1, b0, b1, err, same = (x[~leaf] for x in (a0, a1, b0, b1, err, same))
        if not len(a0):
            continue
        ma, mb = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        cross = np.minimum(err + 1, 100).astype(np.int8)
        kids = [(a0, ma, b0, mb, err), (ma, a1, mb, b1, err), (a0, ma, mb, b1, cross)]
        other = ~same
        kids.append(tuple(x[other] for x in (ma, a1, b0, mb, cross)))
        joined = [np.concatenate(x) for x in zip(*kids)]
        live = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= max_bits)
        stack.append((bit - 1, *(x[live] for x in joined)))
    return np.concatenate(forest.links) if forest.links else np.zeros((0, 2), dtype=np.int64)


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First position of each range whose value has ``bit``; ranges are sorted and share all higher bits."""
    lo, hi, mask = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        on = (values[mid] & mask) != 0
        hi[open_[on]], lo[open_[~on]] = mid[on], mid[~on] + 1


def _compare(values, forest, a0, a1, b0, b1, max_bits, alike) -> None:
    """All leaf pairs of the node pairs: small node pairs many at once, large ones by blocks of their leaves."""
    most = 2_000_000 if alike is None else 20_000
    size = (a1 - a0) * (b1 - b0)
    large = size > most
    for x in np.flatnonzero(large).tolist():
        _compare_blocks(values, forest, int(a0[x]), int(a1[x]), int(b0[x]), int(b1[x]), max_bits, alike, most)
    a0, a1, b0, b1, size = (x[~large] for x in (a0, a1, b0, b1, size))
    nb = b1 - b0
    for s in _slices(size, most):
        each = size[s]
        at = np.repeat(np.arange(len(each)), each)
        k = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        _link(values, forest, a0[s][at] + k // nb[s][at], b0[s][at] + k % nb[s][at], max_bits, alike)


def _compare_blocks(values, forest, a0, a1, b0, b1, max_bits, alike, most) -> None:
    """One large node pair: its leaves share all bits, so it has as many pairs as texts of one fingerprint have.

    Leaves in one tree already are passed over, and ``most`` pairs, or one leaf's, are in memory at once.
    """
    step = max(1, most // (b1 - b0))
    for lo in range(a0, a1, step):
        i = np.arange(lo, min(lo + step, a1))
        j = np.arange(max(b0, lo + 1), b1) if a0 == b0 else np.arange(b0, b1)
        if alike is None and len(j):  # all are within the budget or none is: one leaf joins the rest
            _link(values, forest, np.full(len(j), lo), j, max_bits, None)
            _link(values, forest, i, np.full(len(i), j[0]), max_bits, None)
            if a0 == b0:
                return
            continue
        x, y = np.nonzero(forest.parent[i][:, None] != forest.parent[j][None, :])
        for s in range(0, len(x), most):
            p, q = i[x[s : s + most]], j[y[s : s + most]]
            ahead = p < q if a0 == b0 else slice(None)
            _link(values, forest, p[ahead], q[ahead], max_bits, alike)


def _link(values, forest, i, j, max_bits, alike) -> None:
    close = (forest.parent[i] != forest.parent[j]) & (np.bitwise_count(values[i] ^ values[j]) <= max_bits)
    i, j = i[close], j[close]
    if alike is not None and len(i):
        same = alike(i, j)
        i, j = i[same], j[same]
    forest.add(i, j)


def _slices(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of the node pairs with about ``most`` leaf pairs each; none has more alone."""
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield slice(at, end)
        at = end


def block_keys(nodes: int, max_bits: int, group: int = 2_048) -> list[tuple[int, ...]]:
    """Sets of blocks that lead the groups: with ``max_bits + m`` blocks, near fingerprints agree in ``m`` of them.

    ``m`` is the least for which groups have ``group`` rows or fewer on average if fingerprints are even, so groups do not grow
    with the table; the keys are all sets of ``m`` blocks.
    """
    m = 1
    while nodes * 2.0 ** (-64 * m / (max_bits + m)) > group and m < 8:
        m += 1
    return list(itertools.combinations(range(max_bits + m), m))


def near_links(nodes: DataFrame, max_bits: int = 4, group_rows: int = 2_000_000, group: int = 2_048) -> DataFrame:
    """Rows ``(u, v)`` of node ids that connect all nodes within ``max_bits`` bits; ``nodes`` has node and fp, fps distinct.

    Of ``max_bits + m`` blocks of the 64 bits, two such fingerprints agree in ``m`` at least (:func:`block_keys`), so each
    fingerprint goes to one group per set of ``m`` blocks, rotated so that the first of them leads and is the root
    of the group's trie.
    """
    nodes = checkpointed(nodes.select("node", "fp"))
    keys = block_keys(nodes.count(), max_bits, group)
    blocks = _blocks(64, max_bits + len(keys[0]))
    bits = lambda i: F.shiftrightunsigned(F.col("fp"), blocks[i][0]).bitwiseAND((1 << blocks[i][1]) - 1)
    key = lambda at: bits(at[0]).cast("long") if len(at) == 1 else F.xxhash64(*[bits(i) for i in at])
    keyed = nodes.select("node", "fp", F.lit(None).cast("binary").alias("minima"), F.explode(F.array(*[
        F.struct(F.lit(n).cast("long").alias("block"), key(at).alias("key")) for n, at in enumerate(keys)])).alias("g")).select(
            "node", "fp", "minima", "g.block", "g.key")
    return _joined(keyed, max_bits, [sum(blocks[at[-1]]) for at in keys], None, group_rows)


def alike_links(nodes: DataFrame, docs: DataFrame, similarity: float, shingle: int, group_rows: int = 200_000,
                set_rows: int = 20_000) -> DataFrame:
    """Rows ``(u, v)`` that connect the nodes whose shingle sets have this Jaccard similarity or more, and no others.

    ``nodes`` has node, same, fp, keys and minima, ``docs`` doc_id and text.  Fingerprints of such texts differ in too
    many bits for blocks to be selective: about 10 of 64 at 0.8.  So texts meet in groups by ``KEYS`` keys of
    ``KEY_MINIMA`` minima each, of which a pair at 0.8 shares none once in 100,000.  Keys that one node has alone are
    dropped before anything else travels.  A group's trie join links what agrees in that share of all minima less
    0.15, over four deviations, within a budget of bits that is as wide.  These links only bring texts together: in
    every component of them the pairs are joined again, and linked if the shingle sets themselves are similar enough.
    """
    shares = 2 * similarity / (1 + similarity)
    turn = math.acos(shares) / math.pi
    budget = math.ceil(64 * turn + 4.5 * math.sqrt(64 * turn * (1 - turn)))
    bytes_ = 4 * KEY_MINIMA
    keys = nodes.select("node", F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("block"), F.xxhash64(F.substring("keys", 1 + i * bytes_, bytes_)).alias("key"))
        for i in range(KEYS)])).alias("g")).select("node", "g.block", "g.key")
    shared = keys.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1").select("block", "key")
    met = keys.join(shared, ["block", "key"])
    keyed = met.join(nodes.select("node", "fp", "minima"), "node").select("node", "fp", "minima", "block", "key")
    loose = connected_components(_joined(keyed, budget, [0] * KEYS, similarity - 0.15, group_rows))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t.as_py(), shingle) for t in batch.column(0)]
            # an id may have several texts; the node's is the one of its digest
            right = np.array([set_digest(h) for h in own], dtype=np.uint64).view(np.int64) == batch.column(1).to_numpy()
            at = pa.array(np.flatnonzero(right))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(2, 7)), pa.array([h.tobytes() for h, r in zip(own, right) if r], pa.binary())],
                                             names=["node", "fp", "minima", "block", "key", "set"])

    members = loose.join(nodes.select("node", "same", "fp", "minima"), "node")
    texts = members.join(docs, F.col("node") == F.col("doc_id")).select(
        "text", "same", "node", "fp", "minima", F.lit(0).cast("long").alias("block"), F.col("component").cast("long").alias("key"))
    held = texts.mapInArrow(sets, "node long, fp long, minima binary, block long, key long, set binary")
    return _joined(held, budget, [0], similarity - 0.15, set_rows, similarity)


def alike_sets(sets: list[np.ndarray], least: np.ndarray, share: float, similarity: float) -> Callable:
    """Says of pairs whether their sets are similar enough, by the sets where minima agree in ``share``.

    Pairs that others of the same call already connect are passed over.
    """
    size = np.array([len(x) for x in sets], dtype=np.int64)

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, root = np.zeros(len(i), dtype=bool), {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        maybe = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
        maybe &= (least[i] == least[j]).mean(axis=1) >= share
        for x in np.flatnonzero(maybe).tolist():
            a, b = int(i[x]), int(j[x])
            u, v = find(a), find(b)
            if u == v:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both >= similarity * (size[a] + size[b] - both) - 1e-9:
                root[u], out[x] = v, True
        return out

    return alike


def _joined(keyed: DataFrame, max_bits: int, turns: list[int], share: float | None, group_rows: int,
            similarity: float | None = None) -> DataFrame:
    """Trie joins of all groups, in batches of many groups; with a ``similarity``, ``keyed`` has sets, which decide.

    A group of over ``group_rows`` rows, or ``SET_BYTES`` of sets, is dealt into chunks and its pairs of chunks are joined
    apart, so that memory stays bounded and no pair is lost.
    """
    keyed = keyed if share is None else checkpointed(keyed)
    weight = F.count("*") / group_rows
    weight = weight if similarity is None else F.greatest(weight, F.sum(F.length("set")) / SET_BYTES)
    sizes = keyed.groupBy("block", "key").agg(weight.alias("n")).filter(F.col("n") > 1)
    chunks = sizes.select("block", "key", F.ceil("n").cast("int").alias("chunks"))
    if chunks.isEmpty():
        keyed = keyed.withColumn("part", F.lit(0).cast("long"))
    else:
        keyed = keyed.join(chunks, ["block", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        keyed = keyed.withColumn("c", F.pmod(F.xxhash64("fp", "node"), F.col("chunks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        keyed = keyed.withColumn("o", other).withColumn("part", F.least("c", "o").cast("long") * (1 << 31) + F.greatest("c", "o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= min(1_000_000, group_rows) or sum(b.nbytes for b in held) >= SET_BYTES:
                whole = pa.Table.from_batches(held).combine_chunks()
                same = np.ones(rows, dtype=bool)
                for name in ("block", "key", "part"):
                    x = whole.column(name).to_numpy()
                    same &= x == x[-1]
                cut = rows - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield links(whole.slice(0, cut))
                    held, rows = whole.slice(cut).to_batches(), rows - cut
        if rows:
            yield links(pa.Table.from_batches(held))

    def links(x: pa.Table) -> pa.RecordBatch:
        node, value, block = x.column("node").to_numpy(), x.column("fp").to_numpy().view(np.uint64), x.column("block").to_numpy()
        shift = np.array([t % 64 for t in turns], dtype=np.uint64)[block]
        turned = np.where(shift == 0, value, (value >> shift) | (value << ((np.uint64(64) - shift) & np.uint64(63))))
        change = np.zeros(len(node), dtype=bool)
        for name in ("block", "key", "part"):
            c = x.column(name).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        group = np.cumsum(change)
        order = np.lexsort((turned, group))
        alike = None
        if share is not None:
            least = np.frombuffer(b"".join(x.column("minima").to_pylist()), dtype=np.uint8).reshape(len(node), MINIMA)[order]
            alike = lambda i, j: (least[i] == least[j]).mean(axis=1) >= share
            if similarity is not None:
                sets = x.column("set").to_pylist()
                alike = alike_sets([np.frombuffer(sets[i], np.uint64) for i in order.tolist()], least, share, similarity)
        got = trie_links(turned[order], group[order], max_bits, alike)
        return pa.RecordBatch.from_arrays([pa.array(node[order][got[:, 0]]), pa.array(node[order][got[:, 1]])], names=["u", "v"])

    dealt = keyed.repartition("block", "key", "part").sortWithinPartitions("block", "key", "part")
    columns = ["node", "fp", "minima", "block", "key", "part"] + (["set"] if similarity is not None else [])
    return dealt.select(*columns).mapInArrow(run, "u long, v long")


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, max_bits: int = 4,
               similarity: float | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Documents whose fingerprints differ in ``max_bits`` bits or fewer are linked (:func:`near_links`); with a
    ``similarity``, instead those whose shingle sets are that similar (:func:`alike_links`).  Components are taken
    over all links.  Equal fingerprints, or with a similarity equal sets, are one node, so copies are never paired.  Rows with a null id stay, with a null
    component_id, and link nothing.  Rows that repeat an id belong to the component of each of their fingerprints.
    Null and empty texts have fingerprint zero.  Other columns are ignored.  An empty table gives an empty result.
    """
    if similarity is None:
        prints = checkpointed(fingerprints(docs, id_column, text_column, shingle).withColumn("same", F.col("fp")))
        nodes = prints.filter("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("node")).withColumn("fp", F.col("same"))
        links = near_links(nodes, max_bits)
    else:
        prints = checkpointed(set_sketches(docs, id_column, text_column, shingle))
        nodes = prints.filter("doc_id is not null").groupBy("same").agg(
            F.min("doc_id").alias("node"), F.min("set_fp").alias("fp"), F.min("keys").alias("keys"), F.min("minima").alias("minima"))
        texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        links = alike_links(nodes, texts, similarity, shingle)
    # one id under two fingerprints joins them: the fingerprints' own nodes are then linked
    twice = prints.groupBy("doc_id").agg(F.min("same").alias("a"), F.max("same").alias("b")).filter("a <> b and doc_id is not null")
    extra = prints.join(twice.select("doc_id"), "doc_id").join(nodes.select("same", "node"), "same").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    swept(docs.sparkSession)
    found = connected_components(links.union(extra))
    comp = nodes.join(found, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
    out = prints.select("doc_id", "fp", "same").join(comp, "same", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
