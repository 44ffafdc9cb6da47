"""Operator 1 against brute force over all pairs."""

import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash

from quadrille.llm import simhash
from quadrille.llm.common import table
from quadrille.llm.components import connected_components


def brute_fingerprint(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    each = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in each) > len(each))


def components(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A b C d", "É ÉÉ  x  y\x85z", "the Quick\tbrown fox " * 40, "w " * 70_000])
def test_fingerprint(text):
    for k in (4, 5):
        assert simhash.fingerprint(text, k) == brute_fingerprint(text, k)


@pytest.mark.parametrize("seed", range(6))
def test_trie_links_span_the_components(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, size=15, dtype=np.uint64)
    v = base[rng.integers(0, 15, 300)]
    for i in range(len(v)):
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            v[i] ^= np.uint64(1 << int(b))
    v = np.unique(v)
    got = simhash.trie_links(v, np.zeros(len(v), int), 4)
    pairs = [(i, j) for i in range(len(v)) for j in range(i) if bin(int(v[i] ^ v[j])).count("1") <= 4]
    want = components(len(v), pairs)
    assert components(len(v), got.tolist()) == want and len(got) == len(v) - len(set(want))


@pytest.mark.parametrize("alike", [True, False])
def test_many_texts_of_one_fingerprint(alike):
    """20,000 equal values that are all alike, or 2,500 of which only neighbours are: memory in proportion to them."""
    n = 20_000 if alike else 2_500
    of = (lambda i, j: np.ones(len(i), bool)) if alike else (lambda i, j: np.abs(i - j) == 1)
    tracemalloc.start()
    got = simhash.trie_links(np.full(n, 5, dtype=np.uint64), np.zeros(n, int), 23, of)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n - 1 and len(set(components(n, got.tolist()))) == 1 and peak < 30_000_000


@pytest.mark.parametrize("alike", [True, False])
def test_two_nodes_of_many_equal_values(alike, monkeypatch):
    """Two fingerprints near each other, each of many texts."""
    v = np.sort(np.array([5] * 700 + [7] * 900 + [1 << 40] * 3, dtype=np.uint64))
    of = None if alike else (lambda i, j: (i % 2) == (j % 2))
    got = simhash.trie_links(v, np.zeros(len(v), int), 4, of).tolist()
    want = [(i, j) for i in range(len(v)) for j in (i - 1, i - 2, i - 700, i - 701) if j >= 0
            and bin(int(v[i] ^ v[j])).count("1") <= 4 and (alike or i % 2 == j % 2)]
    assert components(len(v), got) == components(len(v), want)


def documents(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    out = []
    for i in range(n):
        words = rng.choices(vocabulary, k=150)
        out.append(" ".join(words))
        if i % 3 == 0:
            words[rng.randrange(150)] = "changed"
            out.append(" ".join(words))
    return [(i * 7 + 1, t) for i, t in enumerate(out)] + [(5000, None), (5001, ""), (5002, "  \n"), (1, out[0]), (None, out[1]), (6000, out[1])]


def test_near_dedup_equals_brute_force(spark):
    docs = documents()
    got = simhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4, max_bits=4).collect()
    assert len(got) == len(docs)
    known = [(i, t) for i, t in docs if i is not None]
    fps = [brute_fingerprint(t, 4) for _, t in known]
    pairs = [(a, b) for a in range(len(known)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    root = components(len(known), pairs)
    least = {}
    for (i, _), r in zip(known, root):
        least[r] = min(i, least.get(r, i))
    want = {(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(known, fps, root)}
    assert {tuple(r) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_large_groups_are_dealt_into_chunks(spark):
    docs = documents(60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = simhash.fingerprints(df, shingle=4).filter("doc_id is not null").groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "node")
    a, b = (connected_components(simhash.near_links(prints, 4, group_rows=n)) for n in (2, 1_000_000))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("group, m", [(64, 1), (0.001, 2), (2e-6, 3)])
def test_blocks_grow_with_the_count(spark, group, m):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 1 << 63, size=40, dtype=np.uint64)
    v = np.concatenate([base, *(base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in (1, 3, 4, 4, 4, 5, 6))])
    v = np.unique(v)
    assert len(simhash.block_keys(len(v), 4, group)[0]) == m
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v.view(np.int64))], "node long, fp long")
    got = simhash.near_links(df, 4, group=group).collect()
    pairs = [(i, j) for i in range(len(v)) for j in range(i) if bin(int(v[i] ^ v[j])).count("1") <= 4]
    assert components(len(v), [tuple(r) for r in got]) == components(len(v), pairs)


def test_similarity_on_all_documents(spark):
    """Every document of sf0.01: components as all pairs of shingle sets give them, and they join different texts."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    sets = [simhash.shingle_set(t, 5) for _, t in docs]
    every = {h: i for i, h in enumerate(sorted({int(h) for s in sets for h in s}))}
    held = {}
    for i, s in enumerate(sets):
        for h in s.tolist():
            held.setdefault(h, []).append(i)
    shared = {}
    for at in held.values():
        for x, i in enumerate(at):
            for j in at[:x]:
                shared[i, j] = shared.get((i, j), 0) + 1
    empty = [i for i, s in enumerate(sets) if not len(s)]
    pairs = [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9] + list(zip(empty, empty[1:]))
    assert every and any(docs[i][1] != docs[j][1] for i, j in pairs)
    root = components(len(docs), pairs)
    least = {}
    for (i, _), r in zip(docs, root):
        least[r] = min(i, least.get(r, i))
    got = simhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5, similarity=0.8).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, least[r]) for (i, _), r in zip(docs, root))


def test_similar_texts(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    docs, groups = [], []
    for g in range(25):
        words = rng.choices(vocabulary, k=300)
        for c in range(3):
            copy = list(words)
            for _ in range(c * 3):  # each edit breaks five shingles of 296: similarity of 0.82 and more
                copy[rng.randrange(300)] = "x" + str(rng.random())
            docs.append((len(docs), " ".join(copy)))
            groups.append(g)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5, similarity=0.8).collect()}
    assert len({got[i] for i in got}) <= 27 and all(groups[i] == groups[c] for i, c in got.items())


def test_both_sides_of_the_similarity(spark):
    """Pairs of about 0.7 to 0.9, some texts with much repeated words: linked if and only if the sets reach 0.8."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    docs = []
    for g in range(150):
        words = rng.choices(vocabulary, k=200) + ["again"] * (300 if g % 5 == 0 else 0)
        copy = words[: 200 + (6 if g % 5 == 0 else 0)]
        for at in rng.sample(range(0, 200, 10), 2 + g % 6):
            copy[at] = f"x{g}y{at}"
        docs += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
    docs += [(0, docs[5][1]), (1000, "a b c d e f g h i"), (1001, "a b c d e f g h"), (1002, "a b c d e f g")]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in docs]
    pairs = [(a, b) for a in range(len(docs)) for b in range(a)
             if docs[a][0] == docs[b][0] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    near = [len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) for g in range(150)]
    assert sum(0.8 <= x < 0.85 for x in near) > 15 and sum(0.73 < x < 0.8 for x in near) > 15
    root = components(len(docs), pairs)
    least = {}
    for (i, _), r in zip(docs, root):
        least[r] = min(i, least.get(r, i))
    got = simhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5, similarity=0.8).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, least[r]) for (i, _), r in zip(docs, root))


def test_empty_table(spark):
    assert simhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("split", [0, 10**6])
def test_components_of_a_path_and_a_hub(spark, split):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long"), split_edges=split).collect())
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1301)}
