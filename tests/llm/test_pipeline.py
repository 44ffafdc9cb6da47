"""The pipeline: each stage's decisions against plain code on its own input."""

import re

import pytest

import corpus_pipeline as P
from quadrille.llm import mixing
from quadrille.llm.common import table
from tests.llm.test_exact_and_lines import brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    for _, after in stages[:-1]:
        assert after.columns == P.COLUMNS


def test_quality_keeps_clean_documents(spark, stages):
    kept = {r["doc_id"] for r in stages[0][1].collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert len([i for i in good if i in kept]) >= 0.97 * len(good)
    assert len([i for i, q in labels.items() if q == 0 and i in kept]) <= max(1, 0.2 * (len(labels) - len(good)))


def test_lines(stages):
    want = brute_lines([(r["doc_id"], r["text"]) for r in stages[1][0].collect()])
    got = stages[1][1].collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: t for i, (t, _, _) in want.items()} and all(r["n_chars"] == len(r["text"]) for r in got)


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_one_of_each_group_stays(stages):
    before = {r["doc_id"]: shingles(r["text"]) for r in stages[2][0].collect()}
    kept = {r["doc_id"] for r in stages[2][1].collect()}
    alike = lambda a, b: len(a & b) / len(a | b)
    ids = sorted(before)
    close = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if alike(before[i], before[j]) >= 0.85]
    assert all(not (i in kept and j in kept) for i, j in close)
    for j in set(ids) - kept:  # what went had a near copy
        assert any(alike(before[i], before[j]) >= 0.7 for i in ids if i != j)


def test_mix_and_pack(stages):
    before, mixed = stages[3]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for r in before.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    times = {}
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    names = sorted(sizes)
    targets = dict(zip(names, mixing.capped_targets([sizes[n] for n in names], (5, 2, 1), 3, sum(sizes.values()))))
    longest = max(words(r["text"]) for r in before.collect())
    assert max(times.values()) <= 3 and all(abs(taken.get(n, 0) - targets[n]) <= longest for n in names)
    packed = stages[4][1].collect()
    assert sum(1 for r in packed if r["piece"] == 0) == mixed.count()


def test_run(spark):
    assert P.run(spark, SF).count() > 0


LONG = "plain words that go on and on for a while, all of them clean\n" * 3_000
ODD = [
    (1, "A short clean text about the weather in the north and the south.", "en", "a", 10), (1, "A short clean text about the weather in the north and the south.", "en", "a", 10),
    (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t\n ", "de", None, 5), (None, "A text that has no id at all, but words.", "en", "a", 1),
    (None, None, None, None, None), (5, LONG, "en", "c", len(LONG)), (6, LONG + "one more", "en", "c", 1), (2, "another text under an id that has two", "fr", "b", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "x", [1]) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, size int, key string, first array<int>")


@pytest.mark.parametrize("at", range(5))
def test_stages_of_odd_documents(spark, odd, at):
    """Nulls in any column, empty and long texts, repeated rows and ids, further columns of names used inside; and no rows."""
    name, stage = P.STAGES[at]
    rows = stage(spark, odd, SF).collect()
    assert stage(spark, odd.limit(0), SF).count() == 0
    if at < 4:
        assert all(r.__fields__ == P.COLUMNS for r in rows)
    known = {(r[0], r[1] or "") for r in ODD}
    if name == "quality_classifier":
        assert {(r["doc_id"], r["text"] or "") for r in rows} <= known and 1 in {r["doc_id"] for r in rows}
    if name == "line_dedup":
        assert len(rows) == len(ODD) and all(r["n_chars"] == len(r["text"]) for r in rows)
        assert {(r["doc_id"], r["text"]) for r in rows} == known  # too few hold any line
    if name == "simhash_near_dedup":
        # empty texts are one group, of ids 2, 3 and 4, to which the other text of id 2 belongs; rows without an id stay
        assert sorted((r["doc_id"] or -1 for r in rows)) == [-1, -1, 1, 1, 2, 2, 5]
    if name == "source_mixing":
        assert all(r["text"] and r["text"].strip() for r in rows) and {(r["doc_id"], r["text"]) for r in rows} <= known
    if name == "best_fit_packing":
        assert sum(r["piece"] == 0 for r in rows) == len(ODD) and all(0 < r["length"] <= 2048 for r in rows)
        assert sum(r["length"] == 1 for r in rows) >= 3  # empty texts are their end alone


def test_stage_tables_are_removed(spark, tmp_path, monkeypatch):
    from quadrille.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    assert P.run(spark, SF).count() > 0
    assert not list(tmp_path.glob("table-*"))
