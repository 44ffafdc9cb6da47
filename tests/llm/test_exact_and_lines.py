"""Operators 3 and 10 against brute force and SQL."""

import hashlib
import re

import duckdb
import pytest

from quadrille.llm import exact_dedup, line_dedup
from quadrille.llm.queries import ORACLE_SQL, QUERIES

LONG = "x" * 300_000
COMMON = "A paragraph that many documents share, long enough to count here"
DOCS = [
    (1, "same text", "a"), (2, "same text", "b"), (3, None, None), (4, "", "c"), (5, LONG, "d"), (6, LONG, None),
    (7, f"first\n  {COMMON.upper()}\t\nlast", "e"), (8, f"{COMMON}\n{COMMON}", "f"), (9, f"{COMMON}\nnine", "g"),
    (10, f"\n{COMMON}\n\n", "h"), (11, f"eleven\n{COMMON} \n{COMMON}\r\nend", "i"), (12, "short\nshort", "j"), (2, "same text", "b"),
]
SCHEMA = "doc_id long, text string, h string"


def brute_lines(docs, min_chars=40, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    held = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != i)]
        out[i] = ("\n".join(keep), len(lines), len(lines) - len(keep))
    return out


def test_exact_dedup(spark):
    for keep, best in (("smallest", min), ("largest", max)):
        got = exact_dedup.exact_dedup(spark.createDataFrame(DOCS, SCHEMA), keep=keep).collect()
        groups = {}
        for i, t, _ in DOCS:
            groups.setdefault(t or "", []).append(i)
        want = sorted((i, best(groups[t or ""]), len(groups[t or ""]), best(groups[t or ""]) == i, hashlib.sha256((t or "").encode()).hexdigest())
                      for i, t, _ in DOCS)
        assert sorted(tuple(r) for r in got) == want


def test_exact_dedup_without_broadcast_and_empty(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    a, b = (sorted(map(tuple, exact_dedup.exact_dedup(df, broadcast_rows=n).collect())) for n in (0, 100))
    assert a == b
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    lone = exact_dedup.exact_dedup(spark.createDataFrame([(None, "t"), (None, "t"), (4, "u")], "doc_id long, text string"))
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in lone.collect()} == {(None, None, True), (4, 4, True)}


def test_collisions_are_told_apart(spark, monkeypatch):
    """With a hash that always collides, only the bytes count."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00"))
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, text string")).collect()
    assert sorted((r[0], r[1], r[2], r[3]) for r in got) == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 1, True)]


def test_line_dedup(spark):
    docs = [(i, t) for i, t, _ in DOCS]
    want = brute_lines(docs)
    got = line_dedup.line_dedup(spark.createDataFrame(DOCS, SCHEMA)).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert (r["text"], r["n_lines"], r["n_dropped"]) == want[r["doc_id"]]


def test_line_dedup_with_hot_keys_and_shuffled_texts(spark):
    """Keys salted from three lines on, or all in one range; marks and ids broadcast or not: the same rows."""
    docs = [(i, t) for i, t, _ in DOCS] + [(20 + i, "\n".join([COMMON + str(i % 4), str(i), COMMON, COMMON + str(i % 4)])) for i in range(40)]
    df, want = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA.replace("h string", "first string")), brute_lines(docs)
    for settings in ({"chunk_rows": 3}, {"chunk_rows": 3, "broadcast_rows": 0}, {"chunk_rows": 60}):
        marks = line_dedup.keep_bitmaps(df, **settings)
        for rows in (0, 1000):
            got = line_dedup.apply_bitmaps(df, marks, broadcast_rows=rows).collect()
            assert len(got) == len(docs) and all((r["text"], r["n_lines"], r["n_dropped"]) == want[r["doc_id"]] and r["first"] == "x" for r in got)


def test_lines_are_streamed_in_sorted_ranges(spark):
    """The plan that runs: one range exchange, one sort by document and position, windows over it, nothing dealt by hash between."""
    df = spark.createDataFrame([(b"x", 0, 1, 2, 3)], "h binary, salt long, doc_id long, digest long, pos int")
    plan = line_dedup._stream(df)._jdf.queryExecution().executedPlan().toString()
    steps = re.findall(r"(Window|Sort|Exchange \w+)[ (]", plan)
    assert [x for i, x in enumerate(steps) if i == 0 or steps[i - 1] != x] == ["Window", "Sort", "Exchange rangepartitioning"]
    assert re.search(r"Sort \[h#\d+ ASC NULLS FIRST, salt#\d+L? ASC NULLS FIRST, doc_id#\d+L? DESC NULLS LAST, pos#\d+ ASC", plan)


def test_bitmaps_are_runs(spark):
    text = "\n".join(["one", COMMON, COMMON, "two", COMMON])
    df = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    rows = line_dedup.keep_bitmaps(df).collect()
    assert len(rows) == 5 and all([tuple(x) for x in r["dropped"]] == [(1, 2), (4, 1)] for r in rows)


def test_line_dedup_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.line_dedup(empty).count() == 0
    nulls = spark.createDataFrame([(None, COMMON)] * 9 + [(1, COMMON)], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.line_dedup(nulls).collect()} == {0}


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op10_line_dedup"])
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES[name](spark, sf)
    cols = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {cols} FROM ({ORACLE_SQL[name]})").fetchall())


def test_line_dedup_is_native(spark):
    plan = line_dedup.line_dedup(spark.createDataFrame(DOCS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
