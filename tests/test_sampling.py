"""Walks and estimates over the railway: products counted by nested loops, exact where all walks have one probability."""

import pytest

from quadrille.engine import Engine
from quadrille.operators import sampling
from quadrille.plans.algebra import UnsupportedQuery
from tests.fixtures import GRAPHS, LINES, ROOT, rail, rail_in_graphs, solve

PREFIX = f"PREFIX : <{ROOT}> "


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(rail(spark))


def estimated(engine, pattern, n, seed=0, count="*", method="weighted"):
    return sampling.estimate(engine, f"{PREFIX} SELECT (COUNT({count}) AS ?n) {{ {pattern} }}", n, seed, method).first()[0]


def test_exact_counts(engine):
    assert estimated(engine, ":L1 :calls ?stop", 1) == len(solve(["L1 calls ?s"]))
    assert estimated(engine, ":L1 :calls ?stop . ?x :operator ?f", 1) == len(solve(["L1 calls ?s", "?x operator ?f"]))
    assert estimated(engine, "?line :calls :Birch . ?line :operator ?f", 1) == len(solve(["?l calls Birch", "?l operator ?f"]))
    assert estimated(engine, "?x :sells ?y", 10) == 0


def test_estimates_are_near(engine):
    forced = Engine(engine.dataset, force_order=True)
    want = len(solve(["?l operator ?f", "?l calls ?s", "?s region ?a"]))
    assert estimated(forced, "?line :operator ?f . ?line :calls ?stop . ?stop :region ?area", 4000, 3) == pytest.approx(want, rel=0.1)
    for method in ("weighted", "chao_lee"):
        assert estimated(engine, "?stop :region ?area", 2000, 5, "DISTINCT ?area", method) == pytest.approx(3, abs=0.3)


def test_walks(engine):
    forced = Engine(engine.dataset, force_order=True)
    df = sampling.walk(forced, f"{PREFIX} SELECT ?line ?f ?stop {{ ?line :operator ?f . ?line :calls ?stop }}", 600, seed=1)
    rows = df.collect()
    won = [r for r in rows if r["_probability"] > 0]
    name = lambda t: t[1:-1].removeprefix(ROOT)
    assert len(rows) == 600 and 0 < len(won) < 600
    for r in won:  # one of four operators, then one of the line's stops
        stops = [s for line, _, s in LINES if line == name(r["line"])]
        assert name(r["stop"]) in stops and r["_probability"] == pytest.approx(1 / 4 / len(stops))
    assert {(name(r["line"]), name(r["stop"])) for r in won} == {(a, b) for a, _, b in LINES}
    assert {name(r["line"]) for r in rows if r not in won} == {"L4"}  # failed walks keep what they had
    assert [tuple(r) for r in df.orderBy("_walk").collect()] == [tuple(r) for r in df.orderBy("_walk").collect()]


def test_walks_have_no_single_task(engine, monkeypatch):
    """The first step is ranked in parts, each by hash; all its matches are drawn evenly."""
    monkeypatch.setattr(sampling, "RANKED", 2)
    df = sampling.walk(engine, f"{PREFIX} SELECT ?line ?stop {{ ?line :calls ?stop }}", 6000, seed=2)
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    seen = {}
    for r in df.collect():
        seen[r["line"], r["stop"]] = seen.get((r["line"], r["stop"]), 0) + 1
        assert r["_probability"] == pytest.approx(1 / len(LINES))
    assert len(seen) == len(LINES) and all(850 < n < 1150 for n in seen.values())


def test_walk_operators(engine, spark):
    n = lambda pattern, k=500: estimated(engine, pattern, k, 2)
    assert n("VALUES ?line { :L1 :L4 } ?line :operator ?f") == 2
    assert n("?line :calls ?stop FILTER(?stop != :Birch)") == pytest.approx(4, abs=0.6)
    assert n("{ ?line :calls ?x } UNION { ?line :operator ?x }", 3000) == pytest.approx(10, abs=0.4)
    assert n("?line :operator ?f OPTIONAL { ?line :calls ?stop }", 2000) == pytest.approx(7, abs=0.8)
    q = Engine(rail_in_graphs(spark))
    assert estimated(q, "GRAPH ?g { ?s ?p ?o }", 5) == sum(map(len, GRAPHS.values()))


def test_unsupported(engine):
    for text in ("SELECT DISTINCT ?p { ?p ?q ?o }", "SELECT ?p { ?p ?q ?o } LIMIT 3"):
        with pytest.raises(UnsupportedQuery):
            sampling.walk(engine, text, 5)
    with pytest.raises(ValueError):
        sampling.walk(engine, "SELECT ?p { ?p ?q ?o }", 0)
