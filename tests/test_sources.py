"""Statements, tables, results and the endpoint."""

import json
import threading
import urllib.parse
import urllib.request

import pytest

from quadrille.endpoint import DESCRIPTION, Endpoint, serve
from quadrille.engine import Engine
from quadrille.operators.compiler import Services
from quadrille.operators.paging import Budget
from quadrille.sources.dataset import Registry, from_lines, read_quads, write_quads
from quadrille.sources.relational import RelationalDataset
from quadrille.sources.remote import RemoteService
from quadrille.sources.results import from_json, to_json
from quadrille.streaming.statements import match_stream, read_stream
from tests.fixtures import GRAPHS, LINES, OPERATORS, RAIL, ROOT, as_lines, rail, rail_in_graphs

SF = "/root/testdata/sf0.001"


def test_lines(spark):
    d = from_lines(spark, """
        # a comment
        <http://a> <http://p> "x\\"y"@EN .
        <http://a> <http://p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> <http://g> .
        _:b <http://p> "plain"^^<http://www.w3.org/2001/XMLSchema#string> .
    """.replace("# a comment\n", "")).quads.collect()
    assert {(r["g"], r["o"]) for r in d} == {(None, '"x\\"y"@en'), ("<http://g>", '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'), (None, '"plain"')}
    with pytest.raises(ValueError):
        from_lines(spark, "not a statement")


def test_files(spark, tmp_path):
    (tmp_path / "x.nt").write_text("# comment\n\n" + as_lines(LINES[:2]))
    registry = Registry(spark)
    d = registry.get(str(tmp_path / "x.nt"))
    assert d is registry.get(str(tmp_path / "x.nt")) and d.quads.count() == 2
    write_quads(rail_in_graphs(spark), str(tmp_path / "quads"))
    back = Engine(read_quads(spark, str(tmp_path / "quads")))
    assert back.execute(f"SELECT * {{ GRAPH ?g {{ ?line <{ROOT}calls> ?stop }} }}").count() == len(LINES) + 2
    plan = back.execute(f"SELECT ?line {{ ?line <{ROOT}calls> ?stop }}")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pk" in plan


def test_virtual_statements_equal_written_ones(spark):
    """A query over the tables and over all their statements as rows gives the same."""
    tables = {n: RelationalDataset(spark, SF).tables[n] for n in ("region", "nation")}
    virtual = RelationalDataset(spark, SF, tables)
    from quadrille.sources.dataset import QuadDataset

    rows = Engine(QuadDataset(virtual.quads().cache()))
    for text in ("SELECT ?n ?r { ?x <http://data.local/nation#n_name> ?n ; <http://data.local/nation#ref_n_regionkey> ?g . ?g <http://data.local/region#r_name> ?r }",
                 "SELECT ?s ?t { GRAPH ?g { ?s a ?t } }", "SELECT ?p { <http://data.local/region/1> ?p ?o }"):
        a, b = Engine(virtual).terms(text), rows.terms(text)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count()


def test_repeated_keys_have_subjects_of_their_own(spark):
    d = RelationalDataset(spark, SF)
    df = Engine(d).execute("SELECT ?l { ?l <http://data.local/lineitem#l_quantity> ?q }")
    assert df.count() == df.distinct().count() == d.rows("lineitem")


def test_scan_reads_only_its_columns(spark):
    df = Engine(RelationalDataset(spark, SF)).execute("SELECT ?n { ?c <http://data.local/customer#c_name> ?n ; <http://data.local/customer#c_acctbal> ?b FILTER(?b > 9000) }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<c_name:string,c_acctbal:double>" in plan
    assert "GreaterThan(c_acctbal,9000.0)" in plan


def test_results_round_trip(spark):
    e = Engine(rail(spark))
    page = e.page(f"SELECT ?line (STRLEN(STR(?line)) AS ?n) {{ ?line <{ROOT}operator> ?firm }}", Budget(max_results=2))
    names, rows, more = from_json(to_json(page.names, page.rows, page))
    assert names == ["line", "n"] and rows == page.rows and more == page.next
    assert "metadata" not in json.loads(to_json(names, rows))
    assert json.loads(to_json(["x"], [{"x": 3}, {"x": None}, {"x": True}]))["results"]["bindings"][1] == {}


def test_endpoint(spark):
    e = Engine(rail(spark))
    server = serve({"pages": Endpoint(e, "pages", Budget(max_results=2)), "walks": Endpoint(e, "walks", attempts=20), "whole": Endpoint(e, "whole")}, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_address[1]}"

    def get(name, **args):
        return urllib.request.urlopen(f"{root}/{name}?{urllib.parse.urlencode(args)}").read().decode()

    text, rows = f"SELECT ?line ?stop {{ ?line <{ROOT}calls> ?stop }}", []
    while text:
        _, got, text = from_json(get("pages", query=text, limit=100))
        assert len(got) <= 2  # a request cannot raise the server's limit
        rows += got
    assert len(rows) == len(LINES)
    assert len(from_json(get("whole", query="SELECT * { ?s ?p ?o }"))[1]) == len(RAIL)
    assert len(from_json(get("walks", query="SELECT * { ?s ?p ?o }", attempts=7))[1]) == 7
    assert get("pages") == DESCRIPTION
    remote = Engine(rail_in_graphs(spark), Services({f"{root}/pages": RemoteService(spark, f"{root}/pages")}))
    far = remote.execute(f"SELECT * {{ GRAPH <{ROOT}companies> {{ ?line <{ROOT}operator> ?firm }} SERVICE <{root}/pages> {{ ?line <{ROOT}calls> ?stop }} }}")
    assert far.count() == len(LINES)  # over three pages of the server
    with pytest.raises(urllib.error.HTTPError):
        get("pages", query="SELECT")
    server.shutdown()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text(as_lines(OPERATORS[:2]))
    found = match_stream(read_stream(spark, str(tmp_path / "in")), f"SELECT ?line {{ ?line <{ROOT}operator> ?firm FILTER(?firm != <{ROOT}South>) }}")
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.nt").write_text(as_lines(OPERATORS[2:]))
    q.processAllAvailable()
    q.stop()
    assert {r["line"] for r in spark.sql("SELECT * FROM found").collect()} == {f"<{ROOT}{x}>" for x in ("L1", "L3", "L4")}
