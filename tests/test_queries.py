"""Small queries over the railway, whole and by pages, against nested loops."""

import pytest

from quadrille.engine import Engine
from quadrille.operators import paging
from quadrille.operators.compiler import ServiceError, Services
from quadrille.operators.paging import Budget
from quadrille.plans.algebra import UnsupportedQuery
from quadrille.plans.parser import parse
from quadrille.sources.relational import Mapped, RelationalDataset
from tests.fixtures import GRAPHS, LINES, LITERALS, RAIL, ROOT, bag, canonical, rail, rail_in_graphs, rail_with_literals, short, solve, term

PREFIX = f"PREFIX : <{ROOT}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(rail(spark))


@pytest.fixture(scope="module")
def literals(spark):
    return Engine(rail_with_literals(spark))


@pytest.fixture(scope="module")
def quads(spark):
    return Engine(rail_in_graphs(spark))


def run(engine, text):
    return [tuple(short(r[n]) for n in r.__fields__) for r in engine.execute(PREFIX + text).collect()]


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


CALLS, OPERATED, PLACED = "?line :calls ?stop", "?line :operator ?firm", "?stop :region ?area"
loops = lambda *p: solve([x.replace(":", "") for x in p])


def optional(left, right, test=lambda b: True):
    """Each left solution with its matches, or alone."""
    out = []
    for b in left:
        more = [x for x in solve([right.replace(":", "")], start=[b]) if test(x)]
        out += more or [b]
    return out


JOINED = loops(OPERATED, CALLS, PLACED)
EVERY_LINE = loops(OPERATED)
CASES = {
    "one pattern": (f"SELECT ?line ?stop {{ {CALLS} }}", bag(loops(CALLS), "line", "stop")),
    "constant object": ("SELECT ?line { ?line :operator :North }", bag(loops("?line operator North"), "line")),
    "constant subject": ("SELECT ?stop { :L1 :calls ?stop }", bag(loops("L1 calls ?stop"), "stop")),
    "chain": (f"SELECT ?firm ?area {{ {OPERATED} . {CALLS} . {PLACED} }}", bag(JOINED, "firm", "area")),
    "self join": ("SELECT ?a ?b { ?a :calls ?s . ?b :calls ?s FILTER(?a != ?b) }",
                  [x for x in bag(loops("?a calls ?s", "?b calls ?s"), "a", "b") if x[0] != x[1]]),
    "variable predicate": ("SELECT ?p ?o { :L2 ?p ?o }", bag(solve(["L2 ?p ?o"]), "p", "o")),
    "one variable twice": ("SELECT ?x { ?x :calls ?x }", []),
    "nothing known": ("SELECT ?x { ?x :sells ?y }", []),
    "literal as predicate": ('SELECT ?x { ?x "3" ?y }', []),
    "not equal": (f"SELECT ?line {{ {OPERATED} FILTER(?firm != :North) }}", [(x["?line"],) for x in EVERY_LINE if x["?firm"] != "North"]),
    "one filter twice": (f"SELECT ?line {{ {OPERATED} FILTER(?firm != :North) FILTER(?firm != :North) }}",
                         [(x["?line"],) for x in EVERY_LINE if x["?firm"] != "North"]),
    "error in one arm": (f"SELECT ?line {{ {OPERATED} FILTER(?firm > 3 || ?line = :L4) }}", [("L4",)]),
    "union": ("SELECT ?x { { ?l :calls ?x } UNION { ?l :operator ?x } }", bag(loops("?l calls ?x"), "x") + bag(loops("?l operator ?x"), "x")),
    "optional": (f"SELECT ?line ?stop {{ {OPERATED} OPTIONAL {{ {CALLS} }} }}", bag(optional(EVERY_LINE, CALLS), "line", "stop")),
    "optional without matches": (f"SELECT ?line ?x {{ {OPERATED} OPTIONAL {{ ?line :sells ?x }} }}", [(x["?line"], None) for x in EVERY_LINE]),
    "optional with a condition": (f"SELECT ?line ?stop {{ {OPERATED} OPTIONAL {{ {CALLS} FILTER(?stop != :Birch && ?firm = :North) }} }}",
                                  bag(optional(EVERY_LINE, CALLS, lambda b: b["?stop"] != "Birch" and b["?firm"] == "North"), "line", "stop")),
    "optional in optional": (f"SELECT ?line ?area {{ {OPERATED} OPTIONAL {{ {CALLS} OPTIONAL {{ {PLACED} }} }} }}",
                             bag([y for x in optional(EVERY_LINE, CALLS) for y in (optional([x], PLACED) if "?stop" in x else [x])], "line", "area")),
    "optional of a union": (f"SELECT ?line ?stop ?firm {{ {CALLS} OPTIONAL {{ {{ {OPERATED} }} UNION {{ ?stop :region ?firm }} }} }}",
                            [(b["?line"], b["?stop"], f) for b in loops(CALLS)
                             for f in [x["?firm"] for x in solve(["?line operator ?firm"], start=[b])] + [x["?firm"] for x in solve(["?stop region ?firm"], start=[b])]]),
    "optional that may not bind": (f"SELECT ?line ?stop ?area {{ {OPERATED} OPTIONAL {{ {CALLS} }} ?stop :region ?area }}",
                                   [(b["?line"], x["?stop"], x["?area"]) for b in optional(EVERY_LINE, CALLS) for x in solve(["?stop region ?area"], start=[b])]),
    "minus": (f"SELECT ?line {{ {OPERATED} MINUS {{ {CALLS} }} }}", [("L4",)]),
    "minus what may be unbound": (f"SELECT ?line ?firm {{ {OPERATED} MINUS {{ {CALLS} OPTIONAL {{ ?line :calls :Elm . ?line :operator ?firm }} }} }}",
                                  [("L4", "East")]),
    "minus without a shared variable": (f"SELECT ?line {{ {OPERATED} MINUS {{ ?a :region ?b }} }}", bag(EVERY_LINE, "line")),
    "exists": (f"SELECT ?line {{ {OPERATED} FILTER EXISTS {{ ?line :calls :Birch }} }}", [("L1",), ("L2",)]),
    "not exists": (f"SELECT ?line {{ {OPERATED} FILTER NOT EXISTS {{ {CALLS} . {PLACED} }} }}", [("L4",)]),
    "exists in a union": (f"SELECT ?line {{ {OPERATED} FILTER EXISTS {{ {{ ?line :calls :Elm }} UNION {{ :L2 :operator ?firm }} }} }}", [("L2",), ("L3",)]),
    "minus a union": (f"SELECT ?line {{ {OPERATED} MINUS {{ {{ ?line :calls :Elm }} UNION {{ :L2 :operator ?firm }} }} }}", [("L1",), ("L4",)]),
    "values": (f"SELECT ?line ?stop {{ VALUES ?stop {{ :Birch :Elm :Nowhere }} {CALLS} }}",
               [x for x in bag(loops(CALLS), "line", "stop") if x[1] in ("Birch", "Elm")]),
    "values alone": ("SELECT ?x { VALUES ?x { :Nowhere } }", [("Nowhere",)]),
    "values undefined": ("SELECT ?x { VALUES ?x { UNDEF } }", [(None,)]),
    "values partly undefined": (f"SELECT ?line ?stop {{ VALUES (?line ?stop) {{ (:L1 UNDEF) (UNDEF :Birch) (:L9 :Elm) }} {CALLS} }}",
                                [(a, b) for a, b in bag(loops(CALLS), "line", "stop") if a == "L1"] + [(a, b) for a, b in bag(loops(CALLS), "line", "stop") if b == "Birch"]),
    "values as a product": (f"SELECT ?line ?v {{ VALUES ?v {{ 1 2 }} {OPERATED} }}",
                            [(x["?line"], f'"{v}"^^<http://www.w3.org/2001/XMLSchema#integer>') for x in EVERY_LINE for v in (1, 2)]),
    "bind": ("SELECT * { BIND(7 * 6 - 2 AS ?n) }", [("40",)]),
    "bind joined": ("SELECT ?stop { BIND(:L2 AS ?line) ?line :calls ?stop }", [("Birch",), ("Dogwood",)]),
    "length of text": (f"SELECT ?stop (strlen(str(?stop)) AS ?n) {{ :L1 :calls ?stop }}",
                       [(s, str(len(ROOT + s))) for s in ("Alder", "Birch", "Cedar")]),
    "distinct": (f"SELECT DISTINCT ?area {{ {PLACED} }}", [("Hills",), ("Valley",), ("Coast",)]),
    "descending": (f"SELECT ?line {{ {OPERATED} }} ORDER BY DESC(?firm) ?line LIMIT 3", [("L2",), ("L1",), ("L3",)]),
    "no limit": (f"SELECT ?line {{ {OPERATED} }} LIMIT 0", []),
    "limit past the end": (f"SELECT (COUNT(*) AS ?n) {{ {{ SELECT ?line {{ {OPERATED} }} LIMIT 50 }} }}", [("4",)]),
    "offset": (f"SELECT (COUNT(*) AS ?n) {{ {{ SELECT * {{ {CALLS} }} OFFSET 4 }} }}", [("2",)]),
    "offset in order": (f"SELECT ?line ?stop {{ {CALLS} }} OFFSET 4", sorted(bag(loops(CALLS), "line", "stop"))[4:]),
    "offset past the end": (f"SELECT ?line {{ {CALLS} }} OFFSET 40", []),
    "slice joined": (f"SELECT ?stop {{ :L3 :calls ?stop {{ SELECT ?stop {{ ?l :calls ?stop }} OFFSET 1 LIMIT 2 }} }}", []),
    "count": (f"SELECT (COUNT(*) * 2 AS ?n) {{ {CALLS} }}", [("12",)]),
    "count of nothing": ("SELECT (COUNT(*) AS ?n) { ?x :sells ?y }", [("0",)]),
    "count of all": ("SELECT (COUNT(*) AS ?n) { ?s ?p ?o }", [(str(len(RAIL)),)]),
    "count of what is bound": (f"SELECT (COUNT(?line) AS ?n) (COUNT(?stop) AS ?m) (COUNT(?never) AS ?k) {{ {OPERATED} OPTIONAL {{ {CALLS} }} }}", [("7", "6", "0")]),
    "count by key joined": (f"SELECT ?firm ?n {{ {OPERATED} {{ SELECT ?line (COUNT(*) AS ?n) {{ {CALLS} }} GROUP BY ?line }} }}", [("North", "3"), ("South", "2"), ("North", "1")]),
    "count as a product": (f"SELECT ?line ?n {{ {OPERATED} {{ SELECT (COUNT(*) AS ?n) {{ {PLACED} }} }} }}", [(x["?line"], "4") for x in EVERY_LINE]),
    "groups with an unbound key": (f"SELECT ?area (COUNT(*) AS ?n) {{ {CALLS} OPTIONAL {{ {PLACED} }} }} GROUP BY ?area", [("Hills", "1"), ("Valley", "3"), ("Coast", "1"), (None, "1")]),
}


@pytest.mark.parametrize("name", CASES)
def test_rail(engine, name):
    text, want = CASES[name]
    same(run(engine, text), want)


@pytest.mark.parametrize("text, want", [
    ("SELECT ?s { ?s :platforms ?n FILTER(?n >= 4) }", [("Birch",), ("Cedar",)]),
    ("SELECT ?s { ?s :platforms ?n FILTER(?n = 2.0) }", [("Alder",)]),
    ("SELECT ?s { ?s :platforms ?n FILTER(!isNumeric(?n)) }", [("Elm",)]),
    ("SELECT ?s { ?s :platforms ?n FILTER(?n > 5 || strlen(?n) = 3) }", [("Birch",), ("Elm",)]),
    ("SELECT (lang(?l) AS ?g) { :Birch :label ?l }", [("en",), ("fr",)]),
    ('SELECT (str(?l) AS ?t) { ?s :label ?l FILTER(langMatches(lang(?l), "FR")) }', [("Bouleau",)]),
    ('SELECT (COUNT(*) AS ?n) { ?s :label ?l FILTER(langMatches(lang(?l), "*")) }', [("2",)]),
    ("SELECT ?x { ?x :closed ?c FILTER(?c) }", [("L4",)]),
    ("SELECT (SUM(?n) AS ?s) (MAX(?n) AS ?m) { ?x :platforms ?n FILTER(isNumeric(?n)) }", [("12.0", '"6"^^<http://www.w3.org/2001/XMLSchema#integer>')]),
    ('SELECT ?s { VALUES ?n { 2 6 "few" "six" } ?s :platforms ?n }', [("Alder",), ("Birch",), ("Elm",)]),
    ("SELECT (COUNT(*) AS ?n) { ?s ?p ?o }", [(str(len(RAIL + LITERALS)),)]),
])
def test_literals(literals, text, want):
    same(run(literals, text), want)


def in_graphs(pattern, graphs=GRAPHS):
    return [(g, b) for g, rows in graphs.items() for b in solve([pattern], rows)]


def test_graphs(quads):
    count = lambda text: quads.execute(PREFIX + text).count()
    assert count("SELECT * { GRAPH ?g { ?line :calls ?stop } }") == len(in_graphs("?line calls ?stop"))
    assert count("SELECT * { GRAPH :survey { ?stop :region ?area } }") == 4
    assert count("SELECT * { ?stop :region ?area }") == len(in_graphs("?s region ?a"))  # a bag
    joined = [(g, h) for g, a in in_graphs("?line calls ?stop") for h, _ in [(h, b) for h, b in in_graphs("?stop region ?area") if b["?stop"] == a["?stop"]]]
    assert count("SELECT * { GRAPH ?g { ?line :calls ?stop } GRAPH ?h { ?stop :region ?area } }") == len(joined)
    assert count("SELECT * { GRAPH ?g { ?line :calls ?stop . ?stop :region ?area } }") == len([1 for g, h in joined if g == h])
    assert count("SELECT * { GRAPH ?g { ?line :operator ?f OPTIONAL { ?line :calls ?stop } } }") == 4


def test_default_graphs(spark):
    d = rail_in_graphs(spark)
    text = PREFIX + "SELECT * { ?stop :region ?area }"
    assert Engine(d, default_graphs=[ROOT + "companies"]).execute(text).count() == 2
    assert Engine(d, default_graphs=[ROOT + "companies", ROOT + "survey"]).execute(text).count() == 6
    other = Engine(d, default_graphs=[ROOT + "companies"]).execute(PREFIX + "SELECT * { GRAPH :timetable { ?line :calls ?stop } }")
    assert other.count() == len(LINES)


def test_services(spark):
    e = Engine(rail(spark), Services({"http://far.test": rail_in_graphs(spark), "http://mute.test": None}))
    assert e.execute("SELECT * { SERVICE <http://far.test> { GRAPH ?g { ?s ?p ?o } } }").count() == sum(map(len, GRAPHS.values()))
    rows = run(e, "SELECT ?g ?line { ?line :operator :South SERVICE <http://far.test> { GRAPH ?g { ?line :calls ?x } } }")
    same(rows, [("timetable", "L2"), ("timetable", "L2")])
    assert e.execute("SELECT * { SERVICE SILENT <http://mute.test> { ?s ?p ?o } }").count() == 0
    with pytest.raises(ServiceError):
        e.execute("SELECT * { SERVICE <http://mute.test> { ?s ?p ?o } }")


PAGED = [
    f"SELECT ?line ?stop {{ {CALLS} }}",
    f"SELECT ?firm ?stop ?area {{ {OPERATED} . {CALLS} . {PLACED} }}",
    f"SELECT ?line ?stop {{ {OPERATED} OPTIONAL {{ {CALLS} }} }}",
    "SELECT ?x { { ?l :calls ?x FILTER(?x != :Cedar) } UNION { ?l :operator ?x } }",
    f"SELECT ?line ?v {{ VALUES ?v {{ :a :b }} {OPERATED} }}",
    f"SELECT (COUNT(*) + 1 AS ?n) {{ {OPERATED} . {CALLS} }}",
    f"SELECT DISTINCT ?area {{ {PLACED} }}",
    f"SELECT ?line {{ {OPERATED} FILTER NOT EXISTS {{ {CALLS} }} }}",
    f"SELECT ?line ?n {{ {CALLS} BIND(strlen(str(?stop)) AS ?n) FILTER(?n > {len(ROOT) + 4}) }}",
]


@pytest.mark.parametrize("text", PAGED)
@pytest.mark.parametrize("budget", [Budget(max_results=1), Budget(max_scans=3), Budget(max_results=2, max_scans=3), Budget(timeout=0.001)])
def test_pages_give_the_whole(engine, text, budget):
    rows, _ = engine.run_to_completion(PREFIX + text, budget)
    assert canonical(rows) == canonical(r.asDict() for r in engine.terms(PREFIX + text).collect())


def test_pages_of_repeated_statements(quads):
    text = PREFIX + "SELECT ?line ?area { ?line :calls ?stop . ?stop :region ?area }"
    rows, n = quads.run_to_completion(text, Budget(max_results=3))
    want = canonical(r.asDict() for r in quads.terms(text).collect())
    assert canonical(rows) == want and len(rows) == len(want) > 6 and n >= 2


@pytest.mark.parametrize("text", PAGED + [f"SELECT ?line ?stop {{ {{ SELECT ?line ?stop {{ {CALLS} }} OFFSET 1 }} }}"])
def test_pages_in_a_row(spark, engine, text):
    """Pages asked for together are those asked for one by one, and each one's continuation gives, on its own, all after it."""
    pages = engine.pages(PREFIX + text, Budget(max_results=2), 50)
    whole = [r.asDict() for r in engine.terms(PREFIX + text).collect()]
    assert canonical(r for p in pages for r in p.rows) == canonical(whole) and len(pages) == max(1, -(-len(whole) // 2))
    for n, p in enumerate(pages[:-1], 1):
        other = Engine(rail(spark))  # which has seen no page yet
        assert canonical(r.asDict() for r in other.terms(p.next).collect()) == canonical(r for q in pages[n:] for r in q.rows)
    assert pages[-1].next is None


def test_pages_in_a_row_of_repeated_statements(spark, quads):
    text = PREFIX + "SELECT ?line ?area { ?line :calls ?stop . ?stop :region ?area }"
    pages = quads.pages(text, Budget(max_results=1), 50)
    whole = canonical(r.asDict() for r in quads.terms(text).collect())
    assert canonical(r for p in pages for r in p.rows) == whole and len(pages) == len(whole)
    for n, p in enumerate(pages[:-1], 1):
        rest = [r.asDict() for r in Engine(rail_in_graphs(spark)).terms(p.next).collect()]
        assert canonical(rest) == canonical(r for q in pages[n:] for r in q.rows)


def test_a_run_asks_for_pages_together(engine, monkeypatch):
    """And goes on by the last one's continuation, whose offset is one, however often it was cut."""
    asked, given = [], []
    inner = engine.pages
    monkeypatch.setattr(engine, "pages", lambda text, *a: asked.append(text) or given.append(inner(text, *a)) or given[-1])
    monkeypatch.setattr("quadrille.engine.AHEAD", 2)
    rows, n = engine.run_to_completion(f"{PREFIX} SELECT ?line ?stop {{ {CALLS} }}", Budget(max_results=1))
    assert n == 5 and len(rows) == 6 and len(asked) == 4 and all(text.count("OFFSET") == 1 for text in asked[1:])
    assert all(len(p.rows) == 1 for some in given for p in some)


def test_number_of_pages(engine):
    """One result a page: one continuation less than there are results."""
    assert engine.run_to_completion(f"{PREFIX} SELECT * {{ {OPERATED} }}", Budget(max_results=1))[1] == 3
    assert engine.run_to_completion(f"{PREFIX} SELECT * {{ ?line :operator :North . {CALLS} }}", Budget(max_results=1))[1] == 3


def test_page_is_within_budget_and_next_parses(engine):
    page = engine.page(f"{PREFIX} SELECT ?line ?stop {{ {OPERATED} OPTIONAL {{ {CALLS} }} }}", Budget(max_results=3))
    assert len(page.rows) == 3 and parse(page.next).names == ["line", "stop"] and page.progress == pytest.approx(1 / 2)  # L4 of East and the first of North


def test_pages_of_a_service(spark):
    e = Engine(rail(spark), Services({"http://far.test": rail_in_graphs(spark)}))
    text = PREFIX + "SELECT ?line ?g { ?line :operator :North SERVICE <http://far.test> { GRAPH ?g { ?line :calls ?x } } }"
    rows, n = e.run_to_completion(text, Budget(max_results=2))
    assert canonical(rows) == canonical(r.asDict() for r in e.terms(text).collect()) and len(rows) == 6 and n == 2


def exchanges(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_continuations_have_no_single_task(engine):
    """What comes after an offset is filtered, not counted off in one task."""
    page = engine.page(f"{PREFIX} SELECT ?line ?stop {{ {OPERATED} . {CALLS} }}", Budget(max_results=2))
    for text in (page.next, f"{PREFIX} SELECT ?line ?stop {{ {CALLS} }} OFFSET 3"):
        assert "SinglePartition" not in exchanges(engine.execute(text))


@pytest.mark.parametrize("name", ["optional of a union", "minus what may be unbound", "minus a union", "exists in a union", "values partly undefined"])
def test_unbound_sides_join_on_keys(engine, name):
    text = CASES[name][0]
    assert "NestedLoop" not in exchanges(engine.execute(PREFIX + text))


def test_budgets():
    assert Budget(10, None, 5).lowered(Budget(3, 7, 60)) == Budget(3, 7, 5)
    with pytest.raises(ValueError):
        Budget(max_results=0)


@pytest.mark.parametrize("text", ["ASK { ?s ?p ?o }", "SELECT * { ?s <http://a>/<http://b> ?o }", "SELECT (NOSUCH(?s) AS ?x) { ?s ?p ?o }"])
def test_unsupported(engine, text):
    with pytest.raises(UnsupportedQuery):
        engine.execute(text)


def test_terms_are_canonical(engine):
    assert {r["line"] for r in engine.terms(f"{PREFIX} SELECT ?line {{ ?line :operator :East }}").collect()} == {term("L4")}


ORDERS = [(1, 5.0), (2, 20.0), (3, 30.0), (3, 30.0), (4, 40.0), (5, 50.0)]
ITEMS = [(1, 1, 7), (2, 1, 7), (2, 2, 7), (2, 2, 7), (2, 2, 8), (3, 1, 7), (3, 2, 7), (5, 1, 7), (5, 1, 7), (5, 2, 9)]
BOUGHT = """PREFIX orders: <http://data.local/orders#> PREFIX lineitem: <http://data.local/lineitem#>
    SELECT ?o ?k { ?o orders:o_totalprice ?p FILTER(?p > 10) ?l lineitem:ref_l_orderkey ?o ; lineitem:l_linenumber ?k }"""


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Orders and their items, some rows twice."""
    path = str(tmp_path_factory.mktemp("shop"))
    spark.createDataFrame(ORDERS, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(ITEMS, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    tables = {"orders": Mapped(("o_orderkey",)), "lineitem": Mapped(("l_orderkey", "l_linenumber"), {"l_orderkey": "orders"}, True)}
    return lambda: Engine(RelationalDataset(spark, path, tables))


@pytest.mark.parametrize("small", [True, False])
def test_pages_of_tables_with_rows_twice(shop, monkeypatch, small):
    """As many solutions as the tables' rows have, by one page after the other and by what each continuation gives alone."""
    if not small:
        monkeypatch.setattr(paging, "SMALL", 0)
        monkeypatch.setattr(paging, "SMALL_PAGES", 0)
    want = canonical({"o": f"<http://data.local/orders/{o}>", "k": f'"{k}"^^<http://www.w3.org/2001/XMLSchema#integer>'}
                     for o, p in ORDERS if p > 10 for x, k, _ in ITEMS if x == o)
    rows, _ = shop().run_to_completion(BOUGHT, Budget(max_results=2))
    assert canonical(rows) == want
    pages = shop().pages(BOUGHT, Budget(max_results=1), 50)
    assert len(pages) == len(want)
    for n in (1, 3, 5, 8):
        rest = [r.asDict() for r in shop().terms(pages[n - 1].next).collect()]
        assert canonical(rest) == canonical(r for p in pages[n:] for r in p.rows)


def test_pages_read_a_table_once(shop, monkeypatch):
    """Patterns on one row are one step, and the outermost matches go to the later steps' scans, not these to them."""
    monkeypatch.setattr(paging, "SMALL", 0)
    monkeypatch.setattr(paging, "SMALL_PAGES", 0)
    plans, ordered = [], paging._ordered
    monkeypatch.setattr(paging, "_ordered", lambda frames, *a: plans.extend(map(exchanges, frames)) or ordered(frames, *a))
    assert len(shop().page(BOUGHT, Budget(max_results=2)).rows) == 2
    for plan in plans:
        assert plan.count("lineitem.parquet") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
