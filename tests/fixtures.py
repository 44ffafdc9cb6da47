"""A small railway as statements: lines, their stops, operators and regions, with gaps, several values and literals."""

from quadrille.functions.terms import canonical_text
from quadrille.plans.algebra import Iri
from quadrille.sources.dataset import QuadDataset, from_lines

ROOT = "http://rail.test/"
XSD = "http://www.w3.org/2001/XMLSchema#"

#: (subject, predicate, object) of names; an object that begins with a quote is written out.
LINES = [("L1", "calls", s) for s in ("Alder", "Birch", "Cedar")] + [("L2", "calls", s) for s in ("Birch", "Dogwood")] + [("L3", "calls", "Elm")]
OPERATORS = [("L1", "operator", "North"), ("L2", "operator", "South"), ("L3", "operator", "North"), ("L4", "operator", "East")]
REGIONS = [("Alder", "region", "Hills"), ("Birch", "region", "Valley"), ("Cedar", "region", "Valley"), ("Elm", "region", "Coast")]
RAIL = LINES + OPERATORS + REGIONS
LITERALS = [
    ("Alder", "platforms", f'"2"^^<{XSD}integer>'), ("Birch", "platforms", f'"6"^^<{XSD}integer>'), ("Cedar", "platforms", f'"4"^^<{XSD}integer>'),
    ("Birch", "label", '"Birch"@en'), ("Birch", "label", '"Bouleau"@fr'), ("L4", "closed", f'"true"^^<{XSD}boolean>'), ("Elm", "platforms", '"few"'),
]
#: Statements by named graph; the last repeats some of the others'.
GRAPHS = {"timetable": LINES, "companies": OPERATORS + REGIONS[:2], "survey": REGIONS + LINES[:2]}


def iri(name: str) -> str:
    return f"<{ROOT}{name}>"


def as_lines(rows, graph: str | None = None) -> str:
    """N-Triples, or N-Quads in ``graph``."""
    end = f" {iri(graph)} ." if graph else " ."
    return "\n".join(f"{iri(s)} {iri(p)} {o if o[0] == '"' else iri(o)}{end}" for s, p, o in rows)


def dataset(spark, text: str, is_set: bool = True) -> QuadDataset:
    """Held in memory, as tests ask it often."""
    d = from_lines(spark, text)
    d.quads = d.quads.coalesce(1).cache()
    d.is_set = is_set
    return d


def rail(spark) -> QuadDataset:
    return dataset(spark, as_lines(RAIL))


def rail_with_literals(spark) -> QuadDataset:
    return dataset(spark, as_lines(RAIL + LITERALS))


def rail_in_graphs(spark) -> QuadDataset:
    """The default graph is the merge of all, which repeats statements."""
    return dataset(spark, "\n".join(as_lines(rows, g) for g, rows in GRAPHS.items()), is_set=False)


def canonical(rows) -> list[str]:
    return sorted(str(sorted((k, v) for k, v in r.items() if v is not None)) for r in rows)


def short(value):
    """A canonical term of the railway as its name, other values as text."""
    if value is None:
        return None
    text = str(value)
    return text[1:-1].removeprefix(ROOT) if text.startswith("<") else text


def solve(patterns, rows=RAIL, start=({},)) -> list[dict]:
    """Solutions of patterns of names and ?variables by nested loops: what the engine is held against."""
    out = [dict(x) for x in start]
    for pattern in patterns:
        found = []
        for b in out:
            for row in rows:
                new = dict(b)
                if all(new.setdefault(t, v) == v if t[0] == "?" else t == v for t, v in zip(pattern.split(), row)):
                    found.append(new)
        out = found
    return out


def bag(solutions, *names) -> list[tuple]:
    return [tuple(b.get("?" + n) for n in names) for b in solutions]


def term(name: str) -> str:
    return canonical_text(Iri(ROOT + name))
