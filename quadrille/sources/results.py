"""SPARQL results as JSON, with a metadata object that carries the continuation under ``next``."""

from __future__ import annotations

import datetime
import decimal
import json
from collections.abc import Callable, Iterable
from typing import Any

from quadrille.functions.terms import canonical_text, python_term
from quadrille.plans import algebra as A
from quadrille.plans.algebra import XSD

#: Writers of further metadata: name and function from a page to a JSON value, or None for nothing.
WRITERS: dict[str, Callable[[Any], Any]] = {"next": lambda page: page.next}


def term_of(value: Any) -> A.Term | None:
    """The term of a cell: canonical text stays what it spells, native values are typed literals."""
    match value:
        case None:
            return None
        case bool():
            return A.Literal("true" if value else "false", XSD + "boolean")
        case int():
            return A.Literal(str(value), XSD + "integer")
        case float():
            return A.Literal(repr(value), XSD + "double")
        case decimal.Decimal():
            return A.Literal(format(value.normalize(), "f"), XSD + "decimal")
        case datetime.datetime():
            return A.Literal(value.strftime("%Y-%m-%dT%H:%M:%S"), XSD + "dateTime")
    if value[:1] == "<" and value[-1:] == ">" or value[:2] == "_:" or value[:1] == '"' and value.rfind('"') > 0:
        return python_term(value)
    return A.Literal(value)


def _json_term(t: A.Term) -> dict[str, str]:
    match t:
        case A.Iri(v):
            return {"type": "uri", "value": v}
        case A.Blank(b):
            return {"type": "bnode", "value": b}
        case A.Literal(lex, dt, lang):
            return {"type": "literal", "value": lex} | ({"xml:lang": lang} if lang else {"datatype": dt} if dt else {})
    raise TypeError(t)


def to_json(names: list[str], rows: Iterable[dict], page: Any = None) -> str:
    """A results document; ``metadata`` holds what the registered writers give for ``page`` and is left out if empty."""
    bindings = [{n: _json_term(t) for n in names if (t := term_of(r.get(n))) is not None} for r in rows]
    out: dict[str, Any] = {"head": {"vars": names}, "results": {"bindings": bindings}}
    more = {k: v for k, write in WRITERS.items() if page is not None and (v := write(page)) is not None}
    return json.dumps(out | ({"metadata": more} if more else {}), ensure_ascii=False)


def from_json(text: str) -> tuple[list[str], list[dict[str, str]], str | None]:
    """Names, rows of canonical text, and the continuation of a results document."""
    doc = json.loads(text)
    rows = []
    for b in doc["results"]["bindings"]:
        row = {}
        for n, x in b.items():
            kinds = {"uri": lambda: A.Iri(x["value"]), "bnode": lambda: A.Blank(x["value"])}
            term = kinds.get(x["type"], lambda: A.Literal(x["value"], x.get("datatype"), x.get("xml:lang")))()
            row[n] = canonical_text(term)
        rows.append(row)
    return doc["head"]["vars"], rows, doc.get("metadata", {}).get("next")
