"""RDF terms in columns: how a variable's column spells its terms, and the canonical text of a term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.plans.algebra import XSD, Blank, Iri, Literal, Term

NUMERIC = ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")


@dataclass(frozen=True)
class Form:
    """``term``: canonical text of any term.  ``iri``: ``prefix`` and the column's value.  ``literal``: a native value.

    ``datatype`` of a literal is the name of its XSD type: string, integer, decimal, double, boolean or dateTime.
    """

    kind: str
    prefix: str = ""
    datatype: str = ""


TERM = Form("term")


def literal(datatype: str) -> Form:
    return Form("literal", datatype=datatype)


def escape(s: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = s.replace(a, b)
    return s


def canonical_text(t: Term) -> str:
    """The one spelling by which equal terms are equal strings."""
    match t:
        case Iri(v):
            return f"<{v}>"
        case Blank(b):
            return f"_:{b}"
        case Literal(lex, dt, lang):
            return f'"{escape(lex)}"' + (f"@{lang.lower()}" if lang else f"^^<{dt}>" if dt and dt != XSD + "string" else "")
    raise TypeError(t)


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Holds the place of an escaped backslash while other escapes are undone.
_HOLD = "\ue000"


def unescaped(c: Column) -> Column:
    """Inverse of :func:`escaped`."""
    c = F.replace(c, F.lit("\\\\"), F.lit(_HOLD))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(c, F.lit(_HOLD), F.lit("\\"))


def canonical(c: Column, form: Form) -> Column:
    if form.kind == "term":
        return c
    if form.kind == "iri":
        return F.concat(F.lit("<" + form.prefix), c.cast("string"), F.lit(">"))
    if form.datatype == "string":
        return F.concat(F.lit('"'), escaped(c), F.lit('"'))
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if form.datatype == "dateTime" else c.cast("string")
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{form.datatype}>'))


def sql_type(form: Form) -> str:
    """Type of the columns of inline data in this form; empty where inline data stays text."""
    if form.kind == "iri":
        return "long" if form.prefix else "string"
    return {"string": "string", "integer": "long", "boolean": "boolean"}.get(form.datatype, "") if form.kind == "literal" else "string"


def native(t: Term, form: Form):
    """The value that spells a term in a form; None if there is none, so that no value of the form equals the term."""
    if form.kind == "term":
        return canonical_text(t)
    if form.kind == "iri":
        key = t.value.removeprefix(form.prefix) if isinstance(t, Iri) and t.value.startswith(form.prefix) else ""
        return int(key) if key.isdigit() and str(int(key)) == key and int(key) < 1 << 63 else None
    if not isinstance(t, Literal) or t.lang or (t.datatype or XSD + "string") != XSD + form.datatype:
        return None
    if form.datatype == "string":
        return t.lex
    if form.datatype == "boolean":
        return {"true": True, "false": False}.get(t.lex)
    return int(t.lex) if canonical_integer(t.lex) else None


def canonical_integer(lex: str) -> bool:
    return lex.lstrip("-").isdigit() and str(int(lex)) == lex and abs(int(lex)) < 1 << 63


def is_iri(c: Column) -> Column:
    return c.startswith("<")


def is_blank(c: Column) -> Column:
    return c.startswith("_:")


def is_literal(c: Column) -> Column:
    return c.startswith('"')


_LITERAL = r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$'


def lexical(c: Column) -> Column:
    """Lexical form of a literal, text of an IRI; null for a blank node."""
    return F.when(is_literal(c), unescaped(F.regexp_extract(c, _LITERAL, 1))).when(is_iri(c), F.substring(c, F.lit(2), F.length(c) - 2))


def language(c: Column) -> Column:
    return F.when(is_literal(c), F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1))


def datatype(c: Column) -> Column:
    """IRI text of a literal's datatype."""
    given = F.regexp_extract(c, r'"\^\^<([^>]*)>$', 1)
    return F.when(is_literal(c), F.when(given != "", given).when(language(c) != "", F.lit(
        "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).otherwise(F.lit(XSD + "string")))


def number(c: Column) -> Column:
    """Value of a numeric literal, null for anything else."""
    typed = F.regexp_extract(c, rf'^"([^"]*)"\^\^<{XSD}(?:{"|".join(NUMERIC)})>$', 1)
    return F.when(typed != "", typed.try_cast("double"))


def python_term(text: str | None) -> Term | None:
    """A term from its canonical text."""
    import re

    if text is None:
        return None
    if text[0] == "<":
        return Iri(text[1:-1])
    if text[:2] == "_:":
        return Blank(text[2:])
    m = re.match(r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$', text)
    lex = re.sub(r'\\(["\\nrt])', lambda x: {"n": "\n", "r": "\r", "t": "\t"}.get(x[1], x[1]), m[1])
    return Literal(lex, m[3], m[2])
