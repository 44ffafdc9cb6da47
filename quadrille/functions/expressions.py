"""SPARQL expressions as columns; an error is null, and null in a filter is false."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.plans import algebra as A
from quadrille.plans.algebra import XSD, UnsupportedQuery

#: Functions registered by IRI: from columns of lexical text to a column.
REGISTERED: dict[str, Callable[..., Column]] = {}


def register_function(iri: str, function: Callable[..., Column]) -> None:
    """Makes ``<iri>(...)`` callable; it gets the arguments' lexical text as columns and returns a string column."""
    REGISTERED[iri] = function


@dataclass(frozen=True)
class Value:
    """A column with what is known of its terms: integer, decimal, double, string, boolean, dateTime, iri or term."""

    kind: str
    col: Column

    @property
    def numeric(self) -> bool:
        return self.kind in ("integer", "decimal", "double")


Env = dict[str, tuple[Column, T.Form]]


def of_column(c: Column, form: T.Form) -> Value:
    if form.kind == "iri":
        return Value("iri", F.concat(F.lit(form.prefix), c.cast("string")))
    return Value(form.datatype if form.kind == "literal" else "term", c)


def of_term(t: A.Term) -> Value:
    match t:
        case A.Iri(v):
            return Value("iri", F.lit(v))
        case A.Literal(lex, None, None):
            return Value("string", F.lit(lex))
        case A.Literal(lex, dt, None) if dt and dt.startswith(XSD):
            name = dt.removeprefix(XSD)
            try:
                if name in ("integer", "int", "long"):
                    return Value("integer", F.lit(int(lex)).cast("long" if abs(int(lex)) < 2**63 else "decimal(38,0)"))
                if name == "decimal":
                    return Value("decimal", F.lit(lex).try_cast("decimal(38,18)"))
                if name in ("double", "float"):
                    return Value("double", F.lit(float(lex)))
                if name == "boolean":
                    return Value("boolean", F.lit(lex in ("true", "1")))
                if name == "dateTime":
                    return Value("dateTime", F.lit(lex).try_cast("timestamp"))
            except ValueError:
                pass
    return Value("term", F.lit(T.canonical_text(t)))


def form_of(v: Value) -> tuple[Column, T.Form]:
    """Column and form by which a value is kept under a variable."""
    if v.kind == "iri":
        return F.concat(F.lit("<"), v.col, F.lit(">")), T.TERM
    if v.kind == "term":
        return v.col, T.TERM
    return v.col, T.literal(v.kind)


def canonical(v: Value) -> Column:
    c, form = form_of(v)
    return T.canonical(c, form)


def text(v: Value) -> Column:
    """STR: the lexical form or the IRI's text."""
    if v.kind == "term":
        return T.lexical(v.col)
    if v.kind == "dateTime":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    return v.col if v.kind in ("string", "iri") else v.col.cast("string")


def _string(v: Value) -> Column:
    """Text of a string literal, plain or with a language; null for others."""
    if v.kind == "term":
        plain = T.is_literal(v.col) & ~v.col.endswith(">")
        return F.when(plain, T.lexical(v.col))
    return v.col if v.kind == "string" else F.lit(None).cast("string")


def _number(v: Value) -> Column:
    if v.numeric:
        return v.col
    return T.number(v.col) if v.kind == "term" else F.lit(None).cast("double")


def ebv(v: Value) -> Column:
    """Effective boolean value."""
    if v.kind == "boolean":
        return v.col
    if v.numeric:
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == "string":
        return v.col != ""
    if v.kind == "term":
        flag = F.when(v.col == f'"true"^^<{XSD}boolean>', True).when(v.col == f'"false"^^<{XSD}boolean>', False)
        return F.coalesce(flag, T.number(v.col) != 0, F.length(_string(v)) > 0)
    return F.lit(None).cast("boolean")


def _instant(v: Value) -> Column:
    if v.kind == "dateTime":
        return v.col
    return F.when(T.datatype(v.col).isin(XSD + "dateTime", XSD + "date"), T.lexical(v.col).try_cast("timestamp")) if v.kind == "term" else F.lit(None).cast("timestamp")


def _compare(op: str, a: Value, b: Value) -> Column:
    tests = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y,
             "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    test = tests[op]
    if a.numeric and b.numeric or a.kind == b.kind and a.kind != "term":
        if a.kind == "iri" and op not in ("=", "!="):
            return F.lit(None).cast("boolean")
        return test(a.col, b.col)
    kinds = {a.kind, b.kind}
    if "term" not in kinds:
        if "iri" in kinds and op in ("=", "!="):
            return F.lit(op == "!=")
        return F.lit(None).cast("boolean")
    if a.numeric or b.numeric:
        value = test(_number(a), _number(b))
        other = a.col if a.kind == "term" else b.col
        no_literal = F.when(~T.is_literal(other), F.lit(op == "!="))
        return F.coalesce(value, no_literal) if op in ("=", "!=") else value
    if "dateTime" in kinds:
        return test(_instant(a), _instant(b))
    if "boolean" in kinds:
        return test(ebv(a), ebv(b))
    ca, cb = canonical(a), canonical(b)
    both = test(_number(a), _number(b)) if kinds == {"term"} else F.lit(None).cast("boolean")
    if op in ("=", "!="):
        return F.coalesce(both, test(ca, cb))
    dates = test(_instant(a), _instant(b)) if kinds == {"term"} else F.lit(None).cast("boolean")
    return F.coalesce(both, dates, test(_string(a), _string(b)))


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    kinds = {k if k in ("integer", "decimal") else "double" for k in (a.kind, b.kind)}
    x, y = _number(a), _number(b)
    if op == "/":
        if kinds <= {"integer", "decimal"}:
            return Value("decimal", F.try_divide(x.cast("decimal(38,18)"), y.cast("decimal(38,18)")))
        return Value("double", F.try_divide(x.cast("double"), y.cast("double")))
    kind = "double" if "double" in kinds else "decimal" if "decimal" in kinds else "integer"
    sql = {"double": "double", "decimal": "decimal(38,18)", "integer": "long"}[kind]
    x, y = x.cast(sql), y.cast(sql)
    return Value(kind, {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y))


def _keep_number(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    def run(v: Value) -> Value:
        kind = v.kind if v.numeric else "double"
        sql = {"double": "double", "decimal": "decimal(38,18)", "integer": "long"}[kind]
        return Value(kind, f(_number(v)).cast(sql))

    return run


def _same_language(v: Value, c: Column) -> Value:
    """A string function's result keeps its first argument's language."""
    if v.kind != "term":
        return Value("string", c)
    lang = T.language(v.col)
    return Value("term", F.concat(F.lit('"'), T.escaped(c), F.lit('"'), F.when(lang != "", F.concat(F.lit("@"), lang)).otherwise(F.lit(""))))


def _literal(text_: Column, tail: Column) -> Value:
    return Value("term", F.concat(F.lit('"'), T.escaped(text_), F.lit('"'), tail))


def _flags(pattern: Value, flags: Value | None, call: A.Call, at: int) -> Column:
    given = call.args[at].lex if len(call.args) > at and isinstance(call.args[at], A.Literal) else ""
    inline = "".join(f for f in given if f in "ismx")
    p = _string(pattern)
    return F.concat(F.lit(f"(?{inline})"), p) if inline else p


def _cast(name: str, v: Value) -> Value | None:
    c = text(v)
    match name:
        case "string":
            return Value("string", c)
        case "integer" | "int" | "long":
            whole = F.when(v.col.cast("boolean"), 1).otherwise(0).cast("long") if v.kind == "boolean" else (
                F.expr("bigint(null)") if v.kind == "iri" else c.try_cast("decimal(38,18)").cast("long") if not v.numeric else v.col.try_cast("long"))
            return Value("integer", whole)
        case "decimal":
            return Value("decimal", c.try_cast("decimal(38,18)"))
        case "double" | "float":
            return Value("double", c.try_cast("double"))
        case "boolean":
            return Value("boolean", (v.col != 0) if v.numeric else F.when(c.isin("true", "1"), True).when(c.isin("false", "0"), False))
        case "dateTime":
            return Value("dateTime", c.try_cast("timestamp"))
    return None


def evaluate(e: A.Expr, env: Env) -> Value:
    """The value of an expression over the columns of ``env``; an unbound variable is null."""
    match e:
        case A.Var(n):
            return of_column(*env[n]) if n in env else Value("term", F.lit(None).cast("string"))
        case A.Iri() | A.Literal():
            return of_term(e)
        case A.Exists():
            raise UnsupportedQuery("EXISTS inside an expression")
        case A.Aggregate(name):
            raise UnsupportedQuery(f"{name} outside of a grouped SELECT")
        case A.Call("BOUND", (A.Var(n),)):
            return Value("boolean", env[n][0].isNotNull() if n in env else F.lit(False))
        case A.Call(name, args):
            return _call(name, [evaluate(a, env) for a in args], e)
    raise UnsupportedQuery(str(e))


def _merge(values: list[Value]) -> tuple[str, list[Column]]:
    """One kind for alternatives: their own if it is the same, else canonical terms."""
    kinds = {v.kind for v in values}
    if len(kinds) == 1:
        return values[0].kind, [v.col for v in values]
    return "term", [canonical(v) for v in values]


def _call(name: str, v: list[Value], e: A.Call) -> Value:
    boolean = lambda c: Value("boolean", c)
    string = lambda c: Value("string", c)
    integer = lambda c: Value("integer", c.cast("long"))
    if name in ("=", "!=", "<", ">", "<=", ">="):
        return boolean(_compare(name, *v))
    if name in ("+", "-", "*", "/"):
        return _arithmetic(name, *v)
    if name.startswith(XSD) and (cast := _cast(name.removeprefix(XSD), v[0])):
        return cast
    if name in REGISTERED:
        return string(REGISTERED[name](*map(text, v)))
    match name:
        case "!":
            return boolean(~ebv(v[0]))
        case "&&":
            return boolean(ebv(v[0]) & ebv(v[1]))
        case "||":
            return boolean(ebv(v[0]) | ebv(v[1]))
        case "NEG":
            return _arithmetic("-", Value("integer", F.lit(0)), v[0])
        case "IN":
            tests = [_compare("=", v[0], x) for x in v[1:]]
            out = F.lit(False)
            for t in tests:
                out = out | t
            return boolean(out)
        case "IF":
            kind, cols = _merge(v[1:])
            test = ebv(v[0])
            return Value(kind, F.when(test, cols[0]).when(~test, cols[1]))
        case "COALESCE":
            kind, cols = _merge(v)
            return Value(kind, F.coalesce(*cols))
        case "SAMETERM":
            return boolean(canonical(v[0]) == canonical(v[1]))
        case "ABS":
            return _keep_number(F.abs)(v[0])
        case "CEIL":
            return _keep_number(F.ceil)(v[0])
        case "FLOOR":
            return _keep_number(F.floor)(v[0])
        case "ROUND":  # halves go up
            return _keep_number(lambda c: F.floor(c + F.lit(0.5)))(v[0])
        case "RAND":
            return Value("double", F.rand())
        case "STR":
            return string(text(v[0]))
        case "STRLEN":
            return integer(F.length(_string(v[0])))
        case "SUBSTR":
            n = v[2].col.cast("int") if len(v) > 2 else F.length(_string(v[0]))
            return _same_language(v[0], F.substring(_string(v[0]), v[1].col.cast("int"), n))
        case "UCASE":
            return _same_language(v[0], F.upper(_string(v[0])))
        case "LCASE":
            return _same_language(v[0], F.lower(_string(v[0])))
        case "STRSTARTS":
            return boolean(F.startswith(_string(v[0]), _string(v[1])))
        case "STRENDS":
            return boolean(F.endswith(_string(v[0]), _string(v[1])))
        case "CONTAINS":
            return boolean(F.contains(_string(v[0]), _string(v[1])))
        case "STRBEFORE" | "STRAFTER":
            s, part = _string(v[0]), _string(v[1])
            at = F.position(part, s)
            cut = F.substring(s, F.lit(1), at - 1) if name == "STRBEFORE" else F.substring(s, at + F.length(part), F.length(s))
            return _same_language(v[0], F.when(at == 0, F.lit("")).otherwise(cut))
        case "CONCAT":
            return string(F.concat(*map(_string, v)) if v else F.lit(""))
        case "ENCODE_FOR_URI":
            return string(F.replace(F.replace(F.replace(F.url_encode(_string(v[0])), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))
        case "LANGMATCHES":
            tag, want = F.lower(text(v[0])), F.lower(text(v[1]))
            return boolean(F.when(want == "*", tag != "").otherwise((tag == want) | F.startswith(tag, F.concat(want, F.lit("-")))))
        case "REGEX":
            return boolean(F.regexp_like(_string(v[0]), _flags(v[1], v[2] if len(v) > 2 else None, e, 2)))
        case "REPLACE":
            return _same_language(v[0], F.regexp_replace(_string(v[0]), _flags(v[1], None, e, 3), _string(v[2])))
        case "LANG":
            if v[0].kind == "term":
                return string(T.language(v[0].col))
            return string(F.when(v[0].col.isNotNull() & F.lit(v[0].kind != "iri"), F.lit("")))
        case "DATATYPE":
            if v[0].kind == "term":
                return Value("iri", T.datatype(v[0].col))
            return Value("iri", F.when(v[0].col.isNotNull() & F.lit(v[0].kind != "iri"), F.lit(XSD + v[0].kind)))
        case "ISIRI" | "ISURI":
            return boolean(T.is_iri(v[0].col) if v[0].kind == "term" else F.when(v[0].col.isNotNull(), F.lit(v[0].kind == "iri")))
        case "ISBLANK":
            return boolean(T.is_blank(v[0].col) if v[0].kind == "term" else F.when(v[0].col.isNotNull(), F.lit(False)))
        case "ISLITERAL":
            return boolean(T.is_literal(v[0].col) if v[0].kind == "term" else F.when(v[0].col.isNotNull(), F.lit(v[0].kind != "iri")))
        case "ISNUMERIC":
            return boolean(F.when(v[0].col.isNotNull(), _number(v[0]).isNotNull()))
        case "IRI" | "URI":
            return Value("iri", text(v[0]))
        case "BNODE":
            return Value("term", F.concat(F.lit("_:"), text(v[0])) if v else F.concat(F.lit("_:"), F.uuid()))
        case "STRDT":
            return _literal(_string(v[0]), F.concat(F.lit("^^<"), text(v[1]), F.lit(">")))
        case "STRLANG":
            return _literal(_string(v[0]), F.concat(F.lit("@"), F.lower(_string(v[1]))))
        case "UUID":
            return Value("iri", F.concat(F.lit("urn:uuid:"), F.uuid()))
        case "STRUUID":
            return string(F.uuid())
        case "NOW":
            return Value("dateTime", F.current_timestamp())
        case "YEAR" | "MONTH" | "DAY" | "HOURS" | "MINUTES":
            part = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute}[name]
            return integer(part(_instant(v[0])))
        case "SECONDS":
            return Value("decimal", F.date_part(F.lit("SECOND"), _instant(v[0])).cast("decimal(38,18)"))
        case "TZ":
            return string(F.regexp_extract(text(v[0]), r"(Z|[+-]\d{2}:\d{2})$", 1))
        case "TIMEZONE":
            z = F.regexp_extract(text(v[0]), r"(Z|[+-]\d{2}:\d{2})$", 1)
            sign, hours, minutes = F.when(F.startswith(z, F.lit("-")), "-").otherwise(""), F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
            body = F.concat(sign, F.lit("PT"), hours.cast("string"), F.lit("H"), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.lit("")))
            full = F.when(z == "Z", F.lit("PT0S")).when(z != "", F.when((hours == 0) & (minutes == 0), F.lit("PT0S")).otherwise(body))
            return Value("term", F.concat(F.lit('"'), full, F.lit(f'"^^<{XSD}dayTimeDuration>')))
        case "MD5" | "SHA1":
            return string({"MD5": F.md5, "SHA1": F.sha1}[name](_string(v[0]).cast("binary")))
        case "SHA256" | "SHA384" | "SHA512":
            return string(F.sha2(_string(v[0]).cast("binary"), int(name[3:])))
    raise UnsupportedQuery(f"function {name}")
