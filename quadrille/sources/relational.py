"""Parquet tables seen as statements, without writing any: a virtual dataset.

Row k of table t is the subject ``<BASE t/k>``.  A column c is the predicate ``<BASE t#c>`` with the value as a literal
of its native type; a foreign key also is ``<BASE t#ref_c>`` to the row it refers to; rdf:type is ``<BASE T>``, the table
capitalised; the graph is ``<BASE graph/t>``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators import relation as R
from quadrille.operators.relation import Relation
from quadrille.plans import algebra as A
from quadrille.sources.dataset import Dataset

BASE = "http://data.local/"
_TYPES = {"int": "integer", "bigint": "integer", "smallint": "integer", "double": "double", "float": "double",
          "string": "string", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}


@dataclass(frozen=True)
class Mapped:
    """A table's key columns, and its foreign keys by column.  ``numbered``: the key repeats, so a hash of the rest of the row follows it."""

    keys: tuple[str, ...]
    refs: dict[str, str] = field(default_factory=dict)
    numbered: bool = False


TABLES = {
    "region": Mapped(("r_regionkey",)),
    "nation": Mapped(("n_nationkey",), {"n_regionkey": "region"}),
    "customer": Mapped(("c_custkey",), {"c_nationkey": "nation"}),
    "supplier": Mapped(("s_suppkey",), {"s_nationkey": "nation"}),
    "part": Mapped(("p_partkey",)),
    "orders": Mapped(("o_orderkey",), {"o_custkey": "customer"}),
    "lineitem": Mapped(("l_orderkey", "l_linenumber"), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, True),
    "events": Mapped(("event_id",)),
    "documents": Mapped(("doc_id",)),
    "labels": Mapped(("doc_id",), {"doc_id": "documents"}),
    "pages": Mapped(("page_id",)),
    "benchmark": Mapped(("item_id",)),
    "conversations": Mapped(("conv_id", "turn")),
}


class RelationalDataset(Dataset):
    """Tables under ``path`` as statements.  Patterns with one subject and table are one scan of the columns they name."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Mapped] = TABLES, base: str = BASE):
        self.spark, self.path, self.tables, self.base = spark, path, tables, base
        self._frames: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    # -- tables

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._frames[name]

    def rows(self, name: str) -> int:
        if name not in self._rows:
            self._rows[name] = self.frame(name).count()
        return self._rows[name]

    def subject(self, name: str) -> tuple[Column, T.Form]:
        m = self.tables[name]
        form = T.Form("iri", f"{self.base}{name}/")
        if len(m.keys) == 1:
            return F.col(m.keys[0]), form
        parts = [F.col(k).cast("string") for k in m.keys]
        if m.numbered:
            # a hash of the rest of the row tells rows of one key apart, without looking at any other row
            others = [c for c in self.frame(name).columns if c not in m.keys]
            parts.append(F.lower(F.hex(F.xxhash64(*others))))
        return F.concat_ws("/", *parts), form

    def objects(self, name: str) -> dict[str, tuple[str | None, T.Form]]:
        """Column and form by predicate; no column for rdf:type."""
        out: dict[str, tuple[str | None, T.Form]] = {}
        for c, kind in self.frame(name).dtypes:
            if kind in _TYPES:
                out[f"{self.base}{name}#{c}"] = (c, T.literal(_TYPES[kind]))
        for c, target in self.tables[name].refs.items():
            if len(self.tables[target].keys) == 1:
                out[f"{self.base}{name}#ref_{c}"] = (c, T.Form("iri", f"{self.base}{target}/"))
        out[A.RDF_TYPE] = (None, T.TERM)
        return out

    def _candidates(self, p: A.Pattern) -> list[str]:
        """Tables that the constants of a pattern leave."""
        names = list(self.tables)
        if isinstance(p.g, (A.Iri, A.Literal, A.Blank)):
            names = [n for n in names if p.g == A.Iri(f"{self.base}graph/{n}")]
        if isinstance(p.s, A.Iri):
            names = [n for n in names if p.s.value.startswith(f"{self.base}{n}/")]
        elif not isinstance(p.s, A.Var):
            return []
        if isinstance(p.p, A.Iri):
            if p.p.value == A.RDF_TYPE:
                if isinstance(p.o, A.Iri):
                    names = [n for n in names if p.o.value == self._class(n)]
                return names
            names = [n for n in names if p.p.value.startswith(f"{self.base}{n}#") and p.p.value in self.objects(n)]
        elif not isinstance(p.p, A.Var):
            return []
        return names

    def _class(self, name: str) -> str:
        return self.base + name.capitalize()

    # -- scans

    def bgp(self, patterns: tuple[A.Pattern, ...]) -> Relation:
        """Stars first: a maximal run of patterns on one subject variable whose predicates fix one table is one scan."""
        parts = [self._star(k[1], ps) if len(k) == 3 else self.scan(ps[0]) for k, ps in self._stars(patterns).items()]
        return reduce(R.join, parts) if parts else R.unit(self.spark)

    def stars(self, patterns: tuple[A.Pattern, ...]) -> list[tuple[A.Pattern, ...]]:
        return [tuple(ps) for ps in self._stars(patterns).values()]

    def _stars(self, patterns: tuple[A.Pattern, ...]) -> dict[tuple, list[A.Pattern]]:
        """By subject, table and graph, or by the place of a pattern that is no part of a star; in the order of the first."""
        stars: dict[tuple, list[A.Pattern]] = {}
        for i, p in enumerate(patterns):
            names = self._candidates(p)
            fixed = isinstance(p.p, A.Iri) and isinstance(p.s, A.Var) and len(names) == 1
            key = (p.s.name, names[0], p.g) if fixed else (i,)
            stars.setdefault(key, []).append(p)
        return stars

    def scan(self, pattern: A.Pattern) -> Relation:
        parts = []
        for name in self._candidates(pattern):
            if isinstance(pattern.p, A.Iri):
                parts.append(self._star(name, [pattern]))
            else:
                parts.append(self._any_predicate(name, pattern))
        if parts:
            return reduce(R.union, parts)
        names = sorted(A.visible(pattern))
        schema = ", ".join(f"`{R.physical(n)}` string" for n in names)
        empty = self.spark.createDataFrame([], schema) if names else self.spark.range(0).select()
        return Relation(empty, {n: T.TERM for n in names}, set(names))

    def _star(self, name: str, patterns: list[A.Pattern]) -> Relation:
        df, objects = self.frame(name), self.objects(name)
        subject, subject_form = self.subject(name)
        bound: dict[str, tuple[Column, T.Form]] = {}

        def bind(t, c: Column, form: T.Form) -> Column | None:
            """Test that position column ``c`` meets term ``t``, binding it if it is a new variable."""
            if isinstance(t, A.Var):
                if t.name not in bound:
                    bound[t.name] = (c, form)
                    return None
                other, its = bound[t.name]
                return other == c if its == form else T.canonical(other, its) == T.canonical(c, form)
            return _equals(c, form, t)

        tests, seen = [], set()
        for p in patterns:
            column, form = objects[p.p.value]
            if column is None:
                tests.append(bind(p.o, F.lit(f"<{self._class(name)}>"), T.TERM))
            else:
                if column not in seen:
                    seen.add(column)
                    tests.append(F.col(column).isNotNull())
                tests.append(bind(p.o, F.col(column), form))
            tests.append(bind(p.s, subject, subject_form) if p is patterns[0] or not isinstance(p.s, A.Var) else None)
            if p.g is not None:
                tests.append(bind(p.g, F.lit(f"<{self.base}graph/{name}>"), T.TERM))
        for t in tests:
            df = df if t is None else df.filter(t)
        return Relation(df.select(*[c.alias(R.physical(n)) for n, (c, _) in bound.items()]), {n: f for n, (_, f) in bound.items()}, set(bound))

    def _any_predicate(self, name: str, p: A.Pattern) -> Relation:
        """Every predicate of the table from one scan, each row once a predicate.

        Rows are multiplied by a number alone, and what a statement says is looked up by it, so that text which nobody
        asks for is never built.
        """
        subject, form = self.subject(name)
        objects = list(self.objects(name).items())
        at = F.col("`at:`")

        def by_number(values: list[Column]) -> Column:
            out = F.when(at == 0, values[0])
            for i, v in enumerate(values[1:], 1):
                out = out.when(at == i, v)
            return out

        there = by_number([F.lit(True) if c is None else F.col(c).isNotNull() for _, (c, _) in objects])
        says = by_number([F.lit(f"<{self._class(name)}>") if c is None else T.canonical(F.col(c), f) for _, (c, f) in objects])
        rows = self.frame(name).withColumn("s:key", T.canonical(subject, form))
        rows = rows.withColumn("at:", F.explode(F.lit(list(range(len(objects)))))).filter(there)
        df = rows.select(F.lit(f"<{self.base}graph/{name}>").alias("g"), F.col("`s:key`").alias("s"),
                         by_number([F.lit(f"<{k}>") for k, _ in objects]).alias("p"), says.alias("o"))
        from quadrille.sources.dataset import QuadDataset

        return QuadDataset(df).scan(p)

    def count(self, pattern: A.Pattern) -> DataFrame | None:
        """For a pattern of different variables alone: values that are there, by table and column, and a type for each row."""
        terms = [t for _, t in pattern.parts() if t is not None]
        if not all(isinstance(t, A.Var) for t in terms) or len({t.name for t in terms}) < len(terms):
            return None
        counts = []
        for name in self.tables:
            columns = [c for c, _ in self.objects(name).values()]
            here = [F.count(F.lit(1)) if c is None else F.count(F.col(c)) for c in columns]
            counts.append(self.frame(name).agg(reduce(lambda x, y: x + y, here).alias("n")))
        return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("n"))

    def quads(self) -> DataFrame:
        """Every statement as a row, for export and sampling."""
        whole = A.Pattern(A.Var("s"), A.Var("p"), A.Var("o"), A.Var("g"))
        return self.scan(whole).df.select(*[R.col(n).alias(n) for n in ("g", "s", "p", "o")])

    def cardinalities(self, patterns: list[A.Pattern]) -> list[int]:
        """Rows of the tables a pattern may read, times predicates where that is free; 1 for a constant subject.

        A constant object counts as a tenth: table counts come from file footers, and no scan is spent on planning.
        """
        out = []
        for p in patterns:
            n = 0
            for name in self._candidates(p):
                each = 1 if isinstance(p.s, A.Iri) else self.rows(name)
                each *= 1 if isinstance(p.p, A.Iri) else len(self.objects(name))
                n += each if isinstance(p.o, A.Var) or isinstance(p.p, A.Iri) and p.p.value == A.RDF_TYPE else -(-each // 10)
            out.append(n)
        return out


def _equals(c: Column, form: T.Form, t: A.Term) -> Column:
    """Whether a native column holds the constant term, by comparing natively so that the test reaches the scan."""
    if form.kind == "iri":
        if not isinstance(t, A.Iri) or not t.value.startswith(form.prefix):
            return F.lit(False)
        key = t.value.removeprefix(form.prefix)
        return c == int(key) if key.isdigit() and str(int(key)) == key else c.cast("string") == key
    if form.kind == "literal" and isinstance(t, A.Literal) and t.lang is None:
        if form.datatype == "string":
            return c == t.lex if t.datatype is None else F.lit(False)
        if t.datatype != A.XSD + form.datatype:
            return F.lit(False)
        if form.datatype == "integer" and t.lex.lstrip("-").isdigit():
            return c == int(t.lex)
    return T.canonical(c, form) == T.canonical_text(t)
