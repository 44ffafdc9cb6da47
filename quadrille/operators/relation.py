"""Solutions as a DataFrame: a column a variable, with the form of its terms, and joins by SPARQL compatibility."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.functions.expressions import Env


def physical(name: str) -> str:
    """Column name of a variable; Spark's are blind to case, variables are not."""
    ups = [str(i) for i, ch in enumerate(name) if ch.isupper()]
    return "v:" + name.lower() + ("~" + "_".join(ups) if ups else "")


def col(name: str) -> Column:
    return F.col(f"`{physical(name)}`")


@dataclass
class Relation:
    """``df`` has a column for each variable in ``forms``; those in ``certain`` are never null.

    ``extra`` names further columns, such as ranks, that joins carry along.  ``inline`` are the names and rows of terms
    of a relation that is inline data and nothing else.  ``parts`` are relations that it is the union of, where they are
    known: each may be certain of variables that the whole is not.
    """

    df: DataFrame
    forms: dict[str, T.Form]
    certain: set[str]
    extra: list[str] = field(default_factory=list)
    inline: tuple[tuple[str, ...], tuple] | None = None
    parts: list[Relation] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def vars(self) -> set[str]:
        return set(self.forms)

    def env(self) -> Env:
        return {n: (col(n), f) for n, f in self.forms.items()}

    def canonical(self, name: str) -> Column:
        return T.canonical(col(name), self.forms[name])

    def order(self, names: list[str] | None = None) -> list[Column]:
        """A total order of distinct solutions, the same whatever the forms."""
        return [self.canonical(n).asc_nulls_first() for n in sorted(self.forms if names is None else names)]

    def as_terms(self, names: set[str]) -> Relation:
        """With canonical text for the named variables."""
        names = {n for n in names if self.forms[n] != T.TERM}
        if not names:
            return self
        df = self.df.withColumns({physical(n): self.canonical(n) for n in names})
        return Relation(df, self.forms | {n: T.TERM for n in names}, self.certain, self.extra)

    def keep(self, names: set[str]) -> Relation:
        names = names & self.vars
        df = self.df.select(*[col(n) for n in sorted(names)], *[F.col(f"`{x}`") for x in self.extra])
        return Relation(df, {n: self.forms[n] for n in names}, self.certain & names, self.extra)

    def filter(self, condition: Column) -> Relation:
        return Relation(self.df.filter(condition), self.forms, self.certain, self.extra)


def unit(spark: SparkSession) -> Relation:
    return Relation(spark.range(1).select(), {}, set())


#: Up to so many different values of inline data become a test that reaches the scans.
PUSHED_VALUES = 1_000

#: Up to so many rows of inline data are held by every task of a join, whose size Spark could not tell.
HELD_VALUES = 100_000


def inlined(spark: SparkSession, names: tuple[str, ...], rows: tuple, forms: dict[str, T.Form], certain: set[str]) -> Relation:
    """Inline data with each variable in its form; a row with a term that a form cannot spell is left out."""
    data = []
    for r in rows:
        values = [None if t is None else T.native(t, forms[n]) for n, t in zip(names, r)]
        if all(t is None or v is not None for t, v in zip(r, values)):
            data.append(tuple(values))
    schema = ", ".join(f"`{physical(n)}` {T.sql_type(forms[n])}" for n in names)
    df = spark.createDataFrame(data, schema)
    return Relation(F.broadcast(df) if len(data) <= HELD_VALUES else df, forms, certain, [], (names, rows))


def met(a: Relation, b: Relation) -> Relation:
    """Inline data ``a``, as it has to be spelled to meet ``b`` natively; rows that cannot meet it are left out."""
    names, rows = a.inline
    types = dict(b.df.dtypes)
    forms = dict(a.forms)
    for n in names:
        if n in b.certain and a.forms[n] == T.TERM and b.forms[n] != T.TERM:
            kind, held = T.sql_type(b.forms[n]), types[physical(n)]
            if kind == held or kind == "long" and held in ("bigint", "int", "smallint"):
                forms[n] = b.forms[n]
    return a if forms == a.forms else inlined(a.spark, names, rows, forms, a.certain)


def _pushed(b: Relation, a: Relation) -> Relation:
    """``b`` with the values that inline data ``a`` allows as tests of their own, which Catalyst takes to the scans."""
    names, rows = a.inline
    for at, n in enumerate(names):
        if n in b.certain and n in a.certain and b.forms[n] == a.forms[n]:
            values = {T.native(r[at], a.forms[n]) for r in rows} - {None}
            if len(values) <= PUSHED_VALUES:
                b = b.filter(col(n).isin(*sorted(values, key=str)))
    return b


def aligned(a: Relation, b: Relation, names: set[str]) -> tuple[Relation, Relation]:
    """Both with one form for each of ``names``: their own where it is the same, so that native keys join natively."""
    differ = {n for n in names if a.forms[n] != b.forms[n]}
    return a.as_terms(differ), b.as_terms(differ)


def _renamed(b: Relation, shared: set[str]) -> tuple[DataFrame, dict[str, Column]]:
    df = b.df.withColumnsRenamed({physical(n): "r:" + physical(n) for n in shared})
    return df, {n: F.col(f"`r:{physical(n)}`") for n in shared}


def _all(conditions: list[Column]) -> Column | None:
    return reduce(lambda x, y: x & y, conditions) if conditions else None


def _merged(df: DataFrame, a: Relation, b: Relation, shared: set[str], right: dict[str, Column], inner: bool) -> Relation:
    fill = {physical(n): F.coalesce(col(n), right[n]) for n in shared if n not in a.certain}
    df = (df.withColumns(fill) if fill else df).drop(*["r:" + physical(n) for n in shared])
    return Relation(df, b.forms | a.forms, a.certain | (b.certain if inner else set()), a.extra + b.extra)


def _split(r: Relation, name: str) -> tuple[Relation, Relation]:
    """Solutions that bind ``name``, and those that do not, without its column."""
    bound = Relation(r.df.filter(col(name).isNotNull()), r.forms, r.certain | {name}, r.extra)
    free = r.filter(col(name).isNull()).keep(r.vars - {name})
    return bound, free


def union(a: Relation, b: Relation) -> Relation:
    """Bag union; a variable of one side is unbound in the other's solutions."""
    a, b = aligned(a, b, a.vars & b.vars)
    df = a.df.unionByName(b.df, allowMissingColumns=True)
    parts = (a.parts or [a]) + (b.parts or [b])
    return Relation(df, b.forms | a.forms, a.certain & b.certain, a.extra, None, [] if a.extra or b.extra else parts)


def _parts(r: Relation, shared: set[str]) -> list[Relation]:
    """Relations that ``r`` is the union of and that are certain of more of the shared variables, or [] if it is of all.

    The parts that it was made of, where they are known, and else the solutions that bind a variable and the others.
    """
    unsure = sorted((shared & r.vars) - r.certain)
    if not unsure:
        return []
    if r.inline:
        names, rows = r.inline
        kinds: dict[tuple, list] = {}
        for row in rows:
            kinds.setdefault(tuple(n for n, t in zip(names, row) if t is not None), []).append(tuple(t for t in row if t is not None))
        return [inlined(r.spark, k, tuple(v), {n: r.forms[n] for n in k}, set(k)) for k, v in kinds.items() if k] + [
            Relation(r.spark.range(len(v)).select(), {}, set()) for k, v in kinds.items() if not k]
    return r.parts if len(r.parts) > 1 else list(_split(r, unsure[0]))


def join(a: Relation, b: Relation) -> Relation:
    """Every pair of compatible solutions.

    Variables that either side may leave unbound split that side into the solutions that bind them and the rest, so
    that all joins stay joins on keys.  Inline data is spelled as the other side is, and tests its scans.
    """
    if a.inline and not b.inline:
        native = met(a, b)
        return _joined(native, _pushed(b, native)).as_terms(a.vars)
    if b.inline and not a.inline:
        native = met(b, a)
        return _joined(_pushed(a, native), native).as_terms(b.vars)
    return _joined(a, b)


def _joined(a: Relation, b: Relation) -> Relation:
    if parts := _parts(a, b.vars):
        return reduce(union, [join(p, b) for p in parts])
    if parts := _parts(b, a.vars):
        return reduce(union, [join(a, p) for p in parts])
    a, b = aligned(a, b, a.vars & b.vars)
    shared = a.vars & b.vars
    df, right = _renamed(b, shared)
    on = _all([col(n) == right[n] for n in sorted(shared)])
    joined = a.df.crossJoin(df) if on is None else a.df.join(df, on, "inner")
    return _merged(joined, a, b, shared, right, True)


def _on(shared: set[str], right: dict[str, Column]) -> list[Column]:
    return [col(n) == right[n] for n in sorted(shared)]


def left_join(a: Relation, b: Relation, condition=None) -> Relation:
    """Solutions of ``a`` extended by each compatible one of ``b`` for which ``condition(env)`` holds, or else alone.

    Where ``b`` may leave a shared variable unbound, the matches are those of :func:`join`, which joins on keys, and
    the rest those of :func:`semi_join`.
    """
    if parts := _parts(a, b.vars):
        return _as(reduce(union, [left_join(p, b, condition) for p in parts]), a, b.extra)
    if not a.vars & b.vars <= b.certain:
        found = join(a, b)
        found = found if condition is None else found.filter(condition(found.env()))
        return _as(union(found, semi_join(a, b, True, condition)), a, b.extra)
    a, b = aligned(a, b, a.vars & b.vars)
    shared = a.vars & b.vars
    df, right = _renamed(b, shared)
    tests = _on(shared, right)
    if condition is not None:
        tests.append(condition({**b.env(), **a.env()}))
    joined = a.df.join(df, _all(tests) if tests else F.lit(True), "left")
    return _merged(joined, a, b, shared, right, False)


def semi_join(a: Relation, b: Relation, anti: bool = False, condition=None) -> Relation:
    """Solutions of ``a`` with (or, ``anti``, without) a compatible one of ``b`` for which ``condition(env)`` holds.

    Sides that may leave a shared variable unbound are split, so that every join has keys: anti joins follow each
    other, and a semi join adds to one part's what the other part finds among the rest.
    """
    if parts := _parts(a, b.vars):
        return _as(reduce(union, [semi_join(p, b, anti, condition) for p in parts]), a)
    if parts := _parts(b, a.vars):
        found, rest = [], a
        for p in parts:
            found.append(semi_join(rest, p, False, condition))
            rest = semi_join(rest, p, True, condition)
        return rest if anti else _as(reduce(union, found), a)
    a, b = aligned(a, b, a.vars & b.vars)
    shared = a.vars & b.vars
    df, right = _renamed(b, shared)
    tests = _on(shared, right)
    if condition is not None:
        tests.append(condition({**b.env(), **a.env()}))
    elif not tests:
        df = df.limit(1)  # any solution at all will do
    on = _all(tests) if tests else F.lit(True)
    return Relation(a.df.join(df, on, "left_anti" if anti else "left_semi"), a.forms, a.certain, a.extra)


def _as(out: Relation, a: Relation, more: list[str] | None = None) -> Relation:
    return Relation(out.df, out.forms, a.certain, a.extra + (more or []), None, out.parts)


def minus(a: Relation, b: Relation) -> Relation:
    """Solutions of ``a`` without a compatible one of ``b`` that shares a bound variable; by anti joins on keys."""
    if not a.vars & b.vars:
        return a
    if parts := _parts(a, b.vars):
        return _as(reduce(union, [minus(p, b) for p in parts]), a)
    if parts := _parts(b, a.vars):
        return reduce(minus, parts, a)
    a, b = aligned(a, b, a.vars & b.vars)
    shared = a.vars & b.vars
    df, right = _renamed(b, shared)
    return Relation(a.df.join(df, _all(_on(shared, right)), "left_anti"), a.forms, a.certain, a.extra)
