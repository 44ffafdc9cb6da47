"""The algebra as DataFrames: one relation a node, lazily, for Catalyst to plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import expressions as E
from quadrille.functions import terms as T
from quadrille.operators import relation as R
from quadrille.operators.relation import Relation, physical
from quadrille.plans import algebra as A
from quadrille.plans.algebra import UnsupportedQuery
from quadrille.sources.dataset import Dataset


class ServiceError(RuntimeError):
    pass


@dataclass
class Services:
    """Endpoints by IRI: datasets, or functions from a service's algebra to a relation; None does not answer."""

    by_name: dict[str, Dataset | Callable[[Any], Relation] | None] = field(default_factory=dict)

    def answer(self, name: str, op: Any) -> Relation:
        target = self.by_name.get(name)
        if target is None:
            raise ServiceError(f"no service at {name}")
        return Compiler(target, self).compile(op) if isinstance(target, Dataset) else target(op)


class Compiler:
    def __init__(self, dataset: Dataset, services: Services | None = None):
        self.dataset, self.services = dataset, services or Services()
        self.spark = dataset.spark

    def compile(self, op: Any) -> Relation:
        match op:
            case A.Pattern():
                return self.dataset.scan(op)
            case A.Bgp(patterns):
                return self.dataset.bgp(patterns)
            case A.Join(a, b):
                if isinstance(b, A.Service) and isinstance(b.name, A.Var):
                    return self._service(b, self.compile(a))
                return R.join(self.compile(a), self.compile(b))
            case A.LeftJoin(a, b, c):
                condition = None if c is None else lambda env: E.ebv(E.evaluate(c, env))
                return R.left_join(self.compile(a), self.compile(b), condition)
            case A.Union(a, b):
                return R.union(self.compile(a), self.compile(b))
            case A.Minus(a, b):
                return R.minus(self.compile(a), self.compile(b))
            case A.Filter(conditions, c):
                return self._filter(conditions, self.compile(c))
            case A.Extend(v, e, c):
                return extend(self.compile(c), v, e)
            case A.Table(names, rows):
                return self.table(names, rows)
            case A.Group():
                return self._group(op)
            case A.OrderBy(by, c):
                rel = self.compile(c)
                return Relation(rel.df.orderBy(*sort_keys(rel, by)), rel.forms, rel.certain, rel.extra)
            case A.Project(names, c):
                return project(self.compile(c), names)
            case A.Distinct(c, _):
                rel = self.compile(c)
                return Relation(rel.df.distinct(), rel.forms, rel.certain)
            case A.Slice(offset, limit, c):
                return self._slice(offset, limit, c)
            case A.Service():
                return self._service(op, None)
        raise UnsupportedQuery(type(op).__name__)

    def table(self, names: tuple[str, ...], rows: tuple) -> Relation:
        """Inline data; it is query text, so its size is the query's."""
        if not names:
            return Relation(self.spark.range(len(rows)).select(), {}, set())
        return R.inlined(self.spark, tuple(names), tuple(rows), {n: T.TERM for n in names}, A.certain(A.Table(names, rows)))

    def _filter(self, conditions: tuple, rel: Relation) -> Relation:
        for c in conditions:
            negated = isinstance(c, A.Call) and c.name == "!" and isinstance(c.args[0], A.Exists)
            if isinstance(c, A.Exists) or negated:
                inner = c.args[0] if negated else c
                rel = self._exists(rel, inner.pattern, inner.negated != negated)
            else:
                # null, an error, is not true; left bare so that Catalyst can push the test into the scan
                rel = rel.filter(E.ebv(E.evaluate(c, rel.env())))
        return rel

    def _exists(self, rel: Relation, pattern: Any, negated: bool) -> Relation:
        """Semi or anti join; conditions at the top of the pattern see the outer solution's variables too."""
        conditions: tuple = ()
        while isinstance(pattern, A.Filter) and not any(isinstance(c, A.Exists) for c in pattern.conditions):
            conditions, pattern = conditions + pattern.conditions, pattern.child

        def test(env: E.Env) -> Column:
            out = F.lit(True)
            for c in conditions:
                out = out & E.ebv(E.evaluate(c, env))
            return out

        return R.semi_join(rel, self.compile(pattern), negated, test if conditions else None)

    def _group(self, op: A.Group) -> Relation:
        counted = None
        if not op.keys and isinstance(op.child, A.Bgp) and len(op.child.patterns) == 1 and all(
                a.name == "COUNT" and a.arg is None and not a.distinct for _, a in op.aggregates):
            counted = self.dataset.count(op.child.patterns[0])
        if counted is not None:
            df = counted.select(*[F.col("n").alias(physical(n)) for n, _ in op.aggregates])
            return Relation(df, {n: T.literal("integer") for n, _ in op.aggregates}, {n for n, _ in op.aggregates})
        rel = self.compile(op.child)
        for name, e in op.keys:
            if e is not None:
                rel = extend(rel, name, e)
            elif name not in rel.vars:
                rel = extend(rel, name, A.Var(name))
        keys = [k for k, _ in op.keys]
        built = {name: aggregate(a, rel) for name, a in op.aggregates}
        columns = [c.alias(physical(n)) for n, (c, _) in built.items()] or [F.count(F.lit(1)).alias("n:rows")]
        df = rel.df.groupBy(*[R.col(k) for k in keys]).agg(*columns)
        forms = {k: rel.forms[k] for k in keys} | {n: f for n, (_, f) in built.items()}
        return Relation(df.drop("n:rows"), forms, A.certain(op) & set(forms))

    def _slice(self, offset: int, limit: int | None, child: Any) -> Relation:
        """Deterministic: by ORDER BY first, then by all variables, so that pages of a query fit together."""
        rel = self.compile(child)
        by, inner = [], child
        while isinstance(inner, (A.Project, A.Distinct)):
            inner = inner.child
        if isinstance(inner, A.OrderBy):
            if isinstance(child, A.Project) and not set().union(*[A.expression_vars(e) for e, _ in inner.by]) <= rel.vars:
                # a sort key that is projected away must still order the page
                rel = self.compile(inner)
                by = sort_keys(rel, inner.by)
            else:
                by = sort_keys(rel, inner.by)
        if offset and limit is None and rel.forms and not by:
            df = after(rel, offset, self.dataset.marks, (child, offset))
        else:
            df = rel.df.orderBy(*by, *rel.order()) if rel.forms else rel.df
            df = df.offset(offset) if offset else df
            df = df if limit is None else df.limit(limit)
        out = Relation(df, rel.forms, rel.certain)
        return project(out, child.vars) if isinstance(child, A.Project) else out

    def _service(self, op: A.Service, left: Relation | None) -> Relation:
        names = [op.name] if isinstance(op.name, A.Iri) else [A.Iri(n) for n in sorted(self.services.by_name)]
        out = None
        for n in names:
            try:
                rel = self.services.answer(n.value, op.child)
            except Exception:
                if not op.silent:
                    raise
                continue
            if isinstance(op.name, A.Var):
                rel = extend(rel, op.name.name, n)
            out = rel if out is None else R.union(out, rel)
        if out is None:
            names_ = tuple(sorted(A.visible(op)))
            out = self.table(names_, ())
        return out if left is None else R.join(left, out)


#: Solutions that one task ranks at once to find where an offset ends.
RANKED = 500_000


def after(rel: Relation, offset: int, known: dict, op: Any) -> DataFrame:
    """All solutions but the first ``offset`` in the order of all variables, without a total order of them.

    The last solution to skip is found by top-k jobs of up to ``RANKED`` rows, one row of each of which comes to the
    driver; ``known`` remembers it for ``op``.  What follows it in the order passes a test, and of its equals, solutions
    of a bag, the rest are kept.
    """
    df = rel.df.withColumn("k:", F.array(*[rel.canonical(n) for n in sorted(rel.forms)]))
    key = F.col("`k:`")
    literal = lambda k: F.array(*[F.lit(x).cast("string") for x in k])
    if op not in known:
        mark, left = None, offset
        while left > 0:
            head = (df if mark is None else df.filter(key > literal(mark))).select("k:").orderBy("k:").limit(min(left, RANKED))
            last = head.agg(F.max(key).alias("k"), F.count(F.lit(1)).alias("n")).first()
            if last["k"] is None:
                mark, more = None, 0
                break
            mark = last["k"]
            equal = key.eqNullSafe(literal(mark))
            skipped, every = head.filter(equal).count(), df.filter(equal).count()
            left -= last["n"]
            more = min(left, every - skipped)  # equals of the mark that were not ranked are next
            left, more = left - more, every - skipped - more
        known[op] = mark, more
    mark, more = known[op]
    if mark is None:
        return rel.df.limit(0)
    later = df.filter(key > literal(mark))
    return (later.unionByName(df.filter(key.eqNullSafe(literal(mark))).limit(more)) if more else later).drop("k:")


def extend(rel: Relation, name: str, e: Any) -> Relation:
    c, form = E.form_of(E.evaluate(e, rel.env()))
    if isinstance(e, A.Var) and e.name in rel.vars:
        c, form = R.col(e.name), rel.forms[e.name]
    sure = isinstance(e, (A.Iri, A.Literal)) or isinstance(e, A.Var) and e.name in rel.certain
    return Relation(rel.df.withColumn(physical(name), c), rel.forms | {name: form}, rel.certain | ({name} if sure else set()), rel.extra)


def project(rel: Relation, names: tuple[str, ...]) -> Relation:
    """The named variables; one that is never bound is a null column."""
    missing = [n for n in names if n not in rel.vars]
    cols = [R.col(n) if n in rel.vars else F.lit(None).cast("string").alias(physical(n)) for n in dict.fromkeys(names)]
    df = rel.df.select(*cols, *[F.col(f"`{x}`") for x in rel.extra])
    forms = {n: rel.forms.get(n, T.TERM) for n in names}
    return Relation(df, forms, rel.certain & set(names) - set(missing), rel.extra)


def sort_keys(rel: Relation, by: tuple) -> list[Column]:
    """Unbound first, then by number where there is one, then by text, as the orders of SPARQL's terms go."""
    out = []
    for e, down in by:
        v = E.evaluate(e, rel.env())
        parts = [v.col] if v.kind != "term" else [T.number(v.col), v.col]
        out += [p.desc_nulls_last() if down else p.asc_nulls_first() for p in parts]
    return out


def aggregate(a: A.Aggregate, rel: Relation) -> tuple[Column, T.Form]:
    if a.arg is None:
        whole = F.struct(*[rel.canonical(n) for n in sorted(rel.vars)]) if rel.vars else F.lit(1)
        return (F.count_distinct(whole) if a.distinct else F.count(F.lit(1))), T.literal("integer")
    v = E.evaluate(a.arg, rel.env())
    c, form = E.form_of(v)
    if a.name == "COUNT":
        return (F.count_distinct(c) if a.distinct else F.count(c)), T.literal("integer")
    if a.name in ("SUM", "AVG"):
        kind = v.kind if v.numeric else "double"
        n = v.col if v.numeric else T.number(v.col) if v.kind == "term" else F.lit(None).cast("double")
        if a.name == "SUM":
            total = F.sum_distinct(n) if a.distinct else F.sum(n)
            return F.coalesce(total.cast({"integer": "long", "decimal": "decimal(38,18)", "double": "double"}[kind]), F.lit(0)), T.literal(kind)
        kind = "decimal" if kind == "integer" else kind
        n = n.cast("decimal(38,18)") if kind == "decimal" else n
        mean = F.sum_distinct(n) / F.count_distinct(n) if a.distinct else F.avg(n)
        return mean.cast("decimal(38,18)" if kind == "decimal" else "double"), T.literal(kind)
    if a.name in ("MIN", "MAX"):
        if v.kind != "term":
            return (F.min(c) if a.name == "MIN" else F.max(c)), form
        key = F.struct(T.number(c).isNotNull().alias("n"), T.number(c).alias("v"), c.alias("t"))
        best = F.min if a.name == "MIN" else F.max
        return best(F.when(c.isNotNull(), key))["t"], T.TERM
    if a.name == "SAMPLE":
        return F.min(c), form  # any will do; the least is the same each time
    if a.name == "GROUP_CONCAT":
        texts = E.text(v)
        parts = F.collect_set(texts) if a.distinct else F.collect_list(texts)
        return F.array_join(F.array_sort(parts), a.separator), T.literal("string")
    raise UnsupportedQuery(a.name)
