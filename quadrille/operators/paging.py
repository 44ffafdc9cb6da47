"""Execution under a budget: a page of solutions, and a query that gives exactly those still missing.

A query is brought to branches of steps: the branches of its unions, each a sequence of patterns, inline data, optional
parts and bindings.  Solutions have a total order, branch by branch and lexicographic by the terms each step adds, as if
each step were a loop inside the one before.  A page is the first solutions in that order, a distributed top-k.  From the
last one, the missing solutions are, for each step from the innermost out: what the steps before it had bound, the
step's remaining matches (an OFFSET over the step alone), and the later steps untouched.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import expressions as E
from quadrille.functions import terms as T
from quadrille.operators import relation as R
from quadrille.operators.compiler import extend, project
from quadrille.operators.relation import Relation, physical
from quadrille.plans import algebra as A
from quadrille.plans import rewrite
from quadrille.plans.parser import Query
from quadrille.plans.serialize import query as text_of

if TYPE_CHECKING:
    from quadrille.engine import Engine


@dataclass(frozen=True)
class Budget:
    """Limits of one page; None is no limit.  ``timeout`` is in seconds and checked between jobs."""

    max_results: int | None = None
    max_scans: int | None = None
    timeout: float | None = None

    def __post_init__(self) -> None:
        for name in ("max_results", "max_scans", "timeout"):
            v = getattr(self, name)
            if v is not None and v <= 0:
                raise ValueError(f"{name} must be over 0")

    def lowered(self, other: Budget) -> Budget:
        """The smaller of each limit: a user may lower a server's limits, never raise them."""
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        return Budget(*(least(getattr(self, n), getattr(other, n)) for n in ("max_results", "max_scans", "timeout")))


@dataclass
class Page:
    """``rows`` have canonical text for every term and None for unbound variables.

    ``progress`` is the share of the outermost step's matches that are used up, where the query has such steps.
    """

    rows: list[dict]
    next: str | None
    names: list[str]
    progress: float | None = None


@dataclass(frozen=True)
class Step:
    """``inner`` or ``optional`` with an operator, or ``bind`` with a variable and an expression."""

    kind: str
    op: Any = None
    condition: Any = None
    var: str = ""


@dataclass(frozen=True)
class Branch:
    steps: tuple[Step, ...] = ()
    filters: tuple[Any, ...] = ()

    def op(self) -> Any:
        return _filtered(reduce(_attach, self.steps, A.UNIT), self.filters)


def _attach(left: Any, s: Step) -> Any:
    if s.kind == "bind":
        return A.Extend(s.var, s.op, left)
    if s.kind == "optional":
        return A.LeftJoin(left, s.op, s.condition)
    return A.join_all([left, s.op])


def _filtered(op: Any, filters: tuple) -> Any:
    return A.Filter(tuple(dict.fromkeys(filters)), op) if filters else op


def _singly(patterns: tuple) -> list[tuple]:
    return [(p,) for p in patterns]


def split_branches(op: Any, stars: Callable[[tuple], list[tuple]] = _singly) -> list[Branch]:
    match op:
        case A.Bgp(patterns):
            return [Branch(tuple(Step("inner", A.Bgp(p)) for p in stars(patterns)))]
        case A.Table():
            return [Branch(() if op == A.UNIT else (Step("inner", op),))]
        case A.Union(a, b):
            return split_branches(a, stars) + split_branches(b, stars)
        case A.Filter(conditions, c):
            return [replace(x, filters=x.filters + conditions) for x in split_branches(c, stars)]
        case A.Extend(v, e, c) if not _has_group(c):
            return [replace(x, steps=x.steps + (Step("bind", e, var=v),)) for x in split_branches(c, stars)]
        case A.Join(a, b):
            right = split_branches(b, stars)
            # a filter may leave its group only if nothing outside changes what it sees
            for x in right:
                inside = A.certain(Branch(x.steps).op())
                if not all(A.expression_vars(f) <= inside for f in x.filters) or any(s.kind == "bind" for s in x.steps):
                    right = [Branch((Step("inner", b),))]
                    break
            return [Branch(x.steps + y.steps, x.filters + y.filters) for x in split_branches(a, stars) for y in right]
        case A.LeftJoin(a, b, c):
            left = split_branches(a, stars)
            if any(x.filters for x in left):
                left = [Branch((Step("inner", a),))]
            return [replace(x, steps=x.steps + (Step("optional", b, c),)) for x in left]
    return [Branch((Step("inner", op),))]


def _has_group(op: Any) -> bool:
    while isinstance(op, (A.Extend, A.Filter, A.OrderBy)):
        op = op.child
    return isinstance(op, A.Group)


def branches(op: Any, stars: Callable[[tuple], list[tuple]] = _singly) -> list[Branch] | None:
    """Branches of a query's pattern; None if a variable that steps share may be unbound, so that steps have no order.

    ``stars`` says which patterns of a basic graph pattern are one step; by itself each is one.
    """
    out = split_branches(op, stars)
    for b in out:
        sure: set[str] = set()
        seen: set[str] = set()
        for s in b.steps:
            if s.kind == "bind":
                if s.var in seen:
                    return None
                sure |= {s.var} if isinstance(s.op, (A.Iri, A.Literal)) else set()
                seen.add(s.var)
                continue
            shared = A.visible(s.op) & seen
            if not shared <= sure or not shared <= A.certain(s.op):
                return None
            seen |= A.visible(s.op)
            sure |= A.certain(s.op) if s.kind == "inner" else set()
    return out


# -- ordered solutions


def _key(i: int) -> str:
    return f"k:{i}"


def _keyed(rel: Relation, shared: set[str], i: int) -> Relation:
    """With the step's key: canonical text of the variables it adds."""
    key = F.array(*[rel.canonical(n) for n in sorted(rel.vars - shared)]).cast("array<string>")
    return Relation(rel.df.withColumn(_key(i), key), rel.forms, rel.certain, rel.extra + [_key(i)])


def _numbered(rel: Relation, i: int, copies: bool) -> Relation:
    """With the step's key ended by which of several equal matches of one solution this is, where they may repeat.

    Numbers are given to what the step before and tests have left, so nothing is moved for the rest of the step.
    """
    key = F.col(f"`{_key(i)}`")
    if copies:
        before = [F.col(f"`{x}`") for x in rel.extra if x != _key(i)]
        same = F.row_number().over(Window.partitionBy(*before, key).orderBy(F.lit(1)))
        key = F.when(key.isNotNull(), F.concat(key, F.array(F.lpad(same.cast("string"), 19, "0"))))
    else:
        key = F.when(F.size(key) == 0, F.array(F.lit(""))).otherwise(key)
    return Relation(rel.df.withColumn(_key(i), key), rel.forms, rel.certain, rel.extra)


def _array(key: list) -> Column:
    return F.array(*[F.lit(x).cast("string") for x in key])


def _condition(e: Any):
    return None if e is None else lambda env: F.coalesce(E.ebv(E.evaluate(e, env)), F.lit(False))


def _copies(engine: Engine, op: Any) -> bool:
    """Whether a step's solutions may repeat; those of a set of statements never do."""
    return not (isinstance(op, A.Bgp) and getattr(engine.dataset, "is_set", False))


def _prefixes(engine: Engine, b: Branch, mark: list | None = None, small: bool = False, tested: bool = False) -> list[tuple[int, Relation]]:
    """For each step but bindings, its index and the solutions of all steps up to it and of bindings right after it.

    With a ``mark``, only from the outermost step's matches up to those terms; they are ``small`` if every task may hold
    them.  With ``tested``, only what passes those filters that can be told at the outermost step.
    """
    rel = R.unit(engine.dataset.spark)
    out: list[tuple[int, Relation]] = []
    if not any(s.kind != "bind" for s in b.steps):
        rel = Relation(rel.df.withColumn(_key(0), F.array(F.lit(""))), {}, set(), [_key(0)])
        out = [(-1, rel)]
    for i, s in enumerate(b.steps):
        if s.kind == "bind":
            rel = extend(rel, s.var, s.op)
            out = out[:-1] + [(out[-1][0], rel)] if out else out
            continue
        right = _keyed(engine.relation(s.op), A.visible(s.op) & rel.vars, i)
        if mark is not None and not out:
            right = right.filter(F.col(f"`{_key(i)}`") <= _array(mark))
        if tested and not out and s.kind == "inner":
            right = _passes(engine, right, _own(b, right))
        if s.kind == "inner":
            rel = _numbered(R.join(rel, right), i, _copies(engine, s.op))
            if small and not out:
                rel.df = F.broadcast(rel.df)
        else:
            rel = _numbered(R.left_join(rel, right, _condition(s.condition)), i, _copies(engine, s.op))
            rel.df = rel.df.withColumn(_key(i), F.coalesce(F.col(f"`{_key(i)}`"), F.array().cast("array<string>")))
        out.append((i, rel))
    return out


@dataclass
class _Node:
    """Where a page ended: branch, step, canonical text of every bound variable, and the steps' keys."""

    branch: int
    step: int
    terms: dict[str, str | None]
    keys: dict[int, list[str] | None]


def _passes(engine: Engine, rel: Relation, filters: tuple) -> Relation:
    from quadrille.operators.compiler import Compiler

    return Compiler(engine.dataset, engine.services)._filter(filters, rel)


def _first(engine: Engine, all_: list[Branch], names: list[str], limit: int, scans: bool, pages: int = 1) -> list[tuple[list[dict], _Node | None]]:
    """Solutions among the first ``limit`` nodes of the order, and among the ``limit`` after those, for ``pages`` at most.

    Nodes are solutions, or with ``scans`` every step's matches.  Each page comes with the node that it ends at, or None
    if there are no more.  Solutions come branch by branch, and in a branch from the first matches of its outermost step:
    no later one can come before theirs.  If they give too few, eight times as many are tried.
    """
    size, limit = limit, limit * pages
    steps = max([len(b.steps) for b in all_] + [1])
    if scans:
        got = _ordered(_nodes(engine, all_, names, steps, True), steps, limit + 1)
    else:
        got, at = [], 0
        while at < len(all_) and len(got) <= limit:
            some = _outer_matches(engine, all_[at], limit + 1)
            if some is not None:
                got += _first_of(engine, all_[at], at, names, steps, limit + 1 - len(got), some)
                at += 1
                continue
            end = at + 1  # branches of small steps are one job
            while end < len(all_) and _outer_matches(engine, all_[end], limit + 1) is None:
                end += 1
            got += _ordered(_nodes(engine, all_[at:end], names, steps, False, at), steps, limit + 1 - len(got))
            at = end
    out: list[tuple[list[dict], _Node | None]] = []
    for at in range(0, max(1, min(len(got), limit)), size):
        some = got[at : at + size]
        rows = [{n: r["o:" + n] if "o:" + n in r.__fields__ else None for n in names} for r in some if r["ok"]]
        if len(got) <= at + size:
            return out + [(rows, None)]
        r = some[-1]
        keys = {k: r[_key(k)] for k in range(steps)}
        out.append((rows, _Node(r["b"], r["i"], _terms(all_[r["b"]], keys) | dict(r["terms"] or {}), keys)))
    return out


def _first_of(engine: Engine, b: Branch, at: int, names: list[str], steps: int, limit: int, some: int) -> list:
    """The first ``limit`` solutions of a branch, from its first ``some`` outermost matches at first."""
    i, s = next((i, s) for i, s in enumerate(b.steps) if s.kind != "bind")
    while True:
        bound = {x.var for x in b.steps[:i]}
        outer = _keyed(engine.relation(s.op), A.visible(s.op) & bound, i)
        key = F.col(f"`{_key(i)}`")
        outer = _passes(engine, outer, _own(b, outer))  # only those can be solutions
        last = outer.df.select(key.alias("k")).orderBy("k").limit(some).agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n")).first()
        if last["n"] < some:
            break
        # where matches may be equal, there may be any number of the last one
        held = some if len(b.steps) == 1 or not _copies(engine, s.op) else outer.df.filter(key <= _array(last["k"])).count()
        got = _ordered(_nodes(engine, [b], names, steps, False, at, last["k"], held <= HELD), steps, limit)
        if len(got) >= limit:
            return got
        some *= 8
    return _ordered(_nodes(engine, [b], names, steps, False, at, None, last["n"] <= HELD), steps, limit)


def _own(b: Branch, outer: Relation) -> tuple:
    """The filters of a branch that its outermost step's matches alone decide."""
    return tuple(f for f in b.filters if A.expression_vars(f) <= outer.certain and _repeatable(f))


#: Outermost matches that every task may hold, to meet the later steps without moving those.
HELD = 1_000_000


def _repeatable(e: Any) -> bool:
    """Whether an expression has one value, by the solution alone, each time it is asked."""
    seen: list[Any] = []
    A.rebuild(e, lambda x: seen.append(x) or x)
    return not any(isinstance(x, A.Exists) or isinstance(x, A.Call) and x.name in ("RAND", "UUID", "STRUUID", "BNODE") for x in seen)


#: Branches whose steps have no more matches than this, or so many times a page, are run whole.
SMALL, SMALL_PAGES = 10_000, 8


def _outer_matches(engine: Engine, b: Branch, limit: int) -> int | None:
    """How many of the outermost step's matches to try first; None if that is not worth a job of its own.

    Half as many again as are needed if each gives as many solutions as the largest step has matches for it.
    """
    loops = [s for s in b.steps if s.kind != "bind"]
    patterns = [_pattern(s.op) for s in loops]
    if not loops or loops[0].kind != "inner" or patterns[0] is None:
        return None
    sizes = engine.dataset.cardinalities([p for p in patterns if p is not None])
    if max(sizes) <= max(SMALL, SMALL_PAGES * limit):
        return None
    return limit if len(loops) == 1 else max(1, min(limit, -(-3 * limit * max(1, sizes[0]) // (2 * max(sizes)))))


def _pattern(op: Any) -> A.Pattern | None:
    """The one pattern of a step, or of the rest of one; the first of a star."""
    while isinstance(op, (A.Slice, A.Project)):
        op = op.child
    return op.patterns[0] if isinstance(op, A.Bgp) and len({p.s for p in op.patterns}) == 1 else None


def _ordered(frames: list[DataFrame], steps: int, limit: int) -> list:
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    by: list[Column] = [F.col("b").asc(), *[F.col(f"`{_key(k)}`").asc_nulls_first() for k in range(steps)]]
    return whole.orderBy(*by).limit(limit).collect()


def _nodes(engine: Engine, all_: list[Branch], names: list[str], steps: int, scans: bool, base: int = 0,
           mark: list | None = None, small: bool = False) -> list[DataFrame]:
    """Nodes of the branches, which are numbered from ``base`` on, as frames with their keys, bindings and outputs."""
    frames: list[DataFrame] = []
    built = []
    for at, b in enumerate(all_):
        prefixes = _prefixes(engine, b, mark, small, not scans)
        for j, (i, rel) in enumerate(prefixes):
            last = j == len(prefixes) - 1
            if not last and not scans:
                continue
            if last and not scans:
                rel = _passes(engine, rel, b.filters)
                rel.df = rel.df.withColumn("ok", F.lit(True))
            elif last:
                good = _passes(engine, rel, b.filters) if b.filters else rel
                if b.filters and not any(isinstance(f, A.Exists) for f in b.filters):
                    env = rel.env()
                    ok = reduce(lambda x, y: x & y, [F.coalesce(E.ebv(E.evaluate(f, env)), F.lit(False)) for f in b.filters])
                    rel.df = rel.df.withColumn("ok", ok)
                elif b.filters:  # a node for each match, marked if it passes: semi join and its complement
                    rel = R.union(Relation(good.df.withColumn("ok", F.lit(True)), good.forms, good.certain, good.extra + ["ok"]),
                                  Relation(rel.df.join(good.df.select(*[_key(k) for k in range(steps) if _key(k) in rel.extra]), [x for x in rel.extra], "left_anti")
                                           .withColumn("ok", F.lit(False)), rel.forms, rel.certain, rel.extra + ["ok"]))
                else:
                    rel.df = rel.df.withColumn("ok", F.lit(True))
            else:
                rel.df = rel.df.withColumn("ok", F.lit(False))
            built.append((at, i, rel))
    for at, i, rel in built:
        binds = [s.var for s in all_[at].steps if s.kind == "bind" and s.var in rel.vars]
        terms = F.create_map(*[x for n in binds for x in (F.lit(n), rel.canonical(n))]) if binds else F.create_map()
        cols = [F.lit(base + at).alias("b"), F.lit(i).alias("i"), "ok", terms.cast("map<string,string>").alias("terms")]
        for k in range(steps):
            has = _key(k) in rel.df.columns
            cols.append((F.col(f"`{_key(k)}`") if has else F.lit(None).cast("array<string>")).alias(_key(k)))
        for n in names:
            if n not in rel.vars:
                continue
            cols.append(rel.canonical(n).alias("o:" + n))
        frames.append(rel.df.select(*cols))
    return frames


def _terms(b: Branch, keys: dict[int, list[str] | None]) -> dict[str, str | None]:
    """What the steps have bound, read back from their keys."""
    out: dict[str, str | None] = {}
    seen: set[str] = set()
    for i, s in enumerate(b.steps):
        names = {s.var} if s.kind == "bind" else A.visible(s.op)
        if s.kind != "bind":
            out.update(zip(sorted(names - seen), keys.get(i) or []))
        seen |= names
    return out


def _table(terms: dict[str, str | None], names: set[str]) -> Any:
    """One row of inline data with what is bound of ``names``."""
    bound = sorted(n for n in names if terms.get(n) is not None)
    return A.Table(tuple(bound), (tuple(T.python_term(terms[n]) for n in bound),)) if bound else A.UNIT


def _rests(engine: Engine, all_: list[Branch], nodes: list[_Node]) -> list[tuple[list[Any], float | None]]:
    """For each node, operators that together give what comes after it, in order; and how far the outermost step is."""
    places: list[list[_Place]] = []
    for node in nodes:
        b, here, seen = all_[node.branch], [], set()
        before = {}
        for i, s in enumerate(b.steps):
            before[i] = set(seen)
            seen |= {s.var} if s.kind == "bind" else A.visible(s.op)
        for i in range(node.step, -1, -1):
            s, key = b.steps[i], node.keys.get(i)
            if s.kind == "bind" or not key:  # an optional step without a match has nothing left
                continue
            needed = (A.visible(s.op) | A.expression_vars(s.condition)) & before[i]
            here.append(_Place(node.branch, i, s, _table(node.terms, needed), sorted(A.visible(s.op) - before[i]), key, _copies(engine, s.op)))
        places.append(here)
    counts = _positions(engine, [x for here in places for x in here])
    return [_rest(engine, all_, node, here, counts, node is nodes[-1]) for node, here in zip(nodes, places)]


def _rest(engine: Engine, all_: list[Branch], node: _Node, places: list[_Place], counts: dict, marked: bool) -> tuple[list[Any], float | None]:
    """As :func:`_rests`, for one node.  ``marked``: where the offsets end is kept, so that going on need not look for it."""
    b = all_[node.branch]
    out: list[Any] = []
    seen: set[str] = set()
    before: dict[int, set[str]] = {}
    for i, s in enumerate(b.steps):
        before[i] = set(seen)
        seen |= {s.var} if s.kind == "bind" else A.visible(s.op)
    last = max([i for i, s in enumerate(b.steps) if s.kind != "bind"], default=-1)
    if node.step != last:
        at = node.step + 1
        while b.steps[at].kind == "bind":
            at += 1
        tail = reduce(_attach, b.steps[at:], _table(node.terms, before[at]))
        out.append(_filtered(tail, b.filters))
    share = None
    for x in places:
        less, equal, size = counts[x.id]
        done = less + x.copy
        share = done / size if size else None
        if done >= size:
            continue
        remaining = _sliced(done, x)
        if marked and x.step.condition is None:
            mark = [node.terms.get(n) for n in remaining.child.vars]
            engine.dataset.marks[remaining.child, remaining.offset] = mark, equal - x.copy
        start = A.join_all([_table(node.terms, before[x.i]), remaining])
        out.append(_filtered(reduce(_attach, b.steps[x.i + 1 :], start), b.filters))
    return out + [x.op() for x in all_[node.branch + 1 :]], None if share is None else (node.branch + share) / len(all_)


@dataclass
class _Place:
    """A match of a step: what of the steps before it the step sees, as inline data, and the names and terms it adds."""

    branch: int
    i: int
    step: Step
    table: Any
    new: list[str]
    key: list[str]
    copies: bool

    @property
    def copy(self) -> int:
        return int(self.key[-1]) if self.copies else 1

    @property
    def group(self) -> tuple:
        return self.branch, self.i, self.table.vars

    @property
    def prefix(self) -> tuple:
        return tuple(T.canonical_text(t) for t in self.table.rows[0])

    @property
    def terms(self) -> tuple:
        return tuple(self.key[: len(self.new)])

    @property
    def id(self) -> tuple:
        return self.group, self.prefix, self.terms


def _sliced(done: int, x: _Place) -> A.Slice:
    """The matches of a place's step after the first ``done``; of what is left of a step already, one longer offset."""
    names, op = tuple(sorted(A.visible(x.step.op))), x.step.op
    if x.step.condition is None and _bare(op) and op.child.vars == names:
        inside = op.child.child
        while isinstance(inside, A.Join):
            inside = inside.left
        if x.table in (A.UNIT, inside):  # what the steps before have bound is inside
            return A.Slice(op.offset + done, None, op.child)
    inner = A.join_all([x.table, op])
    inner = inner if x.step.condition is None else A.Filter((x.step.condition,), inner)
    return A.Slice(done, None, A.Project(names, inner))


def _bare(op: Any) -> bool:
    """An offset alone over named variables, in the order of all of them."""
    if not (isinstance(op, A.Slice) and op.limit is None and isinstance(op.child, A.Project) and op.child.vars):
        return False
    inner = op.child
    while isinstance(inner, (A.Project, A.Distinct)):
        inner = inner.child
    return not isinstance(inner, A.OrderBy)


def _positions(engine: Engine, places: list[_Place]) -> dict[tuple, tuple[int, int, int]]:
    """For each place, how many matches of its step come before it, are equal to it, and are there; in one job.

    A match finds its place among the sorted ones of its step by halving; only counts between places leave the tasks.
    """
    groups: dict[tuple, list[_Place]] = {}
    for x in places:
        groups.setdefault(x.group, []).append(x)
    frames, sorted_ = [], []
    for n, (group, some) in enumerate(groups.items()):
        s, bound = some[0].step, group[2]
        rows = tuple(dict.fromkeys(x.table.rows[0] for x in some))
        inner = A.join_all([A.Table(bound, rows) if bound else A.UNIT, s.op])
        inner = inner if s.condition is None else A.Filter((s.condition,), inner)
        rel = engine.relation(inner)
        texts = lambda names: F.array(*[rel.canonical(v) for v in names]).cast("array<string>")  # noqa: E731, B023
        marks = sorted({x.prefix + x.terms for x in some}, key=lambda k: [(t is not None, (t or "").encode()) for t in k])
        sorted_.append(marks)
        if len(marks) == 1:
            literal = _array(list(marks[0])).cast("array<string>")
            at = F.when(literal < F.col("k"), 1).otherwise(0)
            equal = F.col("k").eqNullSafe(literal)
        else:
            all_ = F.from_json(F.lit(json.dumps(marks)), "array<array<string>>")
            halves = [1 << j for j in range(len(marks).bit_length() - 1, -1, -1)]
            at = F.aggregate(F.lit(halves), F.lit(0), lambda acc, h: F.when(F.get(all_, acc + h - 1) < F.col("k"), acc + h).otherwise(acc))  # noqa: B023
            equal = F.col("k").eqNullSafe(F.get(all_, F.col("at")))
        df = rel.df.select(texts(bound).alias("p"), texts([*bound, *some[0].new]).alias("k")).withColumn("at", at)
        frames.append(df.groupBy("p", "at", equal.alias("e")).count().withColumn("n", F.lit(n)))
    found: dict[tuple, list] = {}
    for r in reduce(DataFrame.unionByName, frames).collect() if frames else []:
        found.setdefault((r["n"], tuple(r["p"])), []).append((r["at"], r["e"], r["count"]))
    out = {}
    for n, (group, some) in enumerate(groups.items()):
        number = {k: j for j, k in enumerate(sorted_[n])}
        by_prefix: dict[tuple, list[_Place]] = {}
        for x in some:
            by_prefix.setdefault(x.prefix, []).append(x)
        for prefix, here in by_prefix.items():
            counts = sorted(found.get((n, prefix), []), reverse=True)  # the first at the end: what is before a place, then its equals
            size, less = sum(c for *_, c in counts), 0
            for x in sorted(here, key=lambda x: number[x.prefix + x.terms]):
                j, equal = number[x.prefix + x.terms], 0
                while counts and (counts[-1][0] < j or counts[-1][0] == j and not counts[-1][1]):
                    less += counts.pop()[2]
                if counts and counts[-1][0] == j:
                    equal = counts[-1][2]
                out[x.id] = less, equal, size
    return out


# -- pages


def next_page(engine: Engine, query: Query, budget: Budget) -> Page:
    return next_pages(engine, query, budget, 1)[0]


def next_pages(engine: Engine, query: Query, budget: Budget, most: int) -> list[Page]:
    """Up to ``most`` pages in a row, each within the budget and with its own continuation.

    Pages bounded by their solutions alone are cut from one ordered list, and their continuations' offsets are counted
    together; under other limits there is one page.
    """
    if budget.timeout is not None:
        return [_timed(engine, query, budget)]
    if budget.max_results is None and budget.max_scans is None:
        rows = [r.asDict() for r in _output(engine.relation(query.op), query.names).collect()]
        return [Page(rows, None, query.names)]
    op, names = query.op, query.names
    if isinstance(op, A.Project) and budget.max_scans is not None and (count := _countable(op)):
        return [_counted(engine, query, budget.max_scans, *count)]
    inner = op.child if isinstance(op, A.Project) else op
    blocking = isinstance(inner, (A.OrderBy, A.Distinct, A.Slice, A.Group)) and not (isinstance(op, A.Project) and _bare(inner)) or _has_group(inner)
    scans = budget.max_scans is not None
    all_ = None if blocking else branches(inner, _singly if scans else engine.dataset.stars)
    if all_ is None:
        limit = min(budget.max_scans, budget.max_results or budget.max_scans) if scans else budget.max_results
        return _by_offset(engine, query, limit, 1 if scans else most)
    pages = _first(engine, all_, names, budget.max_scans if scans else budget.max_results, scans, 1 if scans else most)
    if scans and budget.max_results is not None and len(pages[0][0]) > budget.max_results:
        pages = _first(engine, all_, names, budget.max_results, False)
    rests = _rests(engine, all_, [node for _, node in pages if node is not None])
    out = []
    for (rows, node), (rest, progress) in zip(pages, [*rests, ([], None)]):
        if node is None or not rest:
            return out + [Page(rows, None, names, 1.0)]
        out.append(Page(rows, text_of(A.Project(tuple(names), A.union_all(rest))), names, progress))
    return out


def _output(rel: Relation, names: list[str]) -> DataFrame:
    rel = project(rel, tuple(names))
    return rel.df.select(*[rel.canonical(n).alias(n) for n in names])


def _by_offset(engine: Engine, query: Query, limit: int, most: int = 1) -> list[Page]:
    """For operators that need all their input: the answer's order is total, so the rest is an OFFSET."""
    op = query.op if isinstance(query.op, A.Slice) else A.Slice(0, None, query.op)
    size = limit * most if op.limit is None else min(limit * most, op.limit)
    got = [r.asDict() for r in _output(engine.relation(A.Slice(op.offset, size + 1 if size == limit * most and op.limit != size else size, op.child)), query.names).collect()]
    out = []
    for at in range(limit, limit * most + 1, limit):
        rows = got[at - limit : at]
        if len(got) <= at:
            return out + [Page(rows, None, query.names)]
        left = None if op.limit is None else op.limit - at
        out.append(Page(rows, text_of(A.Slice(op.offset + at, left, op.child)), query.names))
    return out


def _countable(op: A.Project) -> tuple[list[tuple[str, Any]], A.Group] | None:
    """Bindings and group of a query that only counts, without keys."""
    extends, inner = [], op.child
    while isinstance(inner, A.Extend):
        extends.append((inner.var, inner.expr))
        inner = inner.child
    plain = isinstance(inner, A.Group) and not inner.keys and all(
        a.name == "COUNT" and not a.distinct and (a.arg is None or isinstance(a.arg, A.Var)) for _, a in inner.aggregates)
    return (extends[::-1], inner) if plain else None


def _counted(engine: Engine, query: Query, scans: int, extends: list, group: A.Group) -> Page:
    """No row until the count is complete; the continuation adds what was counted so far."""
    needed = sorted({a.arg.name for _, a in group.aggregates if a.arg is not None})
    all_ = branches(group.child)
    if all_ is None:
        return Page([r.asDict() for r in _output(engine.relation(query.op), query.names).collect()], None, query.names)
    [(rows, node)] = _first(engine, all_, needed, scans, True)
    add = {name: sum(1 for r in rows if a.arg is None or r[a.arg.name] is not None) for name, a in group.aggregates}
    number = lambda n: A.Literal(str(n), A.XSD + "integer")
    rest = [] if node is None else _rests(engine, all_, [node])[0][0]
    put = (lambda x: number(add[x.name]) if isinstance(x, A.Var) and x.name in add else x) if not rest else (
        lambda x: A.Call("+", (x, number(add[x.name]))) if isinstance(x, A.Var) and x.name in add else x)
    final = [(v, rewrite.fold_sums(A.rebuild(e, put))) for v, e in extends]
    child = A.UNIT if not rest else A.Group((), group.aggregates, A.union_all(rest))
    op = A.Project(tuple(query.names), reduce(lambda c, x: A.Extend(x[0], x[1], c), final, child))
    if rest:
        return Page([], text_of(op), query.names)
    return Page([r.asDict() for r in _output(engine.relation(op), query.names).collect()], None, query.names)


def _timed(engine: Engine, query: Query, budget: Budget) -> Page:
    """Pages of doubling size until the time is over; a page that has begun is finished, so one may run late."""
    end, size = time.monotonic() + budget.timeout, 1_000
    rows: list[dict] = []
    while True:
        left = None if budget.max_results is None else budget.max_results - len(rows)
        page = next_page(engine, query, Budget(max_results=size if left is None else min(size, left)))
        rows += page.rows
        done = page.next is None or left is not None and len(page.rows) >= left
        if done or time.monotonic() >= end:
            return Page(rows, page.next, page.names)
        query, size = engine.plan(page.next), size * 2
