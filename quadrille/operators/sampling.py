"""Random walks over a query with known probabilities, all at once, and the estimates that they give.

A walk takes one uniform match of each step given what the steps before it bound, so its probability is the product of
one over the number of matches.  A batch of walks is one DataFrame; a step is a join with the number of matches of
each walk's key and a join with the match whose rank was drawn.  Draws are hashes of seed, walk and step, so a task
that runs again draws the same.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import expressions as E
from quadrille.operators import relation as R
from quadrille.operators.compiler import Compiler, extend, project
from quadrille.operators.paging import Step, split_branches
from quadrille.operators.relation import Relation, physical
from quadrille.plans import algebra as A
from quadrille.plans.algebra import UnsupportedQuery

WALK, PROBABILITY = "_walk", "_probability"


def _draw(seed: int, step: int) -> Column:
    """Uniform in [0, 1), by walk."""
    h = F.xxhash64(F.lit(seed), F.lit(step), F.col(WALK))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


#: Matches of a step without shared variables that one task ranks, about.
RANKED = 100_000


def _access(rel: Relation, shared: set[str]) -> Relation:
    """A step's matches with their rank under the shared variables and the number of them."""
    by = [rel.canonical(n) for n in sorted(shared)]
    new = [rel.canonical(n).asc_nulls_first() for n in sorted(rel.vars - shared)]
    w = Window.partitionBy(*by)
    df = rel.df.withColumns({
        "rank": F.row_number().over(w.orderBy(*(new or [F.lit(1)]))).cast("long") - 1,
        "card": F.count(F.lit(1)).over(w)})
    return Relation(df, rel.forms, rel.certain, ["rank", "card"])


def _whole(rel: Relation) -> tuple[DataFrame, DataFrame, int, int]:
    """A step's matches dealt by hash into parts and ranked in each: they, the parts' ranges of whole ranks, their width and number.

    Only the sizes of the parts come to the driver.  Whole ranks are looked up in cells of ``width`` ranks, each of which
    few parts reach into.
    """
    total = rel.df.count()
    parts = max(1, -(-total // RANKED))
    terms = [rel.canonical(n) for n in sorted(rel.vars)]
    dealt = rel.df.withColumn("part", F.pmod(F.xxhash64(*terms), F.lit(parts)).cast("int") if terms else F.lit(0))
    sizes = dict(dealt.groupBy("part").count().collect())
    ranked = dealt.withColumn("rank", F.row_number().over(
        Window.partitionBy("part").orderBy(*[t.asc_nulls_first() for t in terms] or [F.lit(1)])).cast("long") - 1)
    width, low, cells = max(1, -(-total // parts)), 0, []
    for p in sorted(sizes):
        high = low + sizes[p]
        cells += [(c, p, low, high) for c in range(low // width, (high - 1) // width + 1)]
        low = high
    found = rel.spark.createDataFrame(cells, "`c:cell` long, `c:part` int, `c:low` long, `c:high` long")
    return ranked, F.broadcast(found), width, low  # two cells a part at most


def _step(walks: Relation, s: Step, at: int, compiler: Compiler, seed: int) -> Relation:
    op = s.op
    rel = compiler.compile(op)
    if s.condition is not None:
        if not A.expression_vars(s.condition) <= rel.vars:
            raise UnsupportedQuery("a walk through OPTIONAL with a condition on outer variables")
        rel = rel.filter(F.coalesce(E.ebv(E.evaluate(s.condition, rel.env())), F.lit(False)))
    shared = walks.vars & rel.vars
    for side in (walks, rel):
        if not shared <= side.certain and side is rel:
            raise UnsupportedQuery("a walk through a step whose shared variables may be unbound")
    walks, rel = R.aligned(walks, rel, shared)
    alive = F.col(PROBABILITY) > 0
    keys = sorted(shared)
    if keys:
        steps = _access(rel, shared)
        cards = steps.df.filter("rank = 0").select(*[R.col(n).alias("r:" + physical(n)) for n in keys], F.col("card").alias("c:card"))
        on = reduce(lambda x, y: x & y, [R.col(n) == F.col(f"`r:{physical(n)}`") for n in keys])
        df = walks.df.join(cards, on, "left").drop(*["r:" + physical(n) for n in keys])
        df = df.withColumn("c:pick", F.when(alive, F.floor(_draw(seed, at) * F.col("c:card"))))
        picks = steps.df.withColumnsRenamed({physical(n): "r:" + physical(n) for n in keys}).drop("card")
        df = df.join(picks, on & (F.col("c:pick") == F.col("rank")), "left").drop("rank", "c:pick", *["r:" + physical(n) for n in keys])
    else:
        ranked, cells, width, total = _whole(rel)
        df = walks.df.withColumns({"c:card": F.lit(total), "c:pick": F.when(alive, F.floor(_draw(seed, at) * total))})
        pick = F.col("c:pick")
        df = df.join(cells, (F.floor(pick / width) == F.col("c:cell")) & (pick >= F.col("c:low")) & (pick < F.col("c:high")), "left")
        df = df.join(ranked, (F.col("c:part") == F.col("part")) & (pick - F.col("c:low") == F.col("rank")), "left")
        df = df.drop("rank", "part", "c:pick", "c:cell", "c:part", "c:low", "c:high")
    p = F.when(F.col("c:card") > 0, F.col(PROBABILITY) / F.col("c:card"))
    p = F.coalesce(p, F.col(PROBABILITY) if s.kind == "optional" else F.lit(0.0))
    df = df.withColumn(PROBABILITY, F.when(alive, p).otherwise(0.0)).drop("c:card")
    certain = walks.certain | (rel.certain if s.kind == "inner" else set())
    return Relation(df, rel.forms | walks.forms, certain, [WALK, PROBABILITY])


def _through(walks: Relation, op: Any, compiler: Compiler, seed: int, base: int = 0) -> Relation:
    """Walks taken through every step of ``op``; failed ones stay, with probability 0 and what they had bound."""
    parts = split_branches(op)
    if len(parts) > 1:
        # a walk takes one branch, each with the same chance
        share = len(parts)
        which = F.floor(_draw(seed, base + 1000) * share)
        out = []
        for i, b in enumerate(parts):
            df = walks.df.filter(which == i).withColumn(PROBABILITY, F.col(PROBABILITY) / share)
            out.append(_branch(Relation(df, walks.forms, walks.certain, walks.extra), b, compiler, seed, base + 100 * (i + 1)))
        return reduce(R.union, out)
    return _branch(walks, parts[0], compiler, seed, base)


def _branch(walks: Relation, b: Any, compiler: Compiler, seed: int, base: int) -> Relation:
    for i, s in enumerate(b.steps):
        if s.kind == "bind":
            if s.var not in walks.vars:
                walks = extend(walks, s.var, s.op)
            continue
        walks = _step(walks, s, base + i, compiler, seed)
    for f in b.filters:
        if isinstance(f, A.Exists):
            raise UnsupportedQuery("EXISTS in a walk")
        ok = F.coalesce(E.ebv(E.evaluate(f, walks.env())), F.lit(False))
        walks = Relation(walks.df.withColumn(PROBABILITY, F.when(ok, F.col(PROBABILITY)).otherwise(0.0)), walks.forms, walks.certain, walks.extra)
    return walks


def _start(compiler: Compiler, n: int) -> Relation:
    df = compiler.spark.range(n).select(F.col("id").alias(WALK), F.lit(1.0).alias(PROBABILITY))
    return Relation(df, {}, set(), [WALK, PROBABILITY])


def walk(engine: Any, text: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` walks over a SELECT query's pattern: its variables, ``_walk`` and ``_probability``, 0 where the walk failed.

    Terms are canonical text.  A failed walk's row holds what it had bound.  DISTINCT, slices, ordering and grouping have no walk and raise.
    """
    if n <= 0:
        raise ValueError("a number of walks over 0 is needed")
    query = engine.plan(text)
    if not isinstance(query.op, A.Project) or isinstance(query.op.child, (A.Group, A.OrderBy)):
        raise UnsupportedQuery(f"walks over {type(query.op).__name__}")
    compiler = Compiler(engine.dataset, engine.services)
    rel = project(_through(_start(compiler, n), query.op.child, compiler, seed), tuple(query.names))
    return rel.df.select(WALK, PROBABILITY, *[rel.canonical(v).alias(v) for v in query.names])


def _aggregate(engine: Any, text: str) -> tuple[str, A.Aggregate, Any]:
    op = engine.plan(text).op
    inner = op.child if isinstance(op, A.Project) else op
    name = None
    while isinstance(inner, A.Extend):
        name, inner = inner.var, inner.child
    if not isinstance(inner, A.Group) or inner.keys or len(inner.aggregates) != 1 or inner.aggregates[0][1].name != "COUNT":
        raise UnsupportedQuery("an estimate of anything but one COUNT without keys")
    return name or inner.aggregates[0][0], inner.aggregates[0][1], inner.child


def estimate(engine: Any, text: str, n: int, seed: int = 0, method: str = "weighted", sub_walks: int = 5) -> DataFrame:
    """One row with the estimate of a query's COUNT under the name that the query gives it, a double.

    ``COUNT(*)`` and ``COUNT(?v)``: the mean of one over the walks' probabilities, failed walks as 0 (Wander Join).
    ``COUNT(DISTINCT ...)`` by ``weighted``: each walk's one over probability is divided by an estimate of how many solutions
    share its values, from the walk itself and ``sub_walks`` more that start from those values.  By ``chao_lee``: the
    number of values seen, over the share of all solutions that they are estimated to hold.
    """
    name, a, op = _aggregate(engine, text)
    compiler = Compiler(engine.dataset, engine.services)
    walks = _through(_start(compiler, n), op, compiler, seed)
    targets = sorted(A.visible(op)) if a.arg is None else sorted(A.expression_vars(a.arg))
    won = F.col(PROBABILITY) > 0
    for v in targets if a.arg is not None else []:
        won = won & (R.col(v).isNotNull() if v in walks.vars else F.lit(False))
    weight = F.when(won, 1 / F.col(PROBABILITY)).otherwise(0.0)
    if not a.distinct:
        return walks.df.agg((F.sum(weight) / F.count(F.lit(1))).alias(name))
    if method not in ("weighted", "chao_lee"):
        raise ValueError(f"unknown method {method}")
    found = Relation(walks.df.withColumn("w:weight", weight), walks.forms, walks.certain, [WALK, PROBABILITY, "w:weight"])
    sizes = _shares(found, targets, op, compiler, sub_walks, seed)
    if method == "weighted":
        total = found.df.agg(F.count(F.lit(1)).alias("n"))
        parts = sizes.agg(F.coalesce(F.sum(F.col("w:weight") / F.col("w:size")), F.lit(0.0)).alias("s"))
        return total.crossJoin(parts).select((F.col("s") / F.col("n")).alias(name))
    whole = found.df.agg((F.sum("w:weight") / F.count(F.lit(1))).alias("all"))
    seen = sizes.groupBy(*[R.col(v) for v in targets]).agg(F.avg("w:size").alias("size"))
    seen = seen.agg(F.count(F.lit(1)).alias("d"), F.sum("size").alias("held"))
    share = F.col("held") / F.col("all")
    return whole.crossJoin(seen).select(F.when(F.col("d") == 0, 0.0).otherwise(F.col("d") / share).alias(name))


def _shares(found: Relation, targets: list[str], op: Any, compiler: Compiler, sub_walks: int, seed: int) -> DataFrame:
    """Successful walks with ``w:size``, an estimate of the number of solutions that have their values.

    The known walk gives one term, its probability when the values are bound from the start; the sub-walks the others.
    """
    won = Relation(found.df.filter(F.col("w:weight") > 0), found.forms, found.certain | set(targets), found.extra)
    start = won.df.select(F.col(WALK).alias("w:of"), *[R.col(v) for v in targets])
    many = start.withColumn("w:k", F.explode(F.sequence(F.lit(0), F.lit(sub_walks - 1)))) if sub_walks else start.withColumn("w:k", F.lit(0)).limit(0)
    many = many.withColumns({WALK: F.col("w:of") * max(1, sub_walks) + F.col("w:k"), PROBABILITY: F.lit(1.0)})
    again = Relation(many, {v: won.forms[v] for v in targets}, set(targets), [WALK, PROBABILITY])
    subs = _through(again, op, compiler, seed + 1)
    size = F.when(F.col(PROBABILITY) > 0, 1 / F.col(PROBABILITY)).otherwise(0.0)
    subs = subs.df.groupBy(F.floor(F.col(WALK) / max(1, sub_walks)).alias("w:of")).agg(F.sum(size).alias("w:sum"), F.count(F.lit(1)).alias("w:n"))
    known = _bootstrap(won, targets, op, compiler)
    out = known.join(subs, F.col(WALK) == F.col("`w:of`"), "left")
    total = (1 / F.col("w:known")) + F.coalesce(F.col("`w:sum`"), F.lit(0.0))
    return out.withColumn("w:size", total / (1 + F.coalesce(F.col("`w:n`"), F.lit(0))))


def _bootstrap(won: Relation, targets: list[str], op: Any, compiler: Compiler) -> DataFrame:
    """Successful walks with ``w:known``: the product of one over the matches of each step, targets bound first."""
    parts = split_branches(op)
    if len(parts) > 1:
        raise UnsupportedQuery("COUNT(DISTINCT) of a union by walks")
    df, bound = won.df.withColumn("w:known", F.lit(1.0)), set(targets)
    for s in parts[0].steps:
        if s.kind == "bind":
            bound.add(s.var)
            continue
        rel = compiler.compile(s.op)
        if s.condition is not None:
            rel = rel.filter(F.coalesce(E.ebv(E.evaluate(s.condition, rel.env())), F.lit(False)))
        keys = sorted(rel.vars & bound)
        now = Relation(df, won.forms, won.certain, won.extra)
        rel = rel.as_terms(set(keys))
        cards = rel.df.groupBy(*[R.col(n).alias("r:" + physical(n)) for n in keys]).agg(F.count(F.lit(1)).alias("r:card"))
        on = reduce(lambda x, y: x & y, [now.canonical(n) == F.col(f"`r:{physical(n)}`") for n in keys]) if keys else F.lit(True)
        df = df.join(cards if keys else F.broadcast(cards), on, "left").withColumn("w:known", F.col("w:known") / F.coalesce(F.col("`r:card`"), F.lit(1)))
        df = df.drop("r:card", *["r:" + physical(n) for n in keys])
        bound |= rel.vars
    return df
