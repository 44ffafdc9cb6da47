"""The entry point: query text over a dataset, whole, in pages, or estimated."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from quadrille.operators import relation as R
from quadrille.operators.compiler import Compiler, Services
from quadrille.operators.paging import Budget, Page, next_page, next_pages
from quadrille.operators.relation import Relation
from quadrille.plans import rewrite
from quadrille.plans.parser import Query, parse
from quadrille.sources.dataset import Dataset

#: Solutions that a run through all pages has the driver hold ahead of the page it is at.
AHEAD = 50_000


@dataclass
class Engine:
    """Queries over one dataset.

    ``services`` are the endpoints that SERVICE may name, ``default_graphs`` the graphs that patterns outside of GRAPH
    read (none: all, as a bag), ``force_order`` keeps joins in the order they are written in.
    """

    dataset: Dataset
    services: Services = field(default_factory=Services)
    default_graphs: list[str] = field(default_factory=list)
    force_order: bool = False

    def plan(self, text: str) -> Query:
        query = parse(text)
        op = rewrite.with_default_graphs(query.op, query.default_graphs or self.default_graphs)
        op = rewrite.normalise(op, None if self.force_order else self.dataset.cardinalities)
        return Query(op, query.names)

    def relation(self, op: Any) -> Relation:
        return Compiler(self.dataset, self.services).compile(op)

    def execute(self, text: str) -> DataFrame:
        """All solutions, lazily: literals of known type as native values, other terms as canonical text."""
        query = self.plan(text)
        return solutions(self.relation(query.op), query.names)

    def page(self, text: str, budget: Budget) -> Page:
        """What the budget allows, and the query for exactly the rest (None when there is none)."""
        return next_page(self, self.plan(text), budget)

    def pages(self, text: str, budget: Budget, most: int) -> list[Page]:
        """Up to ``most`` pages in a row, as :meth:`page` gives them one by one, at about the cost of one."""
        return next_pages(self, self.plan(text), budget, most)

    def run_to_completion(self, text: str, budget: Budget, most: int = 10_000) -> tuple[list[dict], int]:
        """All solutions by pages, as canonical text, and the number of continuations it took.

        As all pages are wanted, they are asked for several at a time, of ``AHEAD`` solutions together at most.
        """
        rows: list[dict] = []
        n, ahead = 0, 1
        while n < most:
            for page in self.pages(text, budget, min(ahead, most - n)):
                rows += page.rows
                if page.next is None:
                    return rows, n
                text, n = page.next, n + 1
            ahead = max(1, min(ahead * 64, AHEAD // (budget.max_results or AHEAD)))
        raise RuntimeError(f"not done after {most} pages")

    def terms(self, text: str) -> DataFrame:
        """All solutions, every cell as canonical text, which is how pages give them."""
        query = self.plan(text)
        rel = self.relation(query.op)
        return rel.df.select(*[rel.canonical(n).alias(n) for n in query.names])


def solutions(rel: Relation, names: list[str]) -> DataFrame:
    """The named variables: native literals as they are, all other terms as canonical text."""
    return rel.df.select(*[(R.col(n) if rel.forms[n].kind == "literal" else rel.canonical(n)).alias(n) for n in names])
