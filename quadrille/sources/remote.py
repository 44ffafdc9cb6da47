"""Endpoints over HTTP as services."""

from __future__ import annotations

import urllib.parse
import urllib.request
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from quadrille.functions import terms as T
from quadrille.operators.relation import Relation, physical
from quadrille.plans import algebra as A
from quadrille.plans.serialize import query as text_of
from quadrille.sources.results import from_json


@dataclass
class RemoteService:
    """Asks ``url`` for a pattern's solutions and follows continuations until none is left.

    What comes over HTTP comes through the driver, so ``most_rows`` bounds it; more raise.
    """

    spark: SparkSession
    url: str
    timeout: float = 60.0
    most_rows: int = 1_000_000

    def __call__(self, op: Any) -> Relation:
        names = sorted(A.visible(op))
        text: str | None = text_of(A.Project(tuple(names), op))
        rows: list[dict[str, str]] = []
        while text is not None:
            data = urllib.parse.urlencode({"query": text}).encode()
            request = urllib.request.Request(self.url, data, {"Accept": "application/sparql-results+json"})
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                _, got, text = from_json(answer.read().decode())
            rows += got
            if len(rows) > self.most_rows:
                raise ValueError(f"more than {self.most_rows} rows from {self.url}")
        if not names:
            return Relation(self.spark.range(len(rows)).select(), {}, set())
        schema = ", ".join(f"`{physical(n)}` string" for n in names)
        df = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
        return Relation(df, {n: T.TERM for n in names}, {n for n in names if all(n in r for r in rows)})
