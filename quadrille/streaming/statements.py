"""Statements as a stream: N-Triples and N-Quads files read as they arrive, and stateless patterns over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.operators import relation as R
from quadrille.plans import algebra as A
from quadrille.plans.parser import parse
from quadrille.sources.dataset import QuadDataset, parse_lines


def read_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Quads of the text files that appear in ``folder``."""
    reader = spark.readStream.format("text")
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return parse_lines(reader.load(folder))


def match_stream(quads: DataFrame, text: str) -> DataFrame:
    """Solutions, as they arrive, of a SELECT query of one pattern with filters and bindings; anything else needs state."""
    from quadrille.operators.compiler import Compiler

    query = parse(text)
    inner = query.op
    while isinstance(inner, (A.Project, A.Filter, A.Extend)):
        inner = inner.child
    if not isinstance(inner, A.Bgp) or len(inner.patterns) != 1:
        raise A.UnsupportedQuery("a stream of more than one pattern")
    rel = Compiler(QuadDataset(quads)).compile(query.op)
    return rel.df.select(*[R.col(n).alias(n) for n in query.names])
