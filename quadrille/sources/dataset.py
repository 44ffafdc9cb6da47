"""What a dataset offers to the compiler, and statements held as rows."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators import relation as R
from quadrille.operators.relation import Relation
from quadrille.plans import algebra as A


class Dataset:
    """Base: scans of single patterns, their cardinalities, and basic graph patterns as folds of joins."""

    spark: SparkSession

    @property
    def marks(self) -> dict:
        """Where offsets over this dataset end, by operator, as they were found."""
        return self.__dict__.setdefault("_marks", {})

    def scan(self, pattern: A.Pattern) -> Relation:
        raise NotImplementedError

    def cardinalities(self, patterns: list[A.Pattern]) -> list[int]:
        """Number of matches of each pattern by its constants alone."""
        raise NotImplementedError

    def count(self, pattern: A.Pattern) -> DataFrame | None:
        """One row with the number of matches, n, where that is known without building them."""
        return None

    def stars(self, patterns: tuple[A.Pattern, ...]) -> list[tuple[A.Pattern, ...]]:
        """The patterns in groups, each of which one scan answers."""
        return [(p,) for p in patterns]

    def bgp(self, patterns: tuple[A.Pattern, ...]) -> Relation:
        scans = [self.scan(p) for p in patterns]
        return reduce(R.join, scans) if scans else R.unit(self.spark)


class QuadDataset(Dataset):
    """Rows ``(g, s, p, o)`` of canonical term text; g may be null.  The default graph is every row, as often as it is there."""

    def __init__(self, quads: DataFrame):
        self.folders = "pk" in quads.columns
        self.quads = quads.select("g", "s", "p", "o", *["pk"] * self.folders)
        self.spark = quads.sparkSession
        self._known: dict[A.Pattern, int] = {}

    def scan(self, pattern: A.Pattern) -> Relation:
        df, first = self.quads, {}
        for position, t in pattern.parts():
            if t is None:
                continue
            c = F.col(position)
            if isinstance(t, A.Var):
                if t.name in first:
                    df = df.filter(c == F.col(first[t.name]))
                else:
                    first[t.name] = position
                    df = df.filter(c.isNotNull()) if position == "g" else df
            else:
                df = df.filter(c == T.canonical_text(t))
                if position == "p" and self.folders:
                    df = df.filter(F.col("pk") == folder(T.canonical_text(t)))
        out = {n: F.col(p).alias(R.physical(n)) for n, p in first.items()}
        return Relation(df.select(*out.values()), {n: T.TERM for n in out}, set(out))

    def cardinalities(self, patterns: list[A.Pattern]) -> list[int]:
        """All new ones in one pass over the quads."""
        free = [A.Pattern(*(None if isinstance(t, A.Var) else t for t in (p.s, p.p, p.o, p.g))) for p in patterns]
        new = [p for p in dict.fromkeys(free) if p not in self._known]
        if new:
            tests = [reduce(lambda x, y: x & y, [F.col(k) == T.canonical_text(t) for k, t in p.parts() if t is not None], F.lit(True)) for p in new]
            row = self.quads.agg(*[F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests)]).first()
            self._known.update(zip(new, row))
        return [self._known[p] for p in free]


_TERM = r'(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*{_TERM}\s+{_TERM}\s+{_TERM}(?:\s+{_TERM})?\s*\.\s*(?:#.*)?$"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Quads of a column ``value`` of N-Triples or N-Quads lines; blank lines and comments go, others raise.

    Language tags are lower-cased and plain strings lose an explicit xsd:string, so that equal terms are equal text.
    """
    statements = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    bad = F.raise_error(F.concat(F.lit("not a statement: "), F.col("value")))
    checked = statements.select(F.when(F.col("value").rlike(_LINE), F.col("value")).otherwise(bad).alias("value"))

    def part(i: int):
        c = F.regexp_extract("value", _LINE, i)
        c = F.regexp_replace(c, r'"\^\^<http://www\.w3\.org/2001/XMLSchema#string>$', '"')
        tag = F.regexp_extract(c, r'"(@[A-Za-z0-9-]+)$', 1)
        c = F.when(tag != "", F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(tag)), F.lower(tag))).otherwise(c)
        return F.when(c != "", c)

    return checked.select(part(4).alias("g"), part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))


def read_statements(spark: SparkSession, path: str) -> QuadDataset:
    """Dataset of N-Triples and N-Quads text files."""
    return QuadDataset(parse_lines(spark.read.text(path)))


def read_quads(spark: SparkSession, path: str) -> QuadDataset:
    """Dataset of a Parquet table of quads, such as :func:`write_quads` writes."""
    return QuadDataset(spark.read.schema("g string, s string, p string, o string, pk string").parquet(path))


def folder(predicate: str) -> str:
    """Folder of a predicate in a written table."""
    return hashlib.md5(predicate.encode()).hexdigest()[:12]


def write_quads(dataset: QuadDataset, path: str) -> None:
    """Quads as Parquet, one folder a predicate: a pattern with a constant predicate then reads only its folder.

    Rows are sorted by subject and object inside each file, so their statistics prune bound positions as well.
    """
    pk = F.substring(F.md5("p"), 1, 12).alias("pk")
    rows = dataset.quads.select("g", "s", "p", "o", pk).repartition("pk", F.pmod(F.xxhash64("s"), F.lit(32)))
    rows.sortWithinPartitions("pk", "s", "o").write.partitionBy("pk").mode("overwrite").parquet(path)


def from_lines(spark: SparkSession, text: str) -> QuadDataset:
    """Dataset of statements given as text, for tests and examples."""
    lines = [x.strip() for x in text.strip().splitlines() if x.strip()]
    for x in lines:
        if not re.match(_LINE, x):
            raise ValueError(f"not a statement: {x}")
    return QuadDataset(parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")))


class Registry:
    """Datasets shared by name: one for each, opened when first asked for."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._open: dict[str, Dataset] = {}

    def get(self, path: str) -> Dataset:
        if path not in self._open:
            statements = path.endswith((".nt", ".nq", ".ntriples", ".nquads"))
            self._open[path] = (read_statements if statements else read_quads)(self.spark, path)
        return self._open[path]
