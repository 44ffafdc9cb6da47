"""The corpus pipeline: quality, repeated lines, near duplicates, source mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import line_dedup, mixing, packing, quality, simhash
from quadrille.llm.common import new_path, removed, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The packed sequences depend on tokenizer and hashed selection; tests hold every stage against brute force instead.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: score of 0.5 or more.  Learnt from labels of ``docs`` itself.

    Null and empty texts are scored as empty ones; rows without an id, and repeated rows, by their text like any other.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), max_rows=40_000, fold=1, folds=3)
    return docs.filter(quality.score(model, F.col("text")) >= 0.5).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its lines that recur; n_chars follows the text.

    Null text becomes empty.  Rows without an id keep all lines; rows that repeat an id count as one holder of a line.
    """
    kept = line_dedup.line_dedup(docs, min_chars=40, min_docs=5)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id; five-word shingles, 0.8.

    An id is one document: rows that repeat it stay or go together, and its texts all belong to its component.  Texts
    without words are copies of each other.  Rows without an id cannot be told apart by it and all stay.
    """
    found = simhash.near_dedup(docs, shingle=5, similarity=0.8)
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or one row for each repetition.

    Texts without words have no size and are never taken.  A null source is a source; so are rows without an id its.
    """
    mixed = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")), weights=(5, 2, 1), most=3)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.withColumn("__times", times).filter("__times > 0").select(
        *COLUMNS, F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__n")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset; null text is empty, a piece of its end alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result but the last is a Parquet table in the shared folder.

    A table is removed when the stage after it is done; the last stage holds its result in checkpoints.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = None
        if i < len(STAGES) - 1:
            path = new_path(spark)
            docs = written(docs, path)
        if before and (path or not docs.inputFiles()):
            removed(spark, before)
        before = path
    return docs
