"""Operator 3: exact deduplication by 128-bit content hash, with bytes compared inside the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import checkpointed


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest",
                broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts group by MD5, and ``keep`` names whether the smallest or the largest id of equal texts stays.  Rows
    whose hash occurs once are done after a shuffle of 24 bytes each.  For the others the texts themselves are
    grouped, so equal bytes are told from a hash collision; equal texts meet on the map side first, which makes a
    group of copies one row per task before the shuffle, however large it is.  The set of repeated hashes filters
    that scan by broadcast when a count shows at most ``broadcast_rows`` of them, else by a shuffled semi join.

    Null text counts as empty.  A null id is smaller than any other and is kept only if its group has no other id.
    Rows that repeat an id are rows of their own; those of them that hold the kept id in a group are all kept.
    Columns beyond id and text are ignored.  An empty table gives an empty result.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.unhex(F.md5(F.col("text").cast("binary"))))
    groups = rows.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # groups of two and more are few; they are kept so that their count can be checked
    repeated = checkpointed(groups.filter("group_size > 1"))
    known = repeated.count()
    hashes = repeated.select("h")
    hashes = F.broadcast(hashes) if known <= broadcast_rows else hashes
    texts = (
        rows.join(hashes, "h", "left_semi").groupBy("h", "text")
        .agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
    )
    collided = checkpointed(
        texts.groupBy("h").agg(F.count("*").alias("classes"),
                               F.collect_list(F.struct("sha", "keep_id", "group_size")).alias("each"))
        .filter("classes > 1").select("h", F.explode("each").alias("e")).select("h", "e.*")
    )
    out = rows.select("doc_id", "h", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    out = out.join(repeated.select("h", "keep_id", "group_size"), "h", "left")
    if not collided.isEmpty():
        fixed = collided.select("h", F.col("sha").alias("text_sha256"), F.col("keep_id").alias("own_keep"),
                                F.col("group_size").alias("own_size"))
        out = out.join(fixed, ["h", "text_sha256"], "left").withColumns({
            "keep_id": F.when(F.col("own_size").isNull(), F.col("keep_id")).otherwise(F.col("own_keep")),
            "group_size": F.coalesce("own_size", "group_size")})
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      keep_id.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")
