"""Operator 10: lines that recur across documents, dropped by keep bitmaps.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import ASCII_SPACE, LOWER, UPPER, checkpointed


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _runs(at: Column) -> Column:
    """Sorted distinct positions as runs: structs of first position and length."""
    firsts = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) != p - 1))
    lasts = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != p + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("length")))


def _stream(keyed: DataFrame) -> DataFrame:
    """``keyed`` (h, salt, doc_id, digest, pos) with owner and holders of its hash and salt, as one sorted pass finds them.

    Rows are range-partitioned by hash and salt and sorted by hash, document from the largest down, and position.
    In that order the first row of a hash is its owner's, and a row whose document differs from the one before is the
    first occurrence of its hash in that document; windows over the same order need no further exchange.
    """
    ranged = keyed.repartitionByRange("h", "salt").sortWithinPartitions("h", "salt", F.desc("doc_id"), "pos")
    along = Window.partitionBy("h", "salt").orderBy(F.desc("doc_id"), "pos")
    before = F.lag("doc_id").over(along)
    firsts = ranged.withColumns({"first": (before.isNull() | (before != F.col("doc_id"))).cast("long"), "owner": F.first("doc_id").over(along)})
    return firsts.withColumn("holders", F.sum("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 40,
                 min_docs: int = 5, chunk_rows: int = 2_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows ``(doc_id, digest, dropped)`` for the documents that lose lines.

    ``dropped`` is the document's keep bitmap, compressed to the runs of positions (from 0) whose bit is off;
    every other position stays.  ``digest`` is xxhash64 of the text the positions refer to.  A line's key is the
    line stripped of ASCII white space at both ends, with A-Z lower-cased; keys of at least ``min_chars`` code
    points that at least ``min_docs`` ids hold lose all their lines except in the largest id among the holders.

    Keys travel as 128-bit hashes with id and position, never as text, and are streamed in sorted ranges
    (:func:`_stream`).  A key of over ``chunk_rows`` lines is salted by document, so that its lines are many ranges;
    its chunks send one row each with their owner and number of holders onward, and its lines meet the sums of those
    by key, broadcast if a count shows ``broadcast_rows`` such keys at most.  Null text is one empty line.  Rows with
    a null id are left alone and count for nothing.  Rows that repeat an id count as one document.  Further columns
    are ignored; an empty table gives an empty result.
    """
    digest = F.xxhash64(_text(text_column))
    lines = docs.filter(F.col(id_column).isNotNull() & (F.length(text_column) >= min_chars)).select(
        F.col(id_column).cast("long").alias("doc_id"), digest.alias("digest"),
        F.posexplode(F.split(_text(text_column), "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(ASCII_SPACE)), UPPER, LOWER)
    keyed = lines.filter(F.length("line") >= min_chars).withColumn("key", key).filter(F.length("key") >= min_chars)
    keyed = checkpointed(keyed.select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"), "doc_id", "digest", "pos"))
    hot = checkpointed(keyed.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > chunk_rows)
                       .select("h", F.ceil(F.col("n") / chunk_rows).alias("chunks")).coalesce(8))  # few rows
    known = hot.count()
    small = (lambda df: F.broadcast(df)) if known <= broadcast_rows else (lambda df: df)
    recurs = (F.col("holders") >= min_docs) & (F.col("doc_id") != F.col("owner"))
    if not known:
        lost = _stream(keyed.withColumn("salt", F.lit(0).cast("long"))).filter(recurs)
    else:
        salt = F.when(F.col("chunks").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
        salted = keyed.join(small(hot), "h", "left").withColumn("salt", salt).drop("chunks")
        marked = checkpointed(_stream(salted).filter((F.col("salt") > 0) | recurs))
        chunks = marked.filter("salt > 0").groupBy("h", "salt").agg(F.max("holders").alias("holders"), F.max("owner").alias("owner"))
        whole = chunks.groupBy("h").agg(F.sum("holders").alias("holders"), F.max("owner").alias("owner"))
        parts = marked.filter("salt > 0").drop("holders", "owner").join(small(whole), "h").filter(recurs)
        lost = marked.filter("salt = 0").select("doc_id", "digest", "pos").unionByName(parts.select("doc_id", "digest", "pos"))
    at = lost.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    return at.select("doc_id", "digest", _runs(F.col("at")).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  broadcast_rows: int = 2_000_000) -> DataFrame:
    """``docs`` without the lines that the bitmaps drop, with new columns n_lines (before) and n_dropped.

    Other lines stay, joined by a newline; null text becomes empty.  Further columns stay; the new ones replace
    columns of their names, and names that begin with two underscores are kept for inner use.

    Only the texts of ids that have a bitmap are shuffled, to meet it; ``docs`` is read twice for that, and the ids are
    broadcast, if a count shows at most ``broadcast_rows`` of them.  Beyond that all texts are.  Bitmaps are hashed
    per task, so texts are not sorted.
    """
    bitmaps = checkpointed(bitmaps)
    marks = bitmaps.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"),
                           F.col("dropped").alias("__dropped")).hint("shuffle_hash")
    own = F.col(id_column).cast("long") == F.col("__id")
    same = own & (F.xxhash64(_text(text_column)) == F.col("__digest"))
    lines, dropped = F.split(_text(text_column), "\n", -1), F.col("__dropped")
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["first"] + r["length"]))
    ends = F.concat(F.transform(dropped, lambda r: r["first"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    lost = F.aggregate(dropped, F.lit(0), lambda n, r: n + r["length"])

    def applied(some: DataFrame) -> DataFrame:
        return some.join(marks, same, "left").withColumns({
            text_column: F.when(dropped.isNull(), _text(text_column)).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(lost, F.lit(0)).cast("long"),
        }).drop("__id", "__digest", "__dropped")

    if bitmaps.count() > broadcast_rows:
        return applied(docs)
    ids = F.broadcast(bitmaps.select(F.col("doc_id").alias("__id")))
    whole = docs.join(ids, own, "left_anti").withColumns({
        text_column: _text(text_column), "n_lines": F.size(lines).cast("long"), "n_dropped": F.lit(0).cast("long")})
    return applied(docs.join(ids, own, "left_semi")).unionByName(whole)


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 40,
               min_docs: int = 5) -> DataFrame:
    """``docs`` without recurring lines: :func:`keep_bitmaps` applied."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_column, text_column, min_chars, min_docs), id_column, text_column)
