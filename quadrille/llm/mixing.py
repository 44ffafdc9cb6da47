"""Operator 8: mix overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import checkpointed

#: Words as the contract counts them.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: tuple[int, ...], most: int, total: int) -> list[float]:
    """Shares of ``total`` by weight, repeating; a share stops at ``most`` times its size, the excess is shared again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    open_, target = set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left, weight = total - sum(target), sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / weight > most * sizes[i]]
        for i in over or open_:
            target[i] = float(most * sizes[i]) if over else left * w[i] / weight
        open_ = open_ - set(over) if over else set()
    return target


def route(capacity: list[int], member: list[list[int]], quota: list[float], most: int) -> list[dict[int, float]]:
    """Min-cost flow of words from patterns to sources: words that pattern p gives to source s.

    Pattern p has ``capacity[p]`` words and may feed the sources in ``member[p]``; its k-th repetition of the
    capacity costs k - 1 a word for k from 1 to ``most``, which is convex, so a pattern is used again only where no
    word that was used less often can reach the quota.  Successive shortest augmenting paths, over sources as
    nodes joined by the patterns they share.
    """
    flow = [{s: 0.0 for s in m} for m in member]
    holds: list[list[int]] = [[] for _ in quota]
    for p, m in enumerate(member):
        for s in m:
            holds[s].append(p)
    for s in range(len(quota)):
        need = quota[s]
        while need > 1e-6:
            # cheapest way to reach source s: from a pattern with room, through words that other sources hand on
            dist, via, heap = {s: 0.0}, {}, [(0.0, s)]
            best = (float("inf"), -1, -1)
            done = set()
            while heap:
                d, at = heapq.heappop(heap)
                if at in done or d >= best[0]:
                    continue
                done.add(at)
                for p in holds[at]:
                    if not capacity[p]:
                        continue
                    used = sum(flow[p].values())
                    level = int(used / capacity[p] + 1e-9)
                    if level < most and d + level < best[0]:
                        best = (d + level, p, at)
                    for other in member[p]:
                        if other != at and flow[p][other] > 1e-9 and d < dist.get(other, float("inf")):
                            dist[other], via[other] = d, (p, at)
                            heapq.heappush(heap, (d, other))
            if best[1] < 0:
                break
            _, p, at = best
            used = sum(flow[p].values())
            step = min(need, (int(used / capacity[p] + 1e-9) + 1) * capacity[p] - used)
            hops, x = [], at
            while x != s:
                hops.append((x, *via[x]))
                step = min(step, flow[via[x][0]][x])
                x = via[x][1]
            flow[p][at] += step
            for x, q, nearer in hops:
                flow[q][x] -= step
                flow[q][nearer] += step
            need -= step
    return flow


def mix(docs: DataFrame, sources: Column, size: Column, id_column: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1),
        most: int = 3, seed: int = 42, bits: int = 16, max_patterns: int = 20_000) -> DataFrame:
    """``docs`` with new columns size, pattern, source_size, target and taken.

    ``sources`` is an array of names, the sources a document belongs to; none and null make the null source.
    Sources in order of code point, null last, weigh ``weights``, repeating, and share the sum of all sizes;
    a target stops at ``most`` times the size of its source.  Documents are summed by membership pattern.  The
    flow (:func:`route`) gives every pattern the words it is to yield: that many whole rounds of all its documents,
    and for the rest documents in the order of a seeded hash of their id, until the words come nearest.  taken is
    the document's size times its rounds.  For one source a document, source_size and target are its source's; for
    several, sums over its sources.

    Only the sums a pattern reach the driver; more than ``max_patterns`` of them raise.  The order within a
    pattern is not sorted as a whole: sums by the top ``bits`` of the hash find the bucket in which the quota runs
    out, and only that bucket is ranked, by hash and id.  Null sizes and ids: size null is 0; a null id hashes like
    any other.  Rows that repeat id and pattern take the same fate up to the cut and may differ there.  Empty
    tables give empty results.  No sum of sizes: targets and taken are 0.  Further columns stay; the new ones replace
    columns of their names, and names that begin with two underscores are kept for inner use.
    """
    names = F.array_sort(F.array_distinct(F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda s: s.isNotNull())))
    order = F.xxhash64(F.lit(seed), F.col(id_column))
    base = docs.withColumns({"size": F.coalesce(size.cast("long"), F.lit(0)), "pattern": names, "__order": order})
    base = base.drop("source_size", "target", "taken")
    base = base.withColumn("__bucket", F.shiftrightunsigned("__order", 64 - bits))
    light = checkpointed(base.select(F.col(id_column).alias("__id"), "pattern", "size", "__order", "__bucket"))
    sums = checkpointed(light.groupBy("pattern", "__bucket").agg(F.sum("size").alias("words")))
    rows = sums.groupBy("pattern").agg(F.sum("words").alias("words")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    known = sorted({s for r in rows for s in r["pattern"]}, key=lambda s: s.encode("utf-8"))
    known += [None] if any(not r["pattern"] for r in rows) else []
    place = {s: i for i, s in enumerate(known)}
    member = [[place[s] for s in r["pattern"]] or [place[None]] for r in rows]
    capacity = [r["words"] for r in rows]
    # a document of several sources counts in each; targets share the words that there are
    sizes = [sum(c for c, m in zip(capacity, member) if i in m) for i in range(len(known))]
    total = sum(capacity)
    shares = capped_targets(sizes, weights, most, total)
    flow = route(capacity, member, shares, most)
    plan = [(list(r["pattern"]), sum(sizes[i] for i in m), sum(shares[i] for i in m),
             int(min(most, sum(f.values()) / c + 1e-9)) if c else 0,
             0.0 if not c else max(0.0, sum(f.values()) - int(min(most, sum(f.values()) / c + 1e-9)) * c))
            for r, m, f, c in zip(rows, member, flow, capacity)]
    schema = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("source_size", T.LongType()),
                           T.StructField("target", T.DoubleType()), T.StructField("__rounds", T.LongType()),
                           T.StructField("__rest", T.DoubleType())])
    plan = F.broadcast(docs.sparkSession.createDataFrame(plan, schema))  # at most max_patterns rows
    upto = Window.partitionBy("pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(upto), F.lit(0))
    cuts = (sums.withColumn("__before", before).join(plan, "pattern")
            .filter((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("words") >= F.col("__rest")))
            .groupBy("pattern").agg(F.min("__bucket").alias("__cut"), F.min("__before").alias("__before")))
    cuts = F.broadcast(checkpointed(cuts))  # one row a pattern at most
    routed = base.join(plan, "pattern", "left").join(cuts, "pattern", "left")
    inside = F.when(F.col("__cut").isNull() | (F.col("size") == 0), F.lit(0)).when(F.col("__bucket") < F.col("__cut"), F.lit(1))
    # ranked alone: about one document in 2 ** bits of a pattern
    edge = light.join(cuts, "pattern").filter("__bucket = __cut and size > 0")
    along = Window.partitionBy("pattern").orderBy("__order", "__id").rowsBetween(Window.unboundedPreceding, -1)
    edge = (edge.withColumn("__sum", F.col("__before") + F.coalesce(F.sum("size").over(along), F.lit(0)))
            .join(plan, "pattern").filter(F.col("__rest") - F.col("__sum") > F.col("size") / 2)
            .select(F.col("pattern").alias("__p"), F.col("__order").alias("__o")).distinct())
    edge = F.broadcast(edge.groupBy("__p").agg(F.max("__o").alias("__o")))
    routed = routed.join(edge, F.col("pattern") == F.col("__p"), "left")
    last = (F.col("__bucket") == F.col("__cut")) & (F.col("__order") <= F.col("__o"))
    extra = F.coalesce(inside, F.when(last, F.lit(1)), F.lit(0))
    return routed.withColumn("taken", (F.col("size") * (F.col("__rounds") + extra)).cast("long")).drop(
        "__order", "__bucket", "__rounds", "__rest", "__cut", "__before", "__p", "__o")
