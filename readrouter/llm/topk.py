"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the signs of a vector's components. It is cut into segments, each with an index from the segment's bits to codes.
A query asks the segments for values at radius 0, 1, 2, ...: with m segments, once all have been asked within radius s - 1 and a of them at
radius s, every code within distance m * s + a - 1 has been met, as otherwise all its segments would differ in more bits than were
asked for. The kth verified distance so far tells how many segments a query must still ask, and codes farther than it are not
taken from a bucket. A query ends when that distance is covered, so results are exact, ties included.

Equal codes are one entry that keeps its k smallest ids, more of which no result can hold; so large groups of equal vectors
neither fill a bucket nor multiply candidates. Ties are broken by the smaller id.

Defined results: a vector that is null, or null or absent in a component, has bit 0 there, as have components that aren't above 0;
a code has as many words of 64 bits as the longest vector asks for; a row with a null id is neither searched nor found; with fewer than k rows all are returned.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Bits of a segment by the logarithm of the number of codes, so that buckets neither fill up nor stay empty.
WIDTHS = ((0, 8), (8, 16), (26, 32))


def code(vector: Column, words: int = 1) -> Column:
    """The signs of the components as an array of words, component i at bit i % 64 of word i // 64."""
    zero = F.lit(0).cast("bigint")
    signs = F.transform(F.coalesce(vector, F.array().cast("array<float>")), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % 64).cast("int"))).otherwise(zero))
    word = lambda w: F.aggregate(F.slice(signs, 64 * w + 1, 64), zero, lambda a, b: a.bitwiseOR(b))
    return F.array(*map(word, range(words)))


def _segments(code: str, count: int, width: int) -> Column:
    """The values of all segments; a width divides 64."""
    place = lambda s: F.shiftrightunsigned(F.col(code)[s * width // 64], s * width % 64).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    return F.array(*map(place, range(count)))


def _distance(a: str, b: str, words: int) -> Column:
    total = F.lit(0)
    for w in range(words):
        total = total + F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w]))
    return total.cast("int")


def search(rows: DataFrame, queries: DataFrame, k: int, words: int = 1, width: int | None = None) -> DataFrame:
    """rows and queries: id (bigint), code (array of so many bigints). Returns query_id, rank, id, distance: the k nearest of all rows by (distance, id)."""
    rows, queries = rows.where(F.col("id").isNotNull()), queries.where(F.col("id").isNotNull())
    # Equal codes once, with the k smallest ids; WindowGroupLimit prunes before the shuffle.
    by_code = Window.partitionBy("code").orderBy("id")
    kept = rows.withColumn("_n", F.row_number().over(by_code)).where(F.col("_n") <= k)
    entries = stage(kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    n = entries.agg(F.sum(F.size("ids"))).first()[0] or 0
    if width is None:
        width = next(w for least, w in reversed(WIDTHS) if entries.count().bit_length() > least or not least)
    bits = 64 * words
    segments, least = bits // width, min(k, n)
    cut = lambda c: _segments(c, segments, width)
    asked = stage(queries.select(F.col("code").alias("_q")).distinct(), "queries")  # equal queries are searched once
    index = stage(entries.select("code", F.size("ids").alias("_rows"), F.col("ids")[0].alias("_first"), F.posexplode(cut("code")).alias("_seg", "_value")), "index")
    waiting, found = asked.withColumn("_bound", F.lit(None).cast("int")), None
    for radius in range(width + 1):
        masks = F.lit([sum(1 << i for i in c) for c in combinations(range(width), radius)]).cast("array<bigint>")
        ask = F.coalesce(F.least(F.lit(segments), F.col("_bound") + 1 - segments * radius), F.lit(segments))
        probe = waiting.select("_q", "_bound", F.posexplode(F.slice(cut("_q"), F.lit(1), ask)).alias("_seg", "_part"))
        probe = probe.select("_q", "_bound", "_seg", F.explode(F.transform(masks, lambda m: F.col("_part").bitwiseXOR(m))).alias("_value"))
        # Spark would guess the probes' size from the queries'; they are dealt by key instead of broadcast.
        met = probe.hint("merge").join(index, ["_seg", "_value"]).withColumn("distance", _distance("_q", "code", words)).where(F.col("distance") <= F.coalesce("_bound", F.lit(bits)))
        met = met.select("_q", "code", "distance", "_rows", "_first").distinct()
        every = met.unionByName(found).dropDuplicates(["_q", "code"]) if found is not None else met
        # A row of the result stands in one of the first k codes by distance and smallest id.
        nearest = Window.partitionBy("_q").orderBy("distance", "_first")
        found = stage(every.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k).drop("_n"), f"found{radius}")
        upto = nearest.rowsBetween(Window.unboundedPreceding, 0)
        kth = found.withColumn("_sum", F.sum("_rows").over(upto)).where(F.col("_sum") >= least).groupBy("_q").agg(F.min("distance").alias("_kth"))
        still = waiting.withColumn("_covered", segments * radius + ask - 1).join(kth, "_q", "left").where(F.col("_kth").isNull() | (F.col("_kth") > F.col("_covered")))
        waiting = stage(still.select("_q", F.col("_kth").alias("_bound")), f"waiting{radius}")
        if not waiting.head(1):
            break
    pairs = found.join(entries, "code").select("_q", "distance", F.explode("ids").alias("id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return queries.select(F.col("id").alias("query_id"), F.col("code").alias("_q")).join(ranked, "_q").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance")


def exact_top_k(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest of all rows, itself included, to every row whose id is divisible by 100."""
    longest = embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    words = max(1, -(-longest // 64))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), code(F.col("embedding"), words).alias("code"))
    return search(rows, rows.where(F.col("id") % 100 == 0), k, words).withColumnRenamed("id", "vec_id")


#: The same in DuckDB by brute force.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) AS b FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.b[i] <> v.b[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM v q, v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
