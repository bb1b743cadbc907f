"""Best-fit packing by minimum bin slack.

Documents become pieces of at most `capacity` tokens. Pieces of one length are alike, so bins are planned on the histogram of
lengths, at most `capacity` counts whatever the corpus: the longest remaining length opens a bin, a bitset subset-sum over the lengths
that are left finds the fullest combination for the rest of it, and the combination is removed as often as the counts allow.
Each piece then takes the place of its rank among the pieces of its length. Ranks come from counts by length and a hash
bucket of the id, so that a length that a third of all pieces share is spread.

Defined results: null text counts as empty, which makes one piece of the end token alone; repeated rows are packed each; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .common import map_arrow, partitions, stage

CAPACITY = 2048
#: Rows of a plan that may be broadcast (56 bytes each).
BROADCAST_SLOTS = 500_000
#: Ranks of one length that share a key of the join with the plan, so that neither a common length nor its slots meet in one place.
BLOCK = 1 << 16
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cut(batches, path, capacity, end):
    encode, end = encoder(path), np.uint32(end).astype("<u4").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), encode.many(batch.column(1).to_pylist())):
            ids += end
            n = len(ids) // 4
            first = (n - 1) % capacity + 1
            for k, (start, stop) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity))):
                rows.append((doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill `room` best; of equal fillings one with long pieces."""
    if room <= 0:
        return {}
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        before, left, k = bits, min(counts[length], room // length), 1
        steps.append((length, left, before))
        while left:
            take = min(k, left)
            bits |= (bits << (take * length)) & mask
            left, k = left - take, 2 * k
        if bits >> room & 1:
            break
    at, chosen = bits.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        n = next(n for n in range(most + 1) if n * length <= at and before >> (at - n * length) & 1)
        if n:
            chosen[length] = n
            at -= n * length
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, number of bins) until no piece is left."""
    left, bins = {x: n for x, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        bins.append((chosen, times))
        for x, n in chosen.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return bins


def places(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, pieces of the length in a bin, offset of the first of them)."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for chosen, times in bins:
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            rank = used.get(length, 0)
            rows.append((length, rank, rank + n * times, first, n, offset))
            used[length] = rank + n * times
            offset += n * length
        first += times
    return rows


def cut(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = 0) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32. The first piece takes what whole ones leave."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(docs, partial(_cut, path=path or vocabulary_path(), capacity=capacity, end=end), PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length at least) with sequence_id and offset."""
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    dealt = pieces.select(*columns, F.pmod(F.xxhash64("doc_id"), F.lit(partitions(spark))).alias("_bucket"))
    counts = stage(dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if any(x > capacity or x < 1 for x in histogram):
        raise ValueError(f"a piece is not within 1 to {capacity} tokens")
    slots = places(plan(histogram, capacity))
    # A slot stands once in each block of ranks that it touches.
    block = lambda rank: F.floor(rank / BLOCK).cast("bigint")
    table = spark.createDataFrame(slots, "_length bigint, _from bigint, _to bigint, _bin bigint, _each bigint, _offset bigint")
    table = table.withColumn("_block", F.explode(F.sequence(block(F.col("_from")), block(F.col("_to") - 1))))
    size = sum((to - 1) // BLOCK - first // BLOCK + 1 for _, first, to, *_ in slots)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_at", F.row_number().over(own) - 1).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_at"))
    # Each combination uses up a length but for fewer pieces than it takes of it, so slots are bounded by capacity and its logarithm; blocks add the pieces / BLOCK.
    fits = (F.col("length") == F.col("_length")) & (block(F.col("_rank")) == F.col("_block")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(F.broadcast(table) if size <= BROADCAST_SLOTS else table, fits)
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        *columns,
        (F.col("_bin") + F.floor(nth / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).cast("bigint").alias("offset"),
    )


def best_fit(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The op8 contract: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stage(cut(documents, capacity, path), "pieces"), capacity)
