"""Barcodes to samples: mismatch-tolerant matching as a broadcast hash join.

A sample sheet is small. Every barcode is expanded to all strings within the allowed distance, the nearest barcode of each
string is decided on that small side, and reads, which are never shuffled, look their key up.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import ALPHABET, combined_barcode, hamming

#: Entries of an expanded sheet that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ENTRIES = 2_000_000


def barcode_map(samples: DataFrame, lane_aware: bool = False) -> DataFrame:
    """One row for each barcode: the least order decides ties, the last sample is the one meant.

    samples: ord, sample_id, barcode, lane (0: any). lane_aware: one row for each barcode and lane.
    """
    keys = ["barcode", "lane"] if lane_aware else ["barcode"]
    return samples.groupBy(*keys).agg(F.min("ord").alias("ord"), F.max_by("sample_id", "ord").alias("sample_id"), *([] if lane_aware else [F.max_by("lane", "ord").alias("lane")]))


def with_barcode(samples: DataFrame, flip: bool) -> DataFrame:
    """samples with their combined barcode; a sheet of unequal or empty barcodes is an error."""
    out = samples.withColumn("barcode", combined_barcode(F.col("index1"), F.col("index2"), F.lit(flip)))
    length = F.length("barcode")
    bounds = out.agg(F.min(length).alias("low"), F.max(length).alias("high"), F.countDistinct(F.length("index1")).alias("n")).first()
    if bounds["low"] is None or bounds["low"] == 0:
        raise ValueError("no valid barcodes in the sample sheet")
    if bounds["low"] != bounds["high"] or bounds["n"] != 1:
        raise ValueError("barcodes of different lengths in one sample sheet")
    return out


def neighbourhood(barcodes: DataFrame, length: int, radius: int = 1) -> DataFrame:
    """key, barcode, distance of all strings within the radius of a barcode, each once: substitutions come at rising positions."""
    out = barcodes.select("*", F.col("barcode").alias("key"), F.lit(0).alias("distance"))
    ring = out.withColumn("_at", F.lit(0))
    for distance in range(1, radius + 1):
        ring = ring.where(F.col("_at") < length).withColumn("_at", F.explode(F.sequence(F.col("_at") + 1, F.lit(length))))
        ring = ring.withColumn("_symbol", F.explode(F.array(*map(F.lit, ALPHABET)))).where(F.substring("key", F.col("_at"), F.lit(1)) != F.col("_symbol"))
        key = F.concat(F.substring(F.col("key"), F.lit(1), F.col("_at") - 1), "_symbol", F.substring(F.col("key"), F.col("_at") + 1, F.lit(length)))
        ring = ring.withColumn("key", key).withColumn("distance", F.lit(distance)).drop("_symbol")
        out = out.unionByName(ring.drop("_at"))
    return out


def nearest(barcodes: DataFrame, length: int, radius: int = 1, min_gap: int = 0) -> DataFrame:
    """key, match_ord, match_sample, match_lane, match_dist: the barcode each string belongs to; of equal distances the least order.

    With a min_gap, a string belongs to none if another barcode, even one beyond the radius, is less than min_gap farther than the nearest.
    """
    best = F.min(F.struct("distance", "ord", "sample_id", "lane"))
    grouped = neighbourhood(barcodes, length, reach(radius, min_gap)).groupBy("key")
    found = grouped.agg(best.alias("best"), F.collect_list("distance").alias("_all")).where(F.col("best.distance") <= radius)
    if min_gap:
        found = found.where(_stands_apart(F.col("_all"), min_gap))
    return found.select("key", F.col("best.ord").alias("match_ord"), F.col("best.sample_id").alias("match_sample"), F.col("best.lane").alias("match_lane"), F.col("best.distance").cast("bigint").alias("match_dist"))


def reach(radius: int, min_gap: int) -> int:
    """The distance up to which a runner-up matters."""
    return radius + max(min_gap - 1, 0)


def _stands_apart(distances, min_gap: int):
    return F.size(F.filter(distances, lambda d: d < F.col("best.distance") + min_gap)) == 1


def _small(side: DataFrame, entries: int) -> DataFrame:
    return F.broadcast(side) if entries <= BROADCAST_ENTRIES else side


def match_reads(reads: DataFrame, barcodes: DataFrame, length: int, max_mismatches: int = 1, min_gap: int = 0) -> DataFrame:
    """reads (with a column key) and the match of each; null where none is near enough. barcodes: of barcode_map."""
    wide = reach(max_mismatches, min_gap)
    entries = barcodes.count() * sum(comb(length, i) * (len(ALPHABET) - 1) ** i for i in range(wide + 1))
    if wide <= 1 or entries <= BROADCAST_ENTRIES:
        side = nearest(barcodes, length, max_mismatches, min_gap)
        return reads.join(_small(side, entries), "key", "left")
    if reads.isStreaming:
        raise ValueError(f"{max_mismatches} mismatches with a gap of {min_gap} make {entries} strings of the sheet, too many to route a stream by")
    # Beyond that, distinct keys are compared with the sheet: its barcodes travel as one array, so no pair of a key and a barcode becomes a row.
    keys = reads.select("key").distinct()
    sheet = barcodes.agg(F.sort_array(F.collect_list(F.struct("ord", "barcode", "sample_id", "lane"))).alias("_sheet"))
    entries = sheet.first()["_sheet"]
    listed = F.array(*(F.struct(F.lit(e["ord"]).cast("bigint").alias("ord"), F.lit(e["barcode"]).alias("barcode"), F.lit(e["sample_id"]).alias("sample_id"), F.lit(e["lane"]).alias("lane")) for e in entries))
    scored = F.transform(listed, lambda e: F.struct(hamming(F.col("key"), e["barcode"], length).alias("distance"), e["ord"].alias("ord"), e["sample_id"].alias("sample_id"), e["lane"].alias("lane")))
    near = keys.withColumn("_near", scored).withColumn("best", F.array_min("_near")).where(F.col("best.distance") <= max_mismatches)
    if min_gap:
        near = near.where(_stands_apart(F.transform("_near", lambda e: e["distance"]), min_gap))
    side = near.select("key", F.col("best.ord").alias("match_ord"), F.col("best.sample_id").alias("match_sample"), F.col("best.lane").alias("match_lane"), F.col("best.distance").cast("bigint").alias("match_dist"))
    return reads.join(side, "key", "left")


def lane_fits(asked, lane):
    """A sample of lane 0 takes reads of any lane."""
    return (asked == 0) | (asked == lane)


def orientation_scores(reads: DataFrame, samples: DataFrame, length1: int, length2: int, max_mismatches: int = 1):
    """Matched reads with a fitting lane for both orientations of the second index, in one pass over the reads."""
    from ..functions.bases import read_key

    keyed = reads.select("lane", read_key(F.col("index1"), F.col("index2"), length1, length2).alias("key"))
    for name, flip in (("forward", False), ("flipped", True)):
        matched = match_reads(keyed, barcode_map(with_barcode(samples, flip)), length1 + length2, max_mismatches)
        keyed = matched.withColumn(f"_{name}", F.col("match_lane")).drop("match_ord", "match_sample", "match_lane", "match_dist")
    fits = lambda name: F.coalesce(lane_fits(F.col(f"_{name}"), F.col("lane")), F.lit(False)).cast("bigint")
    return keyed.agg(F.coalesce(F.sum(fits("forward")), F.lit(0)).alias("score_forward"), F.coalesce(F.sum(fits("flipped")), F.lit(0)).alias("score_flipped"))


def choose_orientation(scores: DataFrame, detected: bool = False, try_both: bool = False) -> DataFrame:
    """The scores and the choice: the other orientation is tried where asked for or where the detected one matches nothing, and must be better."""
    own, other = ("score_flipped", "score_forward") if detected else ("score_forward", "score_flipped")
    better = (F.lit(try_both) | (F.col(own) == 0)) & (F.col(other) > F.col(own))
    return scores.withColumn("flip", F.when(better, F.lit(not detected)).otherwise(F.lit(detected)))
