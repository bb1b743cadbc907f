"""Where a read goes: adapter contamination first, then its sample if the lane fits, else undetermined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import has_adapter, quality_fraction, read_key, trim_position
from .matching import barcode_map, lane_fits, match_reads, with_barcode

CONTAMINATED, UNDETERMINED = "adapter_contamination", "undetermined"


def route(matched: DataFrame) -> DataFrame:
    """matched reads with has_adapter and route."""
    fits = F.col("match_sample").isNotNull() & lane_fits(F.col("match_lane"), F.col("lane"))
    out = matched.withColumn("has_adapter", has_adapter(F.col("sequence")))
    return out.withColumn("route", F.when(F.col("has_adapter"), CONTAMINATED).when(fits, F.col("match_sample")).otherwise(UNDETERMINED))


def demultiplex(reads: DataFrame, samples: DataFrame, flip: bool = False, max_mismatches: int = 1, min_gap: int = 0, duplicate_barcodes: str = "last", min_quality: int | None = None, least_fraction: float = 0.0, trim: str | None = None) -> DataFrame:
    """reads with match columns, has_adapter and route. samples: ord, sample_id, index1, index2, lane.

    duplicate_barcodes: "last" (the last row of a barcode stands for it, and its lane is tested afterwards) or "lane_aware" (a barcode's rows of
    different lanes are matched in their own lanes). min_quality with least_fraction drops reads; trim cuts reads at that adapter.
    """
    if duplicate_barcodes not in ("last", "lane_aware"):
        raise ValueError("duplicate_barcodes is 'last' or 'lane_aware'")
    if min_quality is not None:
        reads = reads.where(quality_fraction(F.col("quality"), min_quality) >= least_fraction)
    if trim:
        reads = reads.withColumn("_cut", trim_position(F.col("sequence"), trim))
        reads = reads.withColumns({c: F.substring(F.col(c), F.lit(1), F.col("_cut")) for c in ("sequence", "quality")}).drop("_cut")
    coded = with_barcode(samples, flip)
    head = coded.select(F.length("index1").alias("a"), F.length("barcode").alias("n")).first()
    keyed = reads.withColumn("key", read_key(F.col("index1"), F.col("index2"), head["a"], head["n"] - head["a"]))
    if duplicate_barcodes == "last":
        return route(match_reads(keyed, barcode_map(coded), head["n"], max_mismatches, min_gap))
    # Every lane that some sample names has a sheet of its own, with the samples of any lane; reads of other lanes have these alone.
    lanes = sorted(r["lane"] for r in coded.select("lane").distinct().where("lane <> 0").collect())
    parts = []
    for lane in [*lanes, None]:
        sheet = coded.where((F.col("lane") == 0) | (F.col("lane") == lane)) if lane is not None else coded.where("lane = 0")
        own = keyed.where(F.col("lane") == lane) if lane is not None else keyed.where(~F.col("lane").isin(lanes)) if lanes else keyed
        parts.append(match_reads(own, barcode_map(sheet), head["n"], max_mismatches, min_gap))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return route(out)
