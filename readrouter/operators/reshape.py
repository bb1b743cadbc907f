"""Offsets, compaction, cycle and segment layout, transposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import base, fastq_record, quality

SEGMENTS = ("R1", "I1", "I2", "R2")


def exclusive_sum(rows: DataFrame, value: str, partition: list[str], order: list[str], name: str, start=0) -> DataFrame:
    """rows with the sum of value over the rows before each one, plus start."""
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, (F.coalesce(F.sum(value).over(before), F.lit(0)) + (F.col(start) if isinstance(start, str) else F.lit(start))).cast("bigint"))


def block_offsets(tiles: DataFrame) -> DataFrame:
    """Where each tile's block starts in its file: the header's size and the blocks before it."""
    return exclusive_sum(tiles, "compressed_size", ["file"], ["i"], "file_offset", "header_size")


def cluster_offsets(tiles: DataFrame) -> DataFrame:
    """The first cluster's number of each tile within its lane and cycle, over the files in order."""
    return exclusive_sum(tiles, "num_clusters", ["lane", "cycle"], ["file", "i"], "cluster_offset")


def compact(clusters: DataFrame) -> DataFrame:
    """Passing clusters with their number among the passing ones of the lane, counted by tile first so that no task holds a lane."""
    passing = clusters.where("pf")
    tiles = exclusive_sum(passing.groupBy("lane", "tile").agg(F.count("*").alias("_n")), "_n", ["lane"], ["tile"], "_start")
    own = Window.partitionBy("lane", "tile").orderBy("cluster")
    return passing.withColumn("_at", F.row_number().over(own) - 1).join(tiles.select("lane", "tile", "_start"), ["lane", "tile"]).withColumn("passed", (F.col("_start") + F.col("_at")).cast("bigint")).drop("_start", "_at")


def segment_positions(cycles: DataFrame) -> DataFrame:
    """cycles (cycle, segment) with the position within the segment."""
    return cycles.withColumn("pos", (F.row_number().over(Window.partitionBy("segment").orderBy("cycle")) - 1).cast("bigint"))


def transpose(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Base-call bytes by cycle to one row for each cluster: sequence and quality."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cycle", c.alias("x")))), lambda z: z["x"]), "")
    return calls.groupBy(*keys).agg(joined(base(F.col("call"))).alias("sequence"), joined(quality(F.col("call"))).alias("quality"))


def cycle_files(cycles: DataFrame, files: DataFrame) -> DataFrame:
    """Every cycle with its files, and whether it lacks one."""
    found = files.groupBy("cycle").agg(F.array_join(F.sort_array(F.collect_list("file")), ",").alias("files"))
    return cycles.join(found, "cycle", "left").withColumn("missing", F.col("files").isNull())


def numbered(routed: DataFrame) -> DataFrame:
    """routed reads with their number within route and lane from 0, in the order of tile and cluster.

    Reads are numbered within route, lane and tile and moved by the counts of the tiles before, so a route that holds most
    reads is spread over its tiles.
    """
    keys = ["route", "lane"]
    tiles = exclusive_sum(routed.groupBy(*keys, "tile").agg(F.count("*").alias("_n")), "_n", keys, ["tile"], "_start")
    own = Window.partitionBy(*keys, "tile").orderBy("cluster")
    return routed.withColumn("_at", F.row_number().over(own) - 1).join(tiles.drop("_n"), [*keys, "tile"]).withColumn("number", (F.col("_start") + F.col("_at")).cast("bigint")).drop("_start", "_at")


def fastq(numbered_reads: DataFrame, paired: bool) -> DataFrame:
    """Records of both mates; record2 is null for single reads."""
    first = fastq_record(F.col("route"), F.col("number"), F.col("sequence"), F.col("quality"), "/1" if paired else "")
    second = fastq_record(F.col("route"), F.col("number"), F.col("read2_sequence"), F.col("read2_quality"), "/2") if paired else F.lit(None).cast("string")
    return numbered_reads.withColumn("record1", first).withColumn("record2", second)
