"""Counts and summaries over reads, clusters and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import reverse_complement
from .routing import CONTAMINATED, UNDETERMINED


def sample_summary(routed: DataFrame, samples: DataFrame) -> DataFrame:
    """ord, sample_id, reads of every sample, zeros too."""
    counts = routed.groupBy("route").agg(F.count("*").alias("reads"))
    return samples.join(counts, samples["sample_id"] == counts["route"], "left").select("ord", "sample_id", F.coalesce("reads", F.lit(0)).alias("reads"))


def match_totals(routed: DataFrame) -> DataFrame:
    """Matched and unmatched reads, those with adapters among the unmatched, and how many hold one."""
    matched = ~F.col("route").isin(CONTAMINATED, UNDETERMINED)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return routed.agg(count(matched).alias("matched"), count(~matched).alias("unmatched"), count(F.col("has_adapter")).alias("with_adapter"), F.count("*").alias("total"))


def reads_per_lane(reads: DataFrame) -> DataFrame:
    """Reads of each lane, and of all lanes at lane 0; reads without a lane keep a null, and a lane 0 of its own is marked by all_lanes."""
    counts = reads.rollup("lane").agg(F.count("*").alias("reads"), F.grouping("lane").alias("_all"))
    return counts.select(F.when(F.col("_all") == 1, 0).otherwise(F.col("lane")).cast("bigint").alias("lane"), (F.col("_all") == 1).alias("all_lanes"), "reads")


def first_reads(reads: DataFrame, n: int = 200_000) -> DataFrame:
    """The first n reads in the order of lane, tile and cluster; n of 0 or less is all."""
    return reads.orderBy("lane", "tile", "cluster").limit(n) if n > 0 else reads


def barcode_histogram(reads: DataFrame, n: int = 200_000, top: int = 50) -> DataFrame:
    """The most frequent index strings of the first n reads, of each kind: kind, key, n, pct."""
    i1, i2 = F.col("index1"), F.col("index2")
    both = (i1 != "") & (i2 != "")
    kinds = F.array(
        F.struct(F.lit("I1").alias("kind"), F.when(i1 != "", i1).alias("key")),
        F.struct(F.lit("I2").alias("kind"), F.when(i2 != "", i2).alias("key")),
        F.struct(F.lit("I1+I2").alias("kind"), F.when(both, F.concat(i1, i2)).alias("key")),
        F.struct(F.lit("I1+rc(I2)").alias("kind"), F.when(both, F.concat(i1, reverse_complement(i2))).alias("key")),
    )
    counts = first_reads(reads, n).select(F.explode(kinds).alias("k")).where("k.key is not null").groupBy("k.kind", "k.key").agg(F.count("*").alias("n"))
    share = counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6))
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "key")
    return share.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)


def first_barcodes(samples: DataFrame, n: int = 20) -> DataFrame:
    return samples.orderBy("ord").limit(n)


def filter_stats(clusters: DataFrame) -> DataFrame:
    """Clusters and passing clusters of each lane and tile."""
    return clusters.groupBy("lane", "tile").agg(F.count("*").alias("clusters"), F.sum(F.col("pf").cast("bigint")).alias("passing"))


def raw_clusters(tiles: DataFrame) -> DataFrame:
    """Clusters before the filter: those of the tiles of each lane's first cycle."""
    first = Window.partitionBy("lane")
    return tiles.withColumn("_first", F.min("cycle").over(first)).where("cycle = _first").groupBy("lane").agg(F.sum("num_clusters").alias("raw_clusters"))


def segment_lengths(cycles: DataFrame) -> DataFrame:
    return cycles.groupBy("segment").agg(F.count("*").alias("length"))


def count_check(cycles: DataFrame) -> DataFrame:
    """Of each lane, whether all cycles have as many clusters."""
    return cycles.groupBy("lane").agg(F.countDistinct("clusters").alias("counts"), F.min("clusters").alias("low"), F.max("clusters").alias("high")).withColumn("consistent", F.col("counts") == 1)


def telemetry_summary(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Average, least and greatest of a value without NaN, and its rise where there are two samples or more."""
    real = samples.where(F.col(value).isNotNull() & ~F.isnan(value))
    return real.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.round(F.when(F.count("*") >= 2, F.max(value) - F.min(value)), 6).alias("delta"))


def folder_sizes(spark, folder: str) -> DataFrame:
    """Bytes under a folder, from the listing alone."""
    return folder_bytes(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def folder_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
