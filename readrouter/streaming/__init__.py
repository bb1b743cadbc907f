"""Reads that arrive as files, routed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.routing import demultiplex


def arriving_reads(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """Reads of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def route_stream(reads: DataFrame, samples: DataFrame, out: str, checkpoint: str, **options):
    """Route arriving reads into Parquet files by route; without state, so each file is routed once. Returns the query's writer."""
    routed = demultiplex(reads, samples, **options)
    return routed.writeStream.format("parquet").partitionBy("route").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
