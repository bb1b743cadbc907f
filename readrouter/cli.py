"""python -m readrouter.cli --input RUN --samplesheet SHEET --output FOLDER"""

from __future__ import annotations

import argparse
import os
import shutil

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.matching import choose_orientation, orientation_scores
from .operators.routing import demultiplex
from .operators.stats import barcode_histogram, first_barcodes, match_totals, sample_summary
from .sources import fastq, runs, samplesheet
from .sources.runinfo import flipped_index2, load_structure

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readrouter", description="Sequencer run to per-sample FASTQ files")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--input", required=True, help="run folder")
    p.add_argument("--samplesheet", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--gzip", action="store_true")
    p.add_argument("--batch-size", type=int, default=65536, help="clusters in an Arrow batch")
    p.add_argument("--i5-rc", choices=("auto", "true", "false"), default="auto")
    p.add_argument("--try-both-i5", action="store_true")
    p.add_argument("--max-mismatches", type=int, default=1)
    p.add_argument("--min-gap", type=int, default=0)
    p.add_argument("--duplicate-barcodes", choices=("last", "lane_aware"), default="last")
    p.add_argument("--min-quality", type=int)
    p.add_argument("--least-fraction", type=float, default=0.0)
    p.add_argument("--adapter", help="cut reads at this sequence")
    p.add_argument("--barcode-counts", type=int, metavar="N", help="print the most frequent indexes of the first N reads")
    p.add_argument("--reads", help="folder that keeps the decoded reads as Parquet; without it they are kept beside the output while the job runs")
    p.add_argument("--naming", choices=("lanes", "samples"), default="lanes")
    p.add_argument("--positional-sheet", action="store_true", help="read the sample sheet by position")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    runs.register(spark)
    structure = load_structure(args.input)
    samples = samplesheet.load(spark, args.samplesheet, args.positional_sheet)
    # The run is decoded once; orientation, files and counts read what was decoded.
    decoded = args.reads or f"{os.path.abspath(args.output)}.reads"
    spark.read.format("base_calls").option("clusters_per_batch", args.batch_size).load(args.input).write.mode("overwrite").parquet(decoded)
    try:
        _route(spark, args, spark.read.parquet(decoded), samples, structure)
    finally:
        if not args.reads:
            shutil.rmtree(decoded, ignore_errors=True)


def _route(spark: SparkSession, args: argparse.Namespace, reads, samples, structure) -> None:
    flip = flipped_index2(args.input, args.i5_rc)
    if args.barcode_counts is not None:
        barcode_histogram(reads, args.barcode_counts).orderBy("kind", "rank").show(200, False)
        first_barcodes(samples).show(20, False)
    lengths = samples.select(F.length("index1").alias("a"), F.length("index2").alias("b")).first()
    flip = choose_orientation(orientation_scores(reads, samples, lengths["a"], lengths["b"], args.max_mismatches), flip, args.try_both_i5).first()["flip"]
    routed = demultiplex(reads, samples, flip, args.max_mismatches, args.min_gap, args.duplicate_barcodes, args.min_quality, args.least_fraction, args.adapter)
    fastq.write(routed, args.output, structure.paired, args.gzip, args.naming)
    sample_summary(routed, samples).orderBy("ord").show(1000, False)
    match_totals(routed).show()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("readrouter").getOrCreate()
    try:
        run(spark, args)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
