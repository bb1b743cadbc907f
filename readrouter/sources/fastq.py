"""FASTQ files by sample and lane: <sample>_L<lane>_R<mate>_001.fastq, gzipped where asked for.

Each task writes its share of a file as a part (for gzip a member of its own) under a hidden folder. `write` then joins the parts in a second
distributed pass: every file is made with its full size and each task writes its parts at their places, so neither the driver nor one task
copies a whole file. Records are numbered before the write, so a route that holds most reads is written by many tasks. A task that is
tried again writes parts of another name, and only those of committed tasks are joined; a place may be written twice with the same bytes.
"""

from __future__ import annotations

import gzip
import json
import os
import shutil
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.reshape import fastq, numbered
from ..operators.routing import UNDETERMINED

#: Records of one part of a file.
PART_RECORDS = 1 << 20


@dataclass
class Parts(WriterCommitMessage):
    """(file name, part number, path of the part)."""

    parts: list


class FastqWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, zipped: bool, overwrite: bool, manifest: str | None):
        self.folder, self.zipped, self.manifest = folder, zipped, manifest
        self.hidden = os.path.join(folder, f".writing-{uuid.uuid4().hex}")
        if os.path.isdir(folder) and os.listdir(folder) and not overwrite:
            raise FileExistsError(f"{folder}: not empty; write with mode 'overwrite'")

    def write(self, batches):
        os.makedirs(self.hidden, exist_ok=True)
        opener = (lambda p: gzip.open(p, "ab")) if self.zipped else (lambda p: open(p, "ab"))
        here, parts = uuid.uuid4().hex, {}
        for batch in batches:
            held: dict[tuple[str, int], list[str]] = {}
            for name, ending, part, one, two in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "ending", "part", "record1", "record2"))):
                held.setdefault((f"{name}_R1{ending}", part), []).append(one)
                if two is not None:
                    held.setdefault((f"{name}_R2{ending}", part), []).append(two)
            for (name, part), records in held.items():
                path = parts.setdefault((name, part), os.path.join(self.hidden, f"{here}-{len(parts)}"))
                with opener(path) as f:
                    f.write(("\n".join(records) + "\n").encode())
        return Parts([(name, part, path) for (name, part), path in parts.items()])

    def commit(self, messages):
        by_file: dict[str, list] = {}
        for m in messages:
            for name, part, path in m.parts if m is not None else ():
                by_file.setdefault(name, []).append((part, path))
        os.makedirs(self.folder, exist_ok=True)
        ending = ".fastq.gz" if self.zipped else ".fastq"
        files = {name + ending: [path for _, path in sorted(parts)] for name, parts in by_file.items()}
        if self.manifest:
            with open(self.manifest, "w", encoding="utf-8") as f:
                json.dump({"hidden": self.hidden, "files": files}, f)
            return
        for name, paths in files.items():
            out = os.path.join(self.folder, name)
            with open(out + ".tmp", "wb") as f:
                for path in paths:
                    with open(path, "rb") as g:
                        shutil.copyfileobj(g, f)
            os.replace(out + ".tmp", out)
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.hidden, ignore_errors=True)


class FastqFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_files"

    def writer(self, schema, overwrite: bool):
        return FastqWriter(self.options["path"].removeprefix("file://"), self.options.get("gzip", "false").lower() == "true", overwrite, self.options.get("manifest"))


def records(routed: DataFrame, paired: bool, naming: str = "lanes") -> DataFrame:
    """name, ending, part, number, record1, record2 of every routed read."""
    if naming not in ("lanes", "samples"):
        raise ValueError("naming is 'lanes' or 'samples'")
    out = fastq(numbered(routed), paired)
    if naming == "samples":
        # Lanes follow each other in a sample's file; records keep the numbers of their lane.
        name, first = F.when(F.col("route") == UNDETERMINED, "Undetermined").otherwise(F.col("route")), F.col("lane") * F.lit(1 << 24)
    else:
        name, first = F.concat("route", F.lit("_"), F.format_string("L%03d", F.col("lane"))), F.lit(0)
    part = (first + F.floor(F.col("number") / PART_RECORDS)).cast("bigint")
    return out.select(name.alias("name"), F.lit("_001" if naming == "lanes" else "").alias("ending"), part.alias("part"), "number", "record1", "record2")


def write(routed: DataFrame, folder: str, paired: bool, zipped: bool = False, naming: str = "lanes") -> None:
    """Write the files of every route and lane; groups without reads have none.

    naming: "lanes" (<sample>_L<lane>_R<mate>_001) or "samples" (<sample>_R<mate>, Undetermined_R<mate>: one file for all lanes).
    """
    spark, folder = routed.sparkSession, folder.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    manifest = os.path.join(folder, f".parts-{uuid.uuid4().hex}.json")
    ordered = records(routed, paired, naming).repartition("name", "part").sortWithinPartitions("name", "part", "number")
    ordered.write.format("fastq_files").mode("overwrite").option("gzip", str(zipped).lower()).option("manifest", manifest).save(folder)
    with open(manifest, encoding="utf-8") as f:
        found = json.load(f)
    join_parts(spark, folder, found["files"])
    shutil.rmtree(found["hidden"], ignore_errors=True)
    os.unlink(manifest)


def join_parts(spark, folder: str, files: dict[str, list[str]]) -> None:
    """Make each file of its parts: the driver only sets sizes and places, tasks copy the bytes."""
    rows = []
    for name, paths in files.items():
        out, at = os.path.join(folder, name + ".tmp"), 0
        for path in paths:
            rows.append((path, out, at))
            at += os.path.getsize(path)
        with open(out, "wb") as f:
            f.truncate(at)
    if rows:
        parts = spark.createDataFrame(rows, "path string, out string, at bigint").repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))
        copied = parts.mapInArrow(_copy_parts, "n bigint").agg(F.sum("n").alias("n")).first()["n"]
        if copied != len(rows):
            raise OSError(f"{copied} of {len(rows)} parts were copied")
    for name in files:
        os.replace(os.path.join(folder, name + ".tmp"), os.path.join(folder, name))


def _copy_parts(batches):
    for batch in batches:
        for path, out, at in zip(*(c.to_pylist() for c in batch.columns)):
            with open(path, "rb") as g, open(out, "r+b") as f:
                f.seek(at)
                shutil.copyfileobj(g, f)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
