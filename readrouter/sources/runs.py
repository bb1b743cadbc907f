"""Run folders as a Spark data source: spark.read.format("base_calls").load(folder).

A partition is a range of clusters of one tile (of a whole lane in the older format). A block can only be inflated from its beginning, so a
task inflates those of all cycles side by side and takes clusters_per_part clusters of them at a time (4,096 at least, which is less than the
inflaters hold), masked by the filter, turned from cycles to reads and sent as Arrow batches: it holds cycles times that many bytes and the tile's
filter. Where tiles are few, several tasks share one, and each passes over what stands before its range; their number doesn't grow with the
tile. Planning reads only headers, tile lists and counts. The folder must be a path that driver and executors share.

Options: lanes, tiles (comma-separated, to read only those), quality_map (linear or header), mode (FAILFAST or PERMISSIVE: a bad
block decodes as N and !), clusters_per_batch, clusters_per_part.
"""

from __future__ import annotations

import glob
import os
import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import binfmt
from .runinfo import I1, I2, R1, R2, RunStructure, load_structure

SCHEMA = "lane int, tile int, cluster bigint, sequence string, quality string, index1 string, index2 string, read2_sequence string, read2_quality string"
HEADER_BYTES = 1 << 16
#: Clusters of a tile that a task decodes at once, and the least that it does.
CLUSTERS_PER_PART, LEAST_CLUSTERS = 1 << 19, 1 << 12
#: Tasks that a run's tiles are dealt to where they are fewer, but so many to a tile at most: a tile's blocks are inflated half as many times over.
TASKS, TASKS_PER_TILE = 32, 8


def base_calls_folder(folder: str) -> str:
    return os.path.join(folder, "Data", "Intensities", "BaseCalls")


def lane_folders(folder: str) -> list[tuple[int, str]]:
    """(lane, folder) in order; the base-call folder itself where there is none by lane."""
    top = base_calls_folder(folder)
    found = sorted(d for d in glob.glob(os.path.join(top, "L00*")) if os.path.isdir(d))
    number = lambda d: int(m[1]) if (m := re.match(r"L0*(\d+)$", os.path.basename(d))) else 1
    return [(number(d), d) for d in found] or [(1, top)]


def cycle_folders(lane_folder: str) -> dict[int, str]:
    found = {}
    for d in sorted(glob.glob(os.path.join(lane_folder, "C*"))):
        if m := re.match(r"C(\d+)\.\d+$", os.path.basename(d)):
            found[int(m[1])] = d
    return found


def detect(folder: str) -> str:
    """"cbcl" where any such file exists, else "bcl"."""
    top = base_calls_folder(folder)
    for kind, pattern in (("cbcl", "*.cbcl"), ("bcl", "*.bcl.gz")):
        for deep in ("", "L00*", os.path.join("L00*", "C*"), "C*"):
            if glob.glob(os.path.join(top, deep, pattern)):
                return kind
    raise FileNotFoundError(f"{top}: neither .cbcl nor .bcl.gz files")


def filters(lane: int, folder: str) -> list[str]:
    for pattern in (f"s_{lane}_*.filter", "s_1_*.filter", "s_1.filter"):
        if found := sorted(glob.glob(os.path.join(folder, pattern))):
            return found
    raise FileNotFoundError(f"{folder}: no filter files")


def _read(path: str, at: int = 0, n: int = -1) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        return f.read(n)


def tile_table(path: str) -> tuple[binfmt.Header, list[binfmt.Tile]]:
    data = _read(path, 0, HEADER_BYTES)
    header = binfmt.read_header(data, path)
    if header.tiles_at + 16 * header.num_tiles > len(data):
        data = _read(path, 0, header.tiles_at + 16 * header.num_tiles)
    return header, binfmt.read_tiles(data, header, path)


class TilePart(InputPartition):
    """Clusters low to high of a tile, step at a time: by cycle where its block lies (path, offset, size; None where it is missing) and where its filter lies."""

    def __init__(self, lane, tile, clusters, blocks, quality, filter_path, filter_at, kind, low=0, high=None, step=CLUSTERS_PER_PART):
        super().__init__((lane, tile, low))
        self.lane, self.tile, self.clusters, self.blocks = lane, tile, clusters, blocks
        self.low, self.high, self.step = low, clusters if high is None else high, step
        self.quality, self.filter_path, self.filter_at, self.kind = quality, filter_path, filter_at, kind


class RunReader(DataSourceReader):
    def __init__(self, folder: str, options: dict):
        self.folder, self.options = folder, options
        self.structure: RunStructure = load_structure(folder)
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def _chosen(self, name: str):
        given = self.options.get(name)
        return {int(x) for x in given.split(",")} if given else None

    def partitions(self):
        lanes, tiles = self._chosen("lanes"), self._chosen("tiles")
        kind, parts = detect(self.folder), []
        for lane, folder in lane_folders(self.folder):
            if lanes is None or lane in lanes:
                parts += self._cbcl_lane(lane, folder) if kind == "cbcl" else self._bcl_lane(lane, folder)
        parts = [p for p in parts if tiles is None or p.tile in tiles]
        share = min(-(-TASKS // max(len(parts), 1)), TASKS_PER_TILE)
        return [q for p in parts for q in self._ranges(p, share)]

    def _ranges(self, part: "TilePart", share: int) -> list["TilePart"]:
        step = max(int(self.options.get("clusters_per_part", CLUSTERS_PER_PART)), LEAST_CLUSTERS)
        step += step % 2  # a range begins with a whole byte
        own = max(-(-part.clusters // (step * share)), 1) * step
        cut = lambda low: TilePart(part.lane, part.tile, part.clusters, part.blocks, part.quality, part.filter_path, part.filter_at, part.kind, low, min(low + own, part.clusters), step)
        return [cut(low) for low in range(0, max(part.clusters, 1), own)]

    def _cbcl_lane(self, lane: int, folder: str):
        blocks: dict[tuple[str, int], dict[int, tuple]] = {}
        counts, values, order = {}, {}, []
        by_cycle = cycle_folders(folder)
        for cycle in range(1, self.structure.cycles + 1):
            files = sorted(glob.glob(os.path.join(by_cycle[cycle], "*.cbcl"))) if cycle in by_cycle else []
            if not files:
                warnings.warn(f"lane {lane}: cycle {cycle} has no files; it decodes as N", stacklevel=2)
            for path in files:
                header, tiles = tile_table(path)
                for t in tiles:
                    if counts.setdefault(t.tile, t.clusters) != t.clusters:
                        raise binfmt.FormatError(f"{path}: tile {t.tile} has {t.clusters} clusters, in another cycle {counts[t.tile]}")
                    if t.tile not in blocks:
                        order.append(t.tile)
                    blocks.setdefault(t.tile, {})[cycle] = (path, t.offset, t.packed_size)
                    values[t.tile] = tuple(binfmt.quality_values(header, self.options.get("quality_map", "linear")).tolist())
        found, at = filters(lane, folder), 0
        named = {int(m[1]): p for p in found if (m := re.match(r"s_\d+_(\d+)\.filter$", os.path.basename(p)))}
        parts = []
        # Files that don't name every tile hold the clusters of all tiles one after another, in the order of their names.
        whole = not all(tile in named for tile in order)
        for tile in order:
            path, start = (tuple(found), at) if whole else ((named[tile],), -1)
            at += counts[tile]
            parts.append(TilePart(lane, tile, counts[tile], [blocks[tile].get(c) for c in range(1, self.structure.cycles + 1)], values[tile], path, start, "cbcl"))
        return parts

    def _bcl_lane(self, lane: int, folder: str):
        by_cycle, blocks = cycle_folders(folder), []
        for cycle in range(1, self.structure.cycles + 1):
            names = [os.path.join(by_cycle.get(cycle, os.path.join(folder, f"C{cycle}.1")), n) for n in (f"L{lane:03d}_1.bcl.gz", f"{os.path.basename(folder)}_1.bcl.gz", "s_1_1101.bcl.gz")]
            path = next((n for n in names if os.path.exists(n)), None)
            if path is None:
                raise FileNotFoundError(f"{names[-1]}: cycle {cycle} of lane {lane} is missing")
            blocks.append((path, 0, -1))
        counts = {binfmt.read_count(path) for path, _, _ in blocks}
        if len(counts) > 1:
            raise binfmt.FormatError(f"lane {lane}: cycles of different cluster counts")
        return [TilePart(lane, 1101, counts.pop() if counts else 0, blocks, (), None, -1, "bcl")]

    def _passing(self, part: TilePart) -> np.ndarray:
        """Which of all the part's tile's clusters pass."""
        if part.kind == "bcl":
            return np.ones(part.clusters, bool)
        flags = [binfmt.read_filter(_read(path), path) for path in part.filter_path]
        if part.filter_at < 0:
            passing = flags[0]
        else:
            passing = np.concatenate(flags)[part.filter_at : part.filter_at + part.clusters]
        if len(passing) != part.clusters:
            raise binfmt.FormatError(f"{part.filter_path[0]}: {len(passing)} clusters, tile {part.tile} has {part.clusters}")
        return passing

    def _block(self, part: TilePart, place) -> binfmt.Inflating:
        """A cycle's block at its first cluster."""
        path, at, n = place
        if part.kind == "cbcl":
            return binfmt.Inflating(path, at, n, name=f"{path}, tile {part.tile}")
        block = binfmt.Inflating(path, members=True)
        head = block.read(4)
        if len(head) < 4:
            raise binfmt.FormatError(f"{path}: no cluster count")
        if int.from_bytes(head, "little") != part.clusters:
            raise binfmt.FormatError(f"lane {part.lane}: cycles of different cluster counts")
        return block

    def _sound(self, part: TilePart, place) -> bool:
        """Whether a whole block can be read."""
        try:
            return self._block(part, place).skip() >= self._bytes(part, part.clusters)
        except binfmt.FormatError:
            return False

    def _bytes(self, part: TilePart, clusters: int) -> int:
        return clusters if part.kind == "bcl" else (clusters + 1) // 2

    def _cycles(self, part: TilePart):
        """Base-call bytes by cycle of the part's clusters that pass, and their numbers, again and again until all were given."""
        passing, values = self._passing(part), np.array(part.quality, np.uint8)
        blocks = {i: self._block(part, place) for i, place in enumerate(part.blocks) if place is not None and (not self.permissive or self._sound(part, place))}
        for block in blocks.values():
            block.skip(self._bytes(part, part.low))
        for low in range(part.low, part.high, part.step):
            high = min(low + part.step, part.high)
            own = passing[low:high]
            rows = np.zeros((len(part.blocks), int(own.sum())), np.uint8)
            for i, block in blocks.items():
                data = block.read(need := self._bytes(part, high - low))
                if len(data) < need:
                    raise binfmt.FormatError(f"{block.name}: block ends before {part.clusters} clusters")
                rows[i] = (np.frombuffer(data, np.uint8) if part.kind == "bcl" else binfmt.call_bytes(data, high - low, values))[own]
            yield rows, np.flatnonzero(own) + low
        if part.high == part.clusters:
            for block in blocks.values():
                block.skip()

    def read(self, partition: TilePart):
        for calls, clusters in self._cycles(partition):
            yield from self._batches(partition, calls, clusters)

    def _batches(self, partition: TilePart, calls: np.ndarray, clusters: np.ndarray):
        order = np.array(self.structure.order(), np.int64) - 1
        step, lengths = int(self.options.get("clusters_per_batch", 65536)), self.structure.lengths
        for at in range(0, len(clusters), step):
            reads = np.ascontiguousarray(calls[order, at : at + step].T)
            n, start, text = len(reads), 0, {}
            for segment in (R1, I1, I2, R2):
                own = reads[:, start : start + lengths[segment]]
                text[segment] = (_strings(binfmt.BASE_OF[own]), _strings(binfmt.QUALITY_OF[own]))
                start += lengths[segment]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, partition.lane, np.int32)), pa.array(np.full(n, partition.tile, np.int32)), pa.array(clusters[at : at + step]), *text[R1], text[I1][0], text[I2][0], *text[R2]],
                names=["lane", "tile", "cluster", "sequence", "quality", "index1", "index2", "read2_sequence", "read2_quality"],
            )


def _strings(rows: np.ndarray) -> pa.Array:
    """A string column of rows of equally many characters, without a loop over rows."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes()))


class BaseCalls(DataSource):
    @classmethod
    def name(cls) -> str:
        return "base_calls"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return RunReader(self.options["path"].removeprefix("file://"), dict(self.options))


def register(spark: SparkSession) -> None:
    from .fastq import FastqFiles

    importable(spark)
    spark.dataSource.register(BaseCalls)
    spark.dataSource.register(FastqFiles)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def discover_runs(top: str) -> list[tuple[str, int]]:
    """(folder, bytes) of the run folders below top, the smallest first."""
    found = []
    for d in sorted(glob.glob(os.path.join(top, "*"))):
        if os.path.isdir(d) and (os.path.isdir(base_calls_folder(d)) or os.path.exists(os.path.join(d, "RunInfo.xml")) and glob.glob(os.path.join(d, "**", "*.cbcl"), recursive=True)):
            found.append((d, sum(os.path.getsize(os.path.join(p, f)) for p, _, names in os.walk(d) for f in names)))
    return sorted(found, key=lambda x: (x[1], x[0]))
