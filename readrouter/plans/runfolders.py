"""Run folders made of the derived reads, and queries that read them back; SQL says what must come out.

Folders lie in the folder that driver and executors share. Tasks write the files: each tile of a lane its own files of a cycle. In the older
format a lane has one file of a cycle, so tasks write pieces of it, and others join them: gzip members make one file one after another.
"""

from __future__ import annotations

import gzip
import os
import shutil
import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing as G
from ..operators import stats as S
from ..sources import fastq, reports, runs, samplesheet
from ..sources.runinfo import load_structure
from . import derive as D
from .catalog import QUERIES, _matched, query  # noqa: F401

SEGMENTS = (("sequence", "quality", 32, "N"), ("index1", None, 10, "Y"), ("index2", None, 8, "Y"), ("read2_sequence", "read2_quality", 32, "N"))
#: Two bits for each quality letter of the derived reads, and the letters that they decode to.
BINNED = "####----7777AAAA"
#: Clusters of a lane that a task turns to cycles in the older format, and tasks that join them.
PIECE, JOINERS = 1 << 15, 64


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    top = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.gettempdir()
    folder = os.path.join(top, f"readrouter-{uuid.uuid4().hex}", name)
    os.makedirs(folder)
    return folder


def _run_info(folder: str) -> None:
    rows = "".join(f'<Read Number="{i}" NumCycles="{n}" IsIndexedRead="{y}"/>' for i, (_, _, n, y) in enumerate(SEGMENTS, 1))
    with open(os.path.join(folder, "RunInfo.xml"), "w", encoding="utf-8") as f:
        f.write(f'<?xml version="1.0"?><RunInfo><Run><Reads>{rows}</Reads></Run></RunInfo>')


def _letters(column, width: int) -> np.ndarray:
    """clusters x cycles: the letters of texts of one width."""
    return np.frombuffer("".join(column.to_pylist() if isinstance(column, pa.ChunkedArray) else column).encode(), np.uint8).reshape(-1, width)


def _grid(reads, n: int, qualities: bool) -> np.ndarray:
    """cycles x clusters: base in the low bits and quality (of 63) above; 0 where a cluster has no read or the base is N."""
    base = np.zeros(256, np.uint8)
    base[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    out, at = np.zeros((n, sum(x[2] for x in SEGMENTS)), np.uint8), 0
    places = reads["cluster"].to_numpy()
    for name, quality, width, _ in SEGMENTS:
        letters = _letters(reads[name], width)
        score = _letters(reads[quality], width) - 33 if quality and qualities else np.full(letters.shape, 30, np.uint8)
        bases = np.frombuffer(letters.tobytes().translate(base.tobytes()), np.uint8).reshape(letters.shape)
        out[places, at : at + width] = np.where(letters == ord("N"), 0, bases | score << 2)
        at += width
    return np.ascontiguousarray(out.T)


def _write_tile(folder: str, frame):
    """One tile's file of every cycle, and its filter: clusters without a read fail."""
    import pandas as pd

    lane, tile, n = int(frame["lane"].iloc[0]), int(frame["tile"].iloc[0]), int(frame["cluster"].max()) + 1
    top = os.path.join(folder, "Data", "Intensities", "BaseCalls", f"L{lane:03d}")
    os.makedirs(top, exist_ok=True)
    passing = np.zeros(n, np.uint8)
    passing[frame["cluster"][frame["pf"]].to_numpy()] = 1
    with open(os.path.join(top, f"s_{lane}_{tile}.filter"), "wb") as f:
        f.write(struct.pack("<II", 3, n) + passing.tobytes())
    letters = str.maketrans({q: chr(i // 4 + 33) for i, q in enumerate(D.QUALITIES)})
    frame = frame.assign(**{c: frame[c].str.translate(letters) for c in ("quality", "read2_quality")}, **{c: frame[c].str.replace("N", "A") for c in ("index1", "index2")})
    bins = b"".join(struct.pack("<II", i, 10 * i + 2) for i in range(4))
    for c, row in enumerate(_grid(frame, n, True), 1):
        half = np.zeros(n + n % 2, np.uint8)
        half[:n] = np.where(row >> 2 > 3, row & 3, row) & 15
        block = gzip.compress((half[0::2] | half[1::2] << 4).tobytes(), 1)
        where = os.path.join(top, f"C{c}.1")
        os.makedirs(where, exist_ok=True)
        head = struct.pack("<HIBBI", 1, 12 + len(bins) + 4 + 16, 2, 2, 4) + bins + struct.pack("<I4I", 1, tile, n, (n + 1) // 2, len(block))
        with open(os.path.join(where, f"L{lane:03d}_{tile}.cbcl"), "wb") as f:
            f.write(head + block)
    return pd.DataFrame({"lane": [lane], "n": [n]})


def _write_piece(parts: str, table: pa.Table) -> pa.Table:
    """Some clusters of a lane: a gzip member for each cycle, one after another behind the places where they end."""
    lane, piece = table["lane"][0].as_py(), table["piece"][0].as_py()
    places = table["cluster"].to_numpy() - piece * PIECE
    table = table.set_column(table.schema.get_field_index("cluster"), "cluster", pa.chunked_array([pa.array(places)]))
    n = int(places.max()) + 1
    members = [gzip.compress(row.tobytes(), 1) for row in _grid(table, n, True)]
    ends = np.cumsum([8 * (len(members) + 1), *map(len, members)]).astype("<i8")
    _put(os.path.join(parts, f"{lane}_{piece}"), [ends.tobytes(), *members])
    return pa.table({"lane": pa.array([lane], pa.int64()), "piece": pa.array([piece], pa.int64()), "n": pa.array([n], pa.int64())})


def _put(path: str, data) -> None:
    """A file that is there whole or not at all, whichever of a task's attempts writes it."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.writelines(data)
    os.replace(own, path)


def _cycle_file(parts: str, lane: int, cycle: int, pieces: list[tuple[int, int]]):
    """The members of a lane's file of a cycle: the count, then its pieces in order; zeros where there are no reads."""
    yield gzip.compress(struct.pack("<I", pieces[-1][0] * PIECE + pieces[-1][1]), 1)
    at = 0
    for piece, n in pieces:
        for low in range(at, piece * PIECE, PIECE):
            yield gzip.compress(bytes(min(PIECE, piece * PIECE - low)), 1)
        with open(os.path.join(parts, f"{lane}_{piece}"), "rb") as f:
            f.seek(8 * (cycle - 1))
            start, end = struct.unpack("<qq", f.read(16))
            f.seek(start)
            yield f.read(end - start)
        at = piece * PIECE + n


def _join_pieces(batches, folder: str, parts: str, pieces: dict[int, list[tuple[int, int]]]):
    """The files of the cycles and lanes of these numbers."""
    cycles, lanes = sum(x[2] for x in SEGMENTS), sorted(pieces)
    for batch in batches:
        for i in batch.column(0).to_pylist():
            lane, cycle = lanes[i // cycles], i % cycles + 1
            where = os.path.join(folder, "Data", "Intensities", "BaseCalls", f"L{lane:03d}", f"C{cycle}.1")
            os.makedirs(where, exist_ok=True)
            _put(os.path.join(where, f"L{lane:03d}_1.bcl.gz"), _cycle_file(parts, lane, cycle, pieces[lane]))
        yield batch


def _write_lanes(reads: DataFrame, folder: str) -> None:
    """Whole lanes in the older format: one gzipped file for each cycle."""
    parts = os.path.join(folder, "parts")
    os.makedirs(parts)
    pieces: dict[int, list[tuple[int, int]]] = {}
    cut = reads.withColumn("piece", F.floor(F.col("cluster") / PIECE).cast("bigint")).groupBy("lane", "piece")
    for r in cut.applyInArrow(lambda table: _write_piece(parts, table), "lane bigint, piece bigint, n bigint").collect():
        pieces.setdefault(r["lane"], []).append((r["piece"], r["n"]))
    pieces = {lane: sorted(own) for lane, own in pieces.items()}
    files = len(pieces) * sum(x[2] for x in SEGMENTS)
    todo = reads.sparkSession.range(0, files, 1, max(min(files, JOINERS), 1))
    todo.mapInArrow(lambda batches: _join_pieces(batches, folder, parts, pieces), "id bigint").count()
    shutil.rmtree(parts)


def make_run(reads: DataFrame, legacy: bool = False) -> str:
    """A run folder of the reads (with pf, but in the older format); those of a tile must fit a task, as this is for tests and timing."""
    spark = reads.sparkSession
    runs.register(spark)
    folder = shared(spark, "run")
    _run_info(folder)
    if legacy:
        _write_lanes(reads, folder)
    else:
        reads.groupBy("lane", "tile").applyInPandas(lambda frame: _write_tile(folder, frame), "lane bigint, n bigint").count()
    return folder


def _reads(spark, d) -> DataFrame:
    return D.reads(spark, d).withColumn("pf", F.col("read_id") % 7 != 0)


def _decoded(spark, folder: str, **options) -> DataFrame:
    found = spark.read.format("base_calls").options(**options).load(folder)
    return found.select(F.col("lane").cast("bigint").alias("lane"), F.col("tile").cast("bigint").alias("tile"), *found.columns[2:])


@query(f"""SELECT lane, tile, cluster, sequence, translate(quality, '{D.QUALITIES}', '{BINNED}') AS quality, replace(index1, 'N', 'A') AS index1, replace(index2, 'N', 'A') AS index2,
read2_sequence, translate(read2_quality, '{D.QUALITIES}', '{BINNED}') AS read2_quality FROM reads WHERE read_id % 7 <> 0""")
def run_scan(spark, d):
    """Base calls of many tiles to reads, of clusters that pass."""
    return _decoded(spark, make_run(_reads(spark, d)))


@query("SELECT lane, tile, cluster, sequence, replace(index1, 'N', 'A') AS index1 FROM reads WHERE read_id % 7 <> 0 AND lane IN (2, 4) AND tile IN (1102, 1104)")
def run_scan_lanes_and_tiles(spark, d):
    return _decoded(spark, make_run(_reads(spark, d)), lanes="2,4", tiles="1102,1104", clusters_per_part=100).select("lane", "tile", "cluster", "sequence", "index1")


@query("""r AS (SELECT *, CAST(floor(read_id / 4) AS BIGINT) AS place FROM reads)
SELECT lane, place AS cluster, sequence, replace(quality, '!', '#') AS quality, index1, index2, read2_sequence, replace(read2_quality, '!', '#') AS read2_quality FROM r""")
def run_scan_legacy(spark, d):
    """Whole lanes in the older format, in ranges of clusters."""
    reads = D.reads(spark, d, int(spark.conf.get("spark.sql.shuffle.partitions")))
    reads = reads.withColumn("cluster", F.floor(F.col("read_id") / 4).cast("bigint")).withColumns({c: F.replace(F.col(c), F.lit("!"), F.lit("#")) for c in ("quality", "read2_quality")})
    return _decoded(spark, make_run(reads, True), clusters_per_part=1000).drop("tile")


@query("""t AS (SELECT lane, tile, max(cluster) + 1 AS num_clusters FROM reads GROUP BY lane, tile), c AS (SELECT unnest(range(1, 83)) AS cycle)
SELECT t.lane, t.tile, c.cycle, t.num_clusters, CAST(floor((t.num_clusters + 1) / 2) AS BIGINT) AS unpacked_size, CAST(64 AS BIGINT) AS file_offset, 'cbcl' AS kind FROM t, c""")
def run_tiles(spark, d):
    """Headers and tile lists of every cycle's files."""
    folder = make_run(_reads(spark, d))
    rows = []
    for lane, where in runs.lane_folders(folder):
        for cycle, inside in runs.cycle_folders(where).items():
            for name in sorted(os.listdir(inside)):
                _, tiles = runs.tile_table(os.path.join(inside, name))
                rows += [(lane, t.tile, cycle, t.clusters, t.unpacked_size, t.offset, runs.detect(folder)) for t in tiles]
    return spark.createDataFrame(rows, "lane bigint, tile bigint, cycle bigint, num_clusters bigint, unpacked_size bigint, file_offset bigint, kind string")


@query("SELECT lane, tile, CAST(max(cluster) + 1 AS BIGINT) AS clusters, CAST(sum(CASE WHEN read_id % 7 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS passing FROM reads GROUP BY lane, tile")
def run_filters(spark, d):
    """Filter files of every tile."""
    from ..sources import binfmt

    folder, rows = make_run(_reads(spark, d)), []
    for lane, where in runs.lane_folders(folder):
        for path in runs.filters(lane, where):
            with open(path, "rb") as f:
                flags = binfmt.read_filter(f.read(), path)
            rows.append((lane, int(path.rsplit("_", 1)[1].removesuffix(".filter")), len(flags), int(flags.sum())))
    return spark.createDataFrame(rows, "lane bigint, tile bigint, clusters bigint, passing bigint")


@query("""c AS (SELECT unnest(range(1, 83)) AS cycle)
SELECT cycle, CAST(CASE WHEN cycle <= 32 THEN 0 WHEN cycle <= 42 THEN 1 WHEN cycle <= 50 THEN 2 ELSE 3 END AS BIGINT) AS segment, true AS paired FROM c""")
def run_structure(spark, d):
    """The segment of every cycle, from RunInfo.xml."""
    folder = shared(spark, "run")
    _run_info(folder)
    found = load_structure(folder)
    return spark.createDataFrame([(i, s, found.paired) for i, s in enumerate(found.segments, 1)], "cycle bigint, segment bigint, paired boolean")


@query("SELECT CAST(sum(8 + n) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS files FROM (SELECT max(cluster) + 1 AS n FROM reads GROUP BY lane, tile)")
def run_folder_size(spark, d):
    """Bytes of the filter files of a run, whose size follows from the clusters."""
    folder = make_run(_reads(spark, d))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.filter").load("file://" + folder)
    return S.folder_bytes(files)


def _sheet_lines(spark, d, head: str, line) -> str:
    rows = D.samples(spark, d).orderBy("ord").collect()  # a sample sheet, written by the driver
    path = os.path.join(shared(spark, "sheet"), "SampleSheet.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(head + "".join(line(r) for r in rows))
    return "file://" + path


@query("SELECT ord, sample_id, index1, index2, lane FROM samples")
def sample_sheet(spark, d):
    """A sheet of sections with named columns."""
    head = "﻿[Header]\nIEMFileVersion,4\n\n[BCLConvert_Data]\nLane, Sample_ID,I7_Index_ID,Index,Index2\n"
    return samplesheet.load(spark, _sheet_lines(spark, d, head, lambda r: f"{r['lane'] or ''},{r['sample_id']} ,x,{r['index1']},{r['index2']}\r\n\n"))


@query("SELECT ord, sample_id, index1, CASE WHEN ord % 2 = 0 THEN index2 ELSE '' END AS index2, CAST(0 AS BIGINT) AS lane FROM samples")
def sample_sheet_by_position(spark, d):
    line = lambda r: f"id{r['ord']},{r['sample_id']},,,,,,{r['index1']},{r['index2'] if r['ord'] % 2 == 0 else 'NA'}\n"
    return samplesheet.load(spark, _sheet_lines(spark, d, "[Data]\nid,name,,,,,,index,index2\n", line), positional=True)


def _fastq_sql(name: str, number: str) -> str:
    return f"""x AS (SELECT 1) {_matched()}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY route, lane ORDER BY tile, cluster) - 1 AS BIGINT) AS number FROM routes),
f AS (SELECT {name} AS name, {number} AS place, number, route, sequence, quality, read2_sequence, read2_quality FROM n)
SELECT name || '_R1' || e AS file, CAST(place AS BIGINT) AS place, '@' || route || '_' || number || '/1' AS header, sequence, quality FROM f, (SELECT ending AS e FROM endings)
UNION ALL SELECT name || '_R2' || e, CAST(place AS BIGINT), '@' || route || '_' || number || '/2', read2_sequence, read2_quality FROM f, (SELECT ending AS e FROM endings)"""


def _written(spark, d, **options) -> DataFrame:
    """The records of the files that the sink wrote, by file and place in it."""
    runs.register(spark)
    folder = shared(spark, "fastq")
    fastq.write(G.demultiplex(D.reads(spark, d), D.samples(spark, d)), folder, True, **options)
    files = spark.read.text("file://" + folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.split(F.rtrim("value"), "\n").alias("lines"))
    records = files.select("file", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("lines") / 4).cast("int") - 1), lambda i: F.slice("lines", i * 4 + 1, 4))).alias("place", "r"))
    return records.select("file", F.col("place").cast("bigint").alias("place"), F.col("r")[0].alias("header"), F.col("r")[1].alias("sequence"), F.col("r")[3].alias("quality"))


@query("endings AS (SELECT '_001.fastq' AS ending), " + _fastq_sql("route || '_L00' || lane", "number"))
def fastq_sink(spark, d):
    """Files by sample and lane, read back."""
    return _written(spark, d)


@query("endings AS (SELECT '_001.fastq.gz' AS ending), " + _fastq_sql("route || '_L00' || lane", "number"))
def fastq_sink_gzip(spark, d):
    return _written(spark, d, zipped=True)


@query("endings AS (SELECT '.fastq' AS ending), " + _fastq_sql("CASE WHEN route = 'undetermined' THEN 'Undetermined' ELSE route END", "row_number() OVER (PARTITION BY route ORDER BY lane, number) - 1"))
def fastq_sink_by_sample(spark, d):
    return _written(spark, d, naming="samples")


@query("""SELECT event_type AS run, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, round(CASE WHEN count(*) >= 2 THEN max(value) - min(value) END, 6) AS delta
FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type""")
def telemetry_sinks(spark, d):
    """A JSON report for each run, summarised as JSON and CSV, read back from the CSV."""
    folder, schema = shared(spark, "reports"), "run string, n bigint, avg_value double, min_value double, max_value double, delta double"
    reports.write_runs(D.table(spark, d, "events"), "event_type", "value", folder + "/runs")
    reports.write_summary(spark.read.schema(schema).json("file://" + folder + "/runs").select(*(x.split()[0] for x in schema.split(", "))), folder)
    return reports.read_summary(spark, folder, schema, "csv")


@query("""b AS (SELECT o_orderkey AS k, CAST(o_orderkey AS DOUBLE) * o_orderkey * o_orderkey * 100 AS n FROM orders)
SELECT k, CASE WHEN n < 1024 THEN printf('%.2f B', n) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0)
WHEN n < 1099511627776 THEN printf('%.2f GB', n / 1073741824.0) ELSE printf('%.2f TB', n / 1099511627776.0) END AS size FROM b""")
def human_sizes(spark, d):
    k = F.col("o_orderkey")
    return D.table(spark, d, "orders").select(k.alias("k"), reports.human_size(k.cast("double") * k * k * 100).alias("size"))
