import glob
import gzip
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readrouter import cli
from readrouter.sources import binfmt, fastq, runs, samplesheet
from readrouter.sources.runinfo import flipped_index2, read_structure

from runfolder import REVERSE, cbcl_run, decode, match, run_info, write_cbcl, write_filter

READS = [(12, False), (4, True), (4, True), (10, False)]
LANES = {1: [(1101, 37), (1102, 20)], 2: [(1101, 15)]}


def load(spark, path, **options):
    runs.register(spark)
    return spark.read.format("base_calls").options(**options).load(str(path))


def test_structure():
    s = read_structure('<RunInfo><Run><Reads><Read NumCycles="3" IsIndexedRead="N"/><Read NumCycles="2" IsIndexedRead="Y"/><Read NumCycles="1" IsIndexedRead="N"/></Reads></Run></RunInfo>')
    assert s.lengths == [3, 2, 0, 1] and s.paired and s.order() == [1, 2, 3, 4, 5, 6]
    for bad in ("<RunInfo/>", "<Other/>", '<RunInfo><Run><Reads><Read NumCycles="3"/></Reads></Run></RunInfo>'):
        with pytest.raises(ValueError):
            read_structure(bad)


def test_orientation_of_instruments(tmp_path):
    assert not flipped_index2(str(tmp_path))
    (tmp_path / "RunParameters.xml").write_text("<a><b>NovaSeq X</b></a>")
    assert flipped_index2(str(tmp_path)) and not flipped_index2(str(tmp_path), "false")
    (tmp_path / "RunParameters.xml").write_text("<a>nextseq")
    assert not flipped_index2(str(tmp_path))


def test_sheet():
    text = "﻿[Header]\nx,1\n\n[Data]\nnote,row\nSample_ID,I7_Index_ID,index,I5_Index_ID,index2,Lane\nS1,D701,ACGT,D501,TTTT,2x\nS2,D702,GGGG\n[Cloud_Data]\nSample_ID\nS9\n[BCLConvert_Data]\nlane,sample,index\n,S3,CCCC\nx,,AAAA\n"
    assert samplesheet.parse(text) == [(0, "S1", "ACGT", "TTTT", 2), (1, "S2", "GGGG", "", 0), (2, "S3", "CCCC", "", 0)]


def test_cbcl_run_equals_plain_decoding(spark, tmp_path):
    data = cbcl_run(str(tmp_path), READS, LANES, np.random.default_rng(1))
    rows = {(r["lane"], r["tile"], r["cluster"]): {k: r[k] for k in r.asDict() if k not in ("lane", "tile", "cluster")} for r in load(spark, tmp_path, clusters_per_batch=7).collect()}
    assert rows == decode(READS, data)
    assert load(spark, tmp_path, lanes="2").select("lane").distinct().collect()[0]["lane"] == 2
    assert {r["tile"] for r in load(spark, tmp_path, tiles="1102").collect()} == {1102}


def test_missing_cycle_and_bad_block(spark, tmp_path):
    data = cbcl_run(str(tmp_path / "a"), READS, LANES, np.random.default_rng(2), skip_cycle=3)
    rows = {(r["lane"], r["tile"], r["cluster"]): r["sequence"] for r in load(spark, tmp_path / "a").collect()}
    assert rows == {k: v["sequence"] for k, v in decode(READS, data, skip_cycle=3).items()}
    cbcl_run(str(tmp_path / "b"), READS, {1: [(1101, 30)]}, np.random.default_rng(3))
    path = glob.glob(str(tmp_path / "b" / "Data/Intensities/BaseCalls/L001/C2.1/*.cbcl"))[0]
    with open(path, "r+b") as f:
        f.seek(70)
        f.write(b"\xff" * 12)
    with pytest.raises(Exception, match="inflated"):
        load(spark, tmp_path / "b").collect()
    assert all(r["sequence"][1] == "N" and r["quality"][1] == "!" for r in load(spark, tmp_path / "b", mode="PERMISSIVE").collect())


def test_legacy_run(spark, tmp_path):
    run_info(str(tmp_path), [(3, False)])
    folder = tmp_path / "Data/Intensities/BaseCalls/L001"
    calls = np.array([[0x00, 0x82], [0x07, 0x05], [0x06, 0x04]], np.uint8)
    for c, row in enumerate(calls, 1):
        os.makedirs(folder / f"C{c}.1")
        with gzip.open(folder / f"C{c}.1" / "L001_1.bcl.gz", "wb") as f:
            f.write(struct.pack("<I", 2) + row.tobytes())
    assert [(r["sequence"], r["quality"], r["index1"]) for r in load(spark, tmp_path).orderBy("cluster").collect()] == [("NTG", '!""', ""), ("GCA", 'A""', "")]
    with gzip.open(folder / "C3.1" / "L001_1.bcl.gz", "wb") as f:
        f.write(struct.pack("<I", 1) + b"\x04")
    with pytest.raises(Exception, match="different cluster counts"):
        load(spark, tmp_path).collect()
    os.unlink(folder / "C3.1" / "L001_1.bcl.gz")
    with pytest.raises(Exception, match="missing"):
        load(spark, tmp_path).collect()


def test_formats(tmp_path):
    write_cbcl(str(tmp_path / "x.cbcl"), [(1, 3), (2, 2)], {1: [4, 14, 1], 2: [0, 15]})
    data = (tmp_path / "x.cbcl").read_bytes()
    header = binfmt.read_header(data)
    tiles = binfmt.read_tiles(data, header)
    assert [(t.tile, t.clusters) for t in tiles] == [(1, 3), (2, 2)] and tiles[0].offset == header.size
    values = binfmt.quality_values(header)
    assert values.tolist() == [2, 12, 22, 32] and binfmt.quality_values(header, "header").tolist() == [0, 12, 24, 40]
    calls = binfmt.unpack_block(data[tiles[0].offset : tiles[1].offset], 3, values)
    assert binfmt.BASE_OF[calls].tobytes() == b"AGC" and binfmt.QUALITY_OF[calls].tobytes() == b"-A#"
    for n in (5, 20, len(data) - 60):
        with pytest.raises(binfmt.FormatError):
            binfmt.read_tiles(data[:n], binfmt.read_header(data[:n])) if n > 44 else binfmt.read_header(data[:n])
    write_filter(tmp_path / "f", [1, 0, 2, 1], 0)
    assert binfmt.read_filter((tmp_path / "f").read_bytes()).tolist() == [True, False, False, True]
    with pytest.raises(binfmt.FormatError):
        binfmt.read_filter((tmp_path / "f").read_bytes()[:-1])
    with pytest.raises(FileNotFoundError):
        runs.detect(str(tmp_path))


@pytest.mark.parametrize("zipped", [False, True])
def test_run_to_fastq(spark, tmp_path, zipped, monkeypatch):
    data = cbcl_run(str(tmp_path / "run"), READS, LANES, np.random.default_rng(5))
    plain = decode(READS, data)
    keys = sorted(plain)
    barcodes = [(plain[k]["index1"], plain[k]["index2"]) for k in keys[:3]]
    sheet = "[Data]\nSample_ID,index,index2,Lane\n" + "".join(f"S{i},{a},{b},{'' if i else 1}\n" for i, (a, b) in enumerate(barcodes))
    (tmp_path / "sheet.csv").write_text(sheet)
    monkeypatch.setattr(fastq, "PART_RECORDS", 4)
    args = cli.parser().parse_args(["--input", str(tmp_path / "run"), "--samplesheet", str(tmp_path / "sheet.csv"), "--output", str(tmp_path / "out"), *["--gzip"] * zipped])
    cli.run(spark, args)
    expected: dict[str, list[str]] = {}
    for lane, tile, cluster in keys:
        r = plain[lane, tile, cluster]
        hit = match(r["index1"] + r["index2"], [a + b for a, b in barcodes])
        route = "undetermined" if hit is None or hit[0] == 0 and lane != 1 else f"S{hit[0]}"
        for mate, (s, q) in enumerate((("sequence", "quality"), ("read2_sequence", "read2_quality")), 1):
            own = expected.setdefault(f"{route}_L{lane:03d}_R{mate}_001.fastq" + ".gz" * zipped, [])
            own.append(f"@{route}_{len(own)}/{mate}\n{r[s]}\n+\n{r[q]}\n")
    found = {os.path.basename(p): (gzip.open(p, "rt") if zipped else open(p)).read() for p in glob.glob(str(tmp_path / "out" / "*"))}
    assert found == {k: "".join(v) for k, v in expected.items()}
    assert not glob.glob(str(tmp_path / "out" / ".*"))


def test_flip_helper():
    assert "AACC"[::-1].translate(REVERSE) == "GGTT"


def test_discovery(tmp_path):
    cbcl_run(str(tmp_path / "b"), READS, LANES, np.random.default_rng(1))
    run_info(str(tmp_path / "a"), READS)
    (tmp_path / "other").mkdir()
    run_info(str(tmp_path / "c"), READS)
    write_cbcl(str(tmp_path / "c" / "somewhere" / "x.cbcl"), [(1, 3)], {1: [4, 14, 1]})
    # A run has base calls, or a RunInfo.xml and a .cbcl file somewhere.
    assert [os.path.basename(p) for p, _ in runs.discover_runs(str(tmp_path))] == ["c", "b"]


@pytest.mark.parametrize("step", [1, 7, 1 << 19])
def test_ranges_of_clusters_and_filters_without_tile_names(spark, tmp_path, step):
    data = cbcl_run(str(tmp_path), READS, LANES, np.random.default_rng(1))
    plain = {k: v["sequence"] for k, v in decode(READS, data).items()}
    rows = lambda: {(r["lane"], r["tile"], r["cluster"]): r["sequence"] for r in load(spark, tmp_path, clusters_per_part=step).collect()}
    assert rows() == plain
    # Two files that name no tile: clusters of all tiles one after another, cut anywhere.
    folder = tmp_path / "Data/Intensities/BaseCalls/L001"
    flags = [f for tile, _ in LANES[1] for f in data[1, tile][1]]
    for f in glob.glob(str(folder / "*.filter")):
        os.unlink(f)
    write_filter(folder / "s_1_a.filter", flags[:25])
    write_filter(folder / "s_1_b.filter", flags[25:])
    assert rows() == plain


def test_positional_sheet():
    text = "[Header]\nx\n[Data]\nid,name,a,b,c,d,e,index,index2\n1,One,,,,,,ACGT,TTTT\n2,Two,,,,,,GGGG,NA\n"
    assert samplesheet.parse_positional(text) == [(0, "One", "ACGT", "TTTT", 0), (1, "Two", "GGGG", "", 0)]


def test_fastq_by_sample(spark, tmp_path):
    from readrouter.operators.routing import demultiplex
    from readrouter.plans import derive as D

    routed = demultiplex(D.reads(spark, "/root/testdata/sf0.001"), D.samples(spark, "/root/testdata/sf0.001"))
    fastq.write(routed, str(tmp_path / "out"), True, naming="samples")
    counts = {r["route"]: r["count"] for r in routed.groupBy("route").count().collect()}
    found = {os.path.basename(p): sum(1 for _ in open(p)) // 4 for p in glob.glob(str(tmp_path / "out" / "*"))}
    assert found == {f"{'Undetermined' if k == 'undetermined' else k}_R{m}.fastq": n for k, n in counts.items() for m in (1, 2)}


def test_folder_sizes_and_reports(spark, tmp_path):
    from readrouter.operators.stats import folder_sizes
    from readrouter.sources import reports

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a").write_bytes(b"x" * 1500)
    (tmp_path / "in" / "deep" / "b").write_bytes(b"y" * 20)
    assert tuple(folder_sizes(spark, str(tmp_path / "in")).first()) == (1520, 2)
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", float("nan"))], "run string, v double")
    reports.write_runs(rows, "run", "v", str(tmp_path / "runs"))
    assert [(r["run"], r["n"], r["avg_value"], r["delta"]) for r in spark.read.json(str(tmp_path / "runs")).collect()] == [("a", 2, 2.0, 2.0)]
    reports.write_summary(rows.groupBy("run").count(), str(tmp_path / "out"))
    for kind in ("json", "csv"):
        assert {tuple(r) for r in reports.read_summary(spark, str(tmp_path / "out"), "run string, count bigint", kind).collect()} == {("a", 2), ("b", 1)}


@pytest.mark.parametrize("zipped", [False, True])
def test_blocks_are_inflated_once_for_many_ranges(tmp_path, monkeypatch, zipped):
    """Small clusters_per_part: the bytes inflated don't grow with the number of ranges; zipped: the older format, in two members."""
    n, rng = 400, np.random.default_rng(7)
    if zipped:
        run_info(str(tmp_path), [(3, False)])
        plain = rng.integers(0, 256, (3, n)).astype(np.uint8)
        for c, row in enumerate(plain, 1):
            folder = tmp_path / f"Data/Intensities/BaseCalls/L001/C{c}.1"
            os.makedirs(folder)
            (folder / "L001_1.bcl.gz").write_bytes(gzip.compress(struct.pack("<I", n) + row[:101].tobytes()) + gzip.compress(row[101:].tobytes()) + b"\0\0")
        expected = {(1, 1101, i): "".join("N" if x < 4 else "ACGT"[x & 3] for x in plain[:, i]) for i in range(n)}
    else:
        expected = {k: v["sequence"] for k, v in decode([(3, False)], cbcl_run(str(tmp_path), [(3, False)], {1: [(1101, n)]}, rng)).items()}
    inflated = []
    some = binfmt.Inflating._some
    monkeypatch.setattr(binfmt.Inflating, "_some", lambda self, most: (inflated.append(len(data := some(self, most))), data)[1])
    monkeypatch.setattr(runs, "LEAST_CLUSTERS", 2)
    reader = runs.RunReader(str(tmp_path), {"clusters_per_part": "1"})
    parts = reader.partitions()
    assert len(parts) == runs.TASKS_PER_TILE
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert {(r["lane"], r["tile"], r["cluster"]): r["sequence"] for r in rows} == expected and len(rows) == len(expected)
    assert sum(inflated) <= 3 * (n * (runs.TASKS_PER_TILE + 1) / 2 + 4 * runs.TASKS_PER_TILE)


def test_a_lane_in_the_older_format_is_written_in_pieces(spark):
    """A gzip member for the count and one for each piece, and zeros where a piece ends early or is missing."""
    from readrouter.plans import runfolders as R

    read = lambda lane, cluster, c: (lane, cluster, c * 32, "5" * 32, c * 10, c * 8, "ACGT" * 8, "?" * 32)
    reads = [read(1, 2, "A"), read(1, 5, "C"), read(1, 2 * R.PIECE + 3, "G"), read(3, 0, "T"), read(3, R.PIECE - 1, "A"), read(3, R.PIECE, "C")]
    schema = "lane bigint, cluster bigint, sequence string, quality string, index1 string, index2 string, read2_sequence string, read2_quality string"
    folder = R.make_run(spark.createDataFrame(reads, schema), True)
    found = R._decoded(spark, folder).drop("tile")
    assert sorted(map(tuple, found.where("sequence not like 'N%'").select(*(x.split()[0] for x in schema.split(", "))).collect())) == sorted(reads)
    assert sorted(map(tuple, found.groupBy("lane").agg(F.count("*"), F.countDistinct("cluster"), F.max("cluster")).collect())) == [(1, 2 * R.PIECE + 4, 2 * R.PIECE + 4, 2 * R.PIECE + 3), (3, R.PIECE + 1, R.PIECE + 1, R.PIECE)]
    top = os.path.join(folder, "Data/Intensities/BaseCalls")
    assert sorted(os.listdir(folder)) == ["Data", "RunInfo.xml"] and {f for _, _, names in os.walk(top) for f in names} == {"L001_1.bcl.gz", "L003_1.bcl.gz"}
    for lane, sizes in ((1, [4, 6, R.PIECE, R.PIECE - 6, 4]), (3, [4, R.PIECE, 1])):
        with open(f"{top}/L{lane:03d}/C82.1/L{lane:03d}_1.bcl.gz", "rb") as f:
            data, members = f.read(), []
        while data:
            inflater = zlib.decompressobj(31)
            members.append(len(inflater.decompress(data)))
            data = inflater.unused_data
        assert members[0] == 4 and sum(members) == sum(sizes) and len(members) >= 3



def test_end_of_a_damaged_block(tmp_path):
    """Its last bytes decide on the whole block: with FAILFAST an error, with PERMISSIVE N everywhere."""
    cbcl_run(str(tmp_path), [(3, False)], {1: [(1101, 20_000)]}, np.random.default_rng(3))
    path = glob.glob(str(tmp_path / "Data/Intensities/BaseCalls/L001/C2.1/*.cbcl"))[0]
    with open(path, "r+b") as f:
        f.seek(-6, os.SEEK_END)  # the checksum
        f.write(b"\1\2")
    every = lambda **options: [s for r in [runs.RunReader(str(tmp_path), {"clusters_per_part": "1", **options})] for p in r.partitions() for b in r.read(p) for s in b.column("sequence").to_pylist()]
    with pytest.raises(binfmt.FormatError, match="inflated"):
        every()
    assert {s[1] for s in every(mode="PERMISSIVE")} == {"N"}


def test_human_size_rounds_the_exact_value(spark):
    from readrouter.sources.reports import human_size

    k = 637994.0  # its decimal form in TB ends in 5, its exact value is less
    sizes = [k * k * k * 100, 0.0, 1023.0, 1024.0 * 1.125, 1024.0 * 1.375, 1048575.0, 1024.0**4 * 2.125, -5.0, None, 1e30, 3.0e19]
    exact = lambda n: next(f"{n / 1024**i:.2f} {u}" for i, u in enumerate(("B", "KB", "MB", "GB", "TB")) if n < 1024 ** (i + 1) or u == "TB")
    found = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "n double").coalesce(1).select(human_size(F.col("n"))).collect()]
    assert found == [None if n is None else exact(n) for n in sizes]
