import random

import pytest
from pyspark.sql import functions as F

from readrouter.operators import matching as M
from readrouter.operators.routing import CONTAMINATED, UNDETERMINED, demultiplex

from runfolder import match

READ = "read_id bigint, lane bigint, tile bigint, cluster bigint, sequence string, quality string, index1 string, index2 string, read2_sequence string, read2_quality string"
SAMPLE = "ord bigint, sample_id string, index1 string, index2 string, lane bigint"


def reads(spark, rows):
    return spark.createDataFrame([(i, lane, 1101, i, seq, "!" * len(seq), i1, i2, "", "") for i, (lane, seq, i1, i2) in enumerate(rows)], READ)


def routes(spark, rows, samples, **options):
    return [r["route"] for r in demultiplex(reads(spark, rows), spark.createDataFrame(samples, SAMPLE), **options).orderBy("read_id").collect()]


def test_ties_gap_and_reject(spark):
    samples = [(0, "A", "AAAA", "", 0), (1, "B", "AATT", "", 0)]
    rows = [(1, "AC", "AAAT", ""), (1, "AC", "GGGG", ""), (1, "AC", "AAAA", "")]
    assert routes(spark, rows, samples) == ["A", UNDETERMINED, "A"]
    assert routes(spark, rows, samples, min_gap=1) == [UNDETERMINED, UNDETERMINED, "A"]


def test_lanes_and_duplicates(spark):
    assert routes(spark, [(1, "AC", "AAAA", "")], [(0, "A", "AAAA", "", 2)]) == [UNDETERMINED]
    samples = [(0, "S1", "AAAA", "", 1), (1, "S2", "AAAA", "", 2)]
    rows = [(1, "AC", "AAAA", ""), (2, "AC", "AAAA", ""), (3, "AC", "AAAA", "")]
    assert routes(spark, rows, samples) == [UNDETERMINED, "S2", UNDETERMINED]
    assert routes(spark, rows, samples, duplicate_barcodes="lane_aware") == ["S1", "S2", UNDETERMINED]


def test_adapter_goes_first(spark):
    assert routes(spark, [(1, "CTGTCTCTTATACACATCT", "AAAA", "")], [(0, "A", "AAAA", "", 0)]) == [CONTAMINATED]


def test_bad_sheets(spark):
    for samples in ([(0, "A", "AAAA", "", 0), (1, "B", "AAA", "", 0)], [(0, "A", "", "", 0)]):
        with pytest.raises(ValueError):
            routes(spark, [(1, "AC", "AAAA", "")], samples)


@pytest.mark.parametrize("most, entries", [(0, M.BROADCAST_ENTRIES), (1, M.BROADCAST_ENTRIES), (1, 0), (2, M.BROADCAST_ENTRIES), (2, 0)])
def test_neighbourhood_equals_brute_force(spark, monkeypatch, most, entries):
    monkeypatch.setattr(M, "BROADCAST_ENTRIES", entries)
    random.seed(most)
    word = lambda letters, n: "".join(random.choice(letters) for _ in range(n))
    barcodes = [word("ACGT", 5) for _ in range(12)] + ["ACGTA", "ACGTA"]
    keys = [word("ACGTN", 5) for _ in range(400)] + barcodes
    sheet = spark.createDataFrame([(i, f"S{i}", b, "", 0) for i, b in enumerate(barcodes)], SAMPLE).withColumn("barcode", F.col("index1"))
    found = M.match_reads(spark.createDataFrame(list(enumerate(keys)), "read_id bigint, key string"), M.barcode_map(sheet), 5, most).orderBy("read_id").collect()
    for r, key in zip(found, keys):
        expected = match(key, barcodes, most)
        assert (None if r["match_ord"] is None else (r["match_ord"], r["match_dist"])) == expected
        if expected:  # the last row of a barcode is the sample meant
            assert r["match_sample"] == f"S{max(i for i, b in enumerate(barcodes) if b == barcodes[expected[0]])}"


def test_no_read_is_shuffled(spark):
    sheet = spark.createDataFrame([(0, "A", "AAAA", "", 0)], SAMPLE).withColumn("barcode", F.col("index1"))
    plan = M.match_reads(spark.range(10).select(F.concat(F.lit("AAA"), F.col("id").cast("string")).alias("key")), M.barcode_map(sheet), 4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_orientation(spark):
    samples = spark.createDataFrame([(0, "A", "AAAA", "AACC", 0)], SAMPLE)
    flipped, plain = reads(spark, [(1, "AC", "AAAA", "GGTT")] * 3), reads(spark, [(1, "AC", "AAAA", "AACC")] * 3)
    choose = lambda r, **o: M.choose_orientation(M.orientation_scores(r, samples, 4, 4), **o).first()["flip"]
    assert choose(flipped) and not choose(plain) and not choose(plain, detected=True) and choose(flipped, detected=True)


def test_filter_and_trim(spark):
    rows = reads(spark, [(1, "A" * 12 + "CTGTCTCT", "AAAA", "")])
    samples = spark.createDataFrame([(0, "A", "AAAA", "", 0)], SAMPLE)
    assert demultiplex(rows, samples, min_quality=20, least_fraction=0.5).count() == 0
    assert demultiplex(rows, samples, trim="CTGTCTCTTATACACATCT").first()["sequence"] == "A" * 12 + "CTGTCTCT"
    long = reads(spark, [(1, "A" * 12 + "CTGTCTCTTATA", "AAAA", "")])
    assert demultiplex(long, samples, trim="CTGTCTCTTATACACATCT").first()["sequence"] == "A" * 12


def brute_gap(key, barcodes, most, gap):
    distances = sorted((sum(x != y for x, y in zip(key, b)), i) for i, b in enumerate(barcodes))
    near = distances[0]
    if near[0] > most or len(distances) > 1 and gap and distances[1][0] < near[0] + gap:
        return None
    return near[1]


@pytest.mark.parametrize("gap", [0, 1, 2, 3])
@pytest.mark.parametrize("most", [1, 2])
@pytest.mark.parametrize("entries", [M.BROADCAST_ENTRIES, 0])
def test_one_gap_rule_whatever_the_sheet(spark, monkeypatch, gap, most, entries):
    """A runner-up counts even beyond the mismatches allowed; the sheet's size doesn't change what a read belongs to."""
    monkeypatch.setattr(M, "BROADCAST_ENTRIES", entries)
    random.seed(gap)
    barcodes = ["AAAAA", "AAAAT", "CCCCC", "CCGGC"] + ["".join(random.choice("ACGT") for _ in range(5)) for _ in range(4)]
    barcodes = list(dict.fromkeys(barcodes))
    keys = ["".join(random.choice("ACGTN") for _ in range(5)) for _ in range(200)] + barcodes
    sheet = spark.createDataFrame([(i, f"S{i}", b, "", 0) for i, b in enumerate(barcodes)], SAMPLE).withColumn("barcode", F.col("index1"))
    found = M.match_reads(spark.createDataFrame(list(enumerate(keys)), "read_id bigint, key string"), M.barcode_map(sheet), 5, most, gap).orderBy("read_id").collect()
    assert [r["match_ord"] for r in found] == [brute_gap(k, barcodes, most, gap) for k in keys]


def test_reads_per_lane_tells_lane_0_from_all_lanes(spark):
    from readrouter.operators.stats import reads_per_lane

    rows = reads_per_lane(spark.createDataFrame([(0,), (0,), (1,), (None,)], "lane bigint")).collect()
    assert {tuple(r) for r in rows} == {(0, True, 4), (0, False, 2), (1, False, 1), (None, False, 1)}
