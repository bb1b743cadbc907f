import pytest
from pyspark.sql import functions as F

from readrouter.functions import bases as B


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("byte, base, quality", [(0x00, "N", "!"), (0x07, "T", '"'), (0x82, "G", "A"), (0x03, "N", "!")])
def test_decode(spark, byte, base, quality):
    assert value(spark, B.base(F.lit(byte))) == base
    assert value(spark, B.quality(F.lit(byte))) == quality


def test_nibbles(spark):
    low, high = value(spark, B.nibble(F.lit(0xE4), F.lit(0))), value(spark, B.nibble(F.lit(0xE4), F.lit(1)))
    assert (low, high) == (4, 14)
    assert [value(spark, B.binned_quality(F.lit(i))) for i in range(4)] == [2, 12, 22, 32]


@pytest.mark.parametrize("given, expected", [("AACGTN", "NACGTT"), ("", ""), ("acgt", "ACGT"), ("AXG", "CNT")])
def test_reverse_complement(spark, given, expected):
    assert value(spark, B.reverse_complement(F.lit(given))) == expected


def test_reverse_complement_keeps_case_out(spark):
    assert value(spark, B.reverse_complement(F.lit("aC"), False)) == "GN"


def test_barcode_and_key(spark):
    assert value(spark, B.combined_barcode(F.lit("ACGT"), F.lit("AACC"), F.lit(True))) == "ACGTGGTT"
    assert value(spark, B.combined_barcode(F.lit("ACGT"), F.lit(""), F.lit(True))) == "ACGT"
    assert value(spark, B.read_key(F.lit("ACGTA"), F.lit("AA"), 4, 4)) == "ACGTAANN"
    assert value(spark, B.read_key(F.lit("AC"), F.lit("GG"), 4, 0)) == "ACNN"


@pytest.mark.parametrize("read, least, expected", [("A" * 12 + "CTGTCTCT", 5, 12), ("A" * 20, 5, 20), ("A" * 7, 5, 7), ("", 5, 0), ("ACTGTCTCTTAAAA", 5, 14)])
def test_trim(spark, read, least, expected):
    adapter = "CTGTCTCTTATACACATCT"
    n, brute = len(read), len(read)
    for p in range(least, n - least + 1) if n >= 2 * least else ():
        k = min(len(adapter), n - p)
        if read[p : p + k] == adapter[:k]:
            brute = p
            break
    assert value(spark, B.trim_position(F.lit(read), adapter, least)) == brute == expected


def test_quality_fraction(spark):
    assert value(spark, B.quality_fraction(F.lit("!!55"), 20)) == 0.5
    assert value(spark, B.quality_fraction(F.lit("!!55"), 0)) == 1.0
    assert value(spark, B.quality_fraction(F.lit(""), 20)) is None


def test_small_helpers(spark):
    assert value(spark, B.lane_tag(F.lit(3))) == "L003"
    assert value(spark, B.fastq_record(F.lit("S"), F.lit(0), F.lit("AC"), F.lit("!!"), "/1")) == "@S_0/1\nAC\n+\n!!"
    assert B.human_bytes(0) == "0.00 B" and B.human_bytes(1536) == "1.50 KB" and B.human_bytes(2**50) == "1024.00 TB"
    for a in B.ADAPTERS:
        assert value(spark, B.has_adapter(F.lit(f"A{a}T")))
    assert not value(spark, B.has_adapter(F.lit("ACGT" * 20)))
