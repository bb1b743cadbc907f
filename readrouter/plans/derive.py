"""Reads, samples, tiles and calls derived from the driver's tables, which hold no sequencing data of their own.

Every value is a function of a row's key, so that SQL can derive the same: hexadecimal digits of md5 become bases.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, BASES, QUALITIES = "0123456789abcdef", "ACGTACGTACGTACGT", "!#%*,.258;>ADGJM"


def dna(key: Column) -> Column:
    return F.translate(F.md5(key), HEX, BASES)


def _few_dna(prefix: str, key: Column, below: int) -> Column:
    """dna of the prefix and a key, looked up where the key is one of 0 to below - 1."""
    known = [hashlib.md5(f"{prefix}{i}".encode()).hexdigest().translate(str.maketrans(HEX, BASES)) for i in range(below)]
    return F.when((key >= 0) & (key < below), F.get(F.array(*map(F.lit, known)), key.cast("int"))).otherwise(dna(_text(prefix, key)))


def _text(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    """Reads of 32 bases, one for each order; a tenth of the first indexes is far off, three tenths hold one N, adapters stand in every 17th.
    tasks: the keys are dealt to so many first, as a file of few splits holds many reads."""
    k = F.col("o_orderkey")
    s = k % 25
    i1, i2 = F.substring(_few_dna("i7-", s, 25), 1, 10), F.substring(_few_dna("i5-", s, 25), 1, 8)
    p = (k % 10 + 1).cast("int")
    i1 = F.when(k % 10 == 0, F.translate(i1, "A", "C")).when(k % 10 <= 3, F.concat(F.substring(i1, F.lit(1), p - 1), F.lit("N"), F.substring(i1, p + 1, F.lit(10)))).otherwise(i1)
    r1 = dna(_text("r1-", k))
    r1 = F.when(k % 17 == 0, F.concat(F.substring(r1, 1, 6), F.lit("CTGTCTCTTATACACATCT"), F.substring(r1, 26, 7))).otherwise(r1)
    orders = table(spark, sf_dir, "orders")
    return (orders.select("o_orderkey").repartition(tasks, "o_orderkey") if tasks else orders).select(
        k.alias("read_id"), (k % 4 + 1).alias("lane"), (k % 8 + 1101).alias("tile"), F.floor(k / 8).cast("bigint").alias("cluster"),
        r1.alias("sequence"), F.translate(F.md5(_text("q-", k)), HEX, QUALITIES).alias("quality"), i1.alias("index1"), i2.alias("index2"),
        dna(_text("r2-", k)).alias("read2_sequence"), F.translate(F.md5(_text("q2-", k)), HEX, QUALITIES).alias("read2_quality"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("bigint")
    lane = F.when(n % 5 == 0, n % 4 + 1).otherwise(F.lit(0).cast("bigint"))
    return table(spark, sf_dir, "nation").select(n.alias("ord"), _text("S", n).alias("sample_id"), F.substring(dna(_text("i7-", n)), 1, 10).alias("index1"), F.substring(dna(_text("i5-", n)), 1, 8).alias("index2"), lane.alias("lane"))


def dense_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with barcodes of 4 bases, so that ties and equal barcodes are common."""
    n = F.col("n_nationkey").cast("bigint")
    return table(spark, sf_dir, "nation").select(n.alias("ord"), _text("S", n).alias("sample_id"), F.substring(dna(_text("t-", n % 20)), 1, 4).alias("index1"), F.lit("").alias("index2"), (n % 3).alias("lane"))


def dense_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).withColumn("index1", F.substring(dna(_text("k-", F.col("read_id"))), 1, 4)).withColumn("index2", F.lit(""))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 base-call bytes of each order: the bytes of md5 by cycle."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("read_id"), F.md5(_text("c-", k)).alias("_m"), F.explode(F.sequence(F.lit(1), F.lit(16))).alias("cycle"))
    digit = lambda at: f"instr('{HEX}', substr(_m, {at}, 1)) - 1"
    return rows.select("read_id", F.col("cycle").cast("bigint").alias("cycle"), F.expr(f"16 * ({digit('cycle * 2 - 1')}) + {digit('cycle * 2')}").cast("int").alias("call"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile records: suppliers as tiles of files of 10 in lanes and cycles."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((s % 2 + 1).alias("lane"), (s % 5).alias("cycle"), F.concat(F.lit("f"), F.lpad((s % 10).cast("string"), 3, "0")).alias("file"), s.alias("i"), (s % 97 + 50).alias("num_clusters"), (s * 31 % 1009 + 20).alias("compressed_size"), (F.lit(48) + s % 10 * 16).cast("bigint").alias("header_size"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((k % 4 + 1).alias("lane"), (k % 8 + 1101).alias("tile"), F.floor(k / 8).cast("bigint").alias("cluster"), (F.substring(F.md5(_text("f-", k)), 1, 1) < "c").alias("pf"))


#: The same tables in SQL.
def _sql_dna(key: str) -> str:
    return f"translate(md5({key}), '{HEX}', '{BASES}')"


SQL = f"""
raw AS (SELECT o_orderkey AS k, o_orderkey % 25 AS s, substr({_sql_dna("'i7-' || (o_orderkey % 25)")}, 1, 10) AS a, substr({_sql_dna("'i5-' || (o_orderkey % 25)")}, 1, 8) AS b, {_sql_dna("'r1-' || o_orderkey")} AS r1 FROM orders),
reads AS (SELECT k AS read_id, k % 4 + 1 AS lane, k % 8 + 1101 AS tile, CAST(floor(k / 8) AS BIGINT) AS cluster,
  CASE WHEN k % 17 = 0 THEN substr(r1, 1, 6) || 'CTGTCTCTTATACACATCT' || substr(r1, 26, 7) ELSE r1 END AS sequence,
  translate(md5('q-' || k), '{HEX}', '{QUALITIES}') AS quality,
  CASE WHEN k % 10 = 0 THEN translate(a, 'A', 'C') WHEN k % 10 <= 3 THEN substr(a, 1, CAST(k % 10 AS INTEGER)) || 'N' || substr(a, CAST(k % 10 + 2 AS INTEGER), 10) ELSE a END AS index1, b AS index2,
  {_sql_dna("'r2-' || k")} AS read2_sequence, translate(md5('q2-' || k), '{HEX}', '{QUALITIES}') AS read2_quality FROM raw),
samples AS (SELECT CAST(n_nationkey AS BIGINT) AS ord, 'S' || n_nationkey AS sample_id, substr({_sql_dna("'i7-' || n_nationkey")}, 1, 10) AS index1, substr({_sql_dna("'i5-' || n_nationkey")}, 1, 8) AS index2,
  CAST(CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey % 4 + 1 ELSE 0 END AS BIGINT) AS lane FROM nation),
dense_samples AS (SELECT CAST(n_nationkey AS BIGINT) AS ord, 'S' || n_nationkey AS sample_id, substr({_sql_dna("'t-' || (n_nationkey % 20)")}, 1, 4) AS index1, '' AS index2, CAST(n_nationkey % 3 AS BIGINT) AS lane FROM nation),
dense_reads AS (SELECT read_id, lane, tile, cluster, sequence, quality, substr({_sql_dna("'k-' || read_id")}, 1, 4) AS index1, '' AS index2 FROM reads),
calls AS (SELECT o_orderkey AS read_id, c AS cycle, CAST(16 * (instr('{HEX}', substr(md5('c-' || o_orderkey), CAST(c * 2 - 1 AS INTEGER), 1)) - 1) + instr('{HEX}', substr(md5('c-' || o_orderkey), CAST(c * 2 AS INTEGER), 1)) - 1 AS INTEGER) AS call
  FROM orders, (SELECT unnest(range(1, 17)) AS c)),
tiles AS (SELECT s_suppkey % 2 + 1 AS lane, s_suppkey % 5 AS cycle, 'f' || lpad(CAST(s_suppkey % 10 AS VARCHAR), 3, '0') AS file, s_suppkey AS i, s_suppkey % 97 + 50 AS num_clusters, s_suppkey * 31 % 1009 + 20 AS compressed_size, CAST(48 + s_suppkey % 10 * 16 AS BIGINT) AS header_size FROM supplier),
clusters AS (SELECT o_orderkey % 4 + 1 AS lane, o_orderkey % 8 + 1101 AS tile, CAST(floor(o_orderkey / 8) AS BIGINT) AS cluster, substr(md5('f-' || o_orderkey), 1, 1) < 'c' AS pf FROM orders)
"""
