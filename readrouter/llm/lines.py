"""Line dedup by site-relative frequency, with DataFrame functions only.

Of each host, the pages that hold a line are counted (once for each page, lines compared without outer spaces) and
divided by the host's pages; lines above the ratio are boilerplate of that host and are dropped from its pages.

Defined results: null text has no lines and stays null; a null host is a host of its own, that of the empty name; blank lines
are never dropped; a line must stand on `least_pages` pages at least, so hosts of few pages keep theirs; other columns pass
through; repeated rows count as pages each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

RATIO, LEAST_PAGES = 0.05, 5
#: Boilerplate tables up to so many lines are broadcast (8 bytes each); larger ones are joined by host and salt.
BROADCAST_LINES, SALTS = 1_000_000, 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(documents: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """_host and _lines, the hashes of the lines above the ratio on it."""
    pages = documents.select(F.coalesce(F.col(host), F.lit("")).alias("_host"), F.col(text).alias("_text"))
    totals = pages.groupBy("_host").agg(F.count("*").alias("_pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("_host", F.explode(keys).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_pages)
    return counts.join(totals, "_host").where(F.col("_n") > F.col("_pages") * F.lit(ratio)).groupBy("_host").agg(F.collect_set("_line").alias("_lines"))


def drop_boilerplate(documents: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """documents with the text's boilerplate lines dropped, and with n_lines and n_dropped."""
    found = stage(boilerplate(documents, host, text, ratio, least_pages), "boilerplate")
    size = found.agg(F.sum(F.size("_lines"))).first()[0] or 0
    columns = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    # The row travels as one column, so that no name of it can clash.
    pages = documents.select(F.struct(*columns).alias("_row"), F.col(text).alias("_text"), F.coalesce(F.col(host), F.lit("")).alias("_host"))
    if size <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(found), "_host", "left")
    else:
        salted = found.select("_host", "_lines", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        joined = pages.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left")
    lines = _lines(F.col("_text"))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.coalesce(F.array_contains(F.col("_lines"), _key(x)), F.lit(False)))
    done = joined.select("_row", F.coalesce(F.size(lines), F.lit(0)).alias("_all"), F.when(F.col("_lines").isNull(), lines).otherwise(kept).alias("_kept"))
    return done.select(
        *(F.array_join("_kept", "\n").alias(c) if c == text else F.col("_row")[c].alias(c) for c in columns),
        F.when(F.col("_all") < 0, 0).otherwise(F.col("_all")).cast("bigint").alias("n_lines"),
        F.when(F.col("_all") < 0, 0).otherwise(F.col("_all") - F.size("_kept")).cast("bigint").alias("n_dropped"),
    )


#: The same in DuckDB, over documents with source as the host.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS h, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT DISTINCT doc_id, h, trim(l) AS l FROM (SELECT doc_id, h, unnest(ls) AS l FROM d)),
t AS (SELECT h, count(*) AS n FROM d GROUP BY h),
c AS (SELECT h, l, count(*) AS c FROM u WHERE l <> '' GROUP BY h, l),
b AS (SELECT c.h, list(c.l) AS bl FROM c JOIN t ON c.h = t.h WHERE c.c >= {LEAST_PAGES} AND c.c > t.n * {RATIO} GROUP BY c.h),
k AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(coalesce(bl, []), trim(x))) AS kept FROM d LEFT JOIN b ON d.h = b.h)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped
FROM k
"""


def line_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, text without boilerplate lines, n_lines, n_dropped of every document."""
    return drop_boilerplate(documents.select("doc_id", "source", "text")).drop("source")
