"""Every relational query by name, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bases as B
from ..operators import matching as M
from ..operators import reshape as R
from ..operators import routing as G
from ..operators import stats as S
from . import derive as D

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with the SQL that gives the same rows after the derived tables."""

    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = f"WITH {D.SQL}{'' if sql.startswith('SELECT') else ','}{sql}"
        return function

    return register


def _complement(x: str) -> str:
    return f"reverse(translate(regexp_replace(upper({x}), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"


#: The brute-force match: every read with every distinct barcode.
def _matched(reads: str = "reads", samples: str = "samples", most: int = 1, length1: int = 10, length2: int = 8, gap: int = 0, barcode: str = "index1 || index2") -> str:
    key = f"rpad(index1, {length1}, 'N')" + (f" || rpad(index2, {length2}, 'N')" if length2 else "")
    return f""",
bc AS (SELECT {barcode} AS barcode, min(ord) AS ord, arg_max(sample_id, ord) AS sample_id, arg_max(lane, ord) AS lane FROM {samples} GROUP BY 1),
keyed AS (SELECT *, {key} AS key FROM {reads}),
scored AS (SELECT keyed.key, bc.ord, bc.sample_id, bc.lane AS slane, hamming(keyed.key, bc.barcode) AS d FROM (SELECT DISTINCT key FROM keyed) keyed, bc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, ord) AS rn, min(d) OVER (PARTITION BY key) AS low FROM scored),
best AS (SELECT key, ord, sample_id, slane, d FROM ranked WHERE rn = 1 AND d <= {most}{f" AND (SELECT count(*) FROM scored s WHERE s.key = ranked.key AND s.d < ranked.low + {gap}) = 1" if gap else ""}),
matched AS (SELECT keyed.*, best.ord AS match_ord, best.sample_id AS match_sample, best.slane AS match_lane, CAST(best.d AS BIGINT) AS match_dist FROM keyed LEFT JOIN best ON keyed.key = best.key),
routed AS (SELECT *, {" OR ".join(f"contains(sequence, '{a}')" for a in B.ADAPTERS)} AS has_adapter FROM matched),
routes AS (SELECT *, CASE WHEN has_adapter THEN 'adapter_contamination' WHEN match_sample IS NOT NULL AND (match_lane = 0 OR match_lane = lane) THEN match_sample ELSE 'undetermined' END AS route FROM routed)
"""


MATCH_COLUMNS = ("read_id", "match_ord", "match_sample", "match_dist")


def _match(spark, d, dense=False, most=1, gap=0) -> DataFrame:
    reads, samples = (D.dense_reads(spark, d), D.dense_samples(spark, d)) if dense else (D.reads(spark, d), D.samples(spark, d))
    keyed = reads.withColumn("key", B.read_key(F.col("index1"), F.col("index2"), *((4, 0) if dense else (10, 8))))
    coded = samples.withColumn("barcode", F.concat("index1", "index2"))
    return M.match_reads(keyed, M.barcode_map(coded), 4 if dense else 18, most, gap)


@query("SELECT read_id, cycle, CASE WHEN ((call >> 2) & 63) = 0 THEN 'N' ELSE substr('ACGT', (call & 3) + 1, 1) END AS base, chr(((call >> 2) & 63) + 33) AS quality FROM calls")
def decode_bases(spark, d):
    return D.calls(spark, d).select("read_id", "cycle", B.base(F.col("call")).alias("base"), B.quality(F.col("call")).alias("quality"))


@query("""SELECT read_id, cycle, half, CAST(nib & 3 AS BIGINT) AS base_bits, CAST(((nib >> 2) & 3) * 10 + 2 AS BIGINT) AS quality, CAST(((((nib >> 2) & 3) * 10 + 2) << 2) | (nib & 3) AS BIGINT) AS call
FROM (SELECT read_id, cycle, half, CASE WHEN half % 2 = 0 THEN call & 15 ELSE (call >> 4) & 15 END AS nib FROM calls, (SELECT unnest([CAST(0 AS BIGINT), 1]) AS half))""")
def nibble_unpack(spark, d):
    rows = D.calls(spark, d).withColumn("half", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))).withColumn("_n", B.nibble(F.col("call"), F.col("half")))
    bits, value = F.col("_n").bitwiseAND(3), B.binned_quality(F.shiftright("_n", 2).bitwiseAND(3))
    return rows.select("read_id", "cycle", "half", bits.cast("bigint").alias("base_bits"), value.cast("bigint").alias("quality"), B.call_byte(bits, value).cast("bigint").alias("call"))


@query("""SELECT read_id, string_agg(CASE WHEN ((call >> 2) & 63) = 0 THEN 'N' ELSE substr('ACGT', (call & 3) + 1, 1) END, '' ORDER BY cycle) AS sequence,
string_agg(chr(((call >> 2) & 63) + 33), '' ORDER BY cycle) AS quality FROM calls GROUP BY read_id""")
def transpose_cycles(spark, d):
    return R.transpose(D.calls(spark, d), ["read_id"])


@query("""SELECT cycle, segment, CAST(row_number() OVER (PARTITION BY segment ORDER BY cycle) - 1 AS BIGINT) AS pos, CAST(count(*) OVER (PARTITION BY segment) AS BIGINT) AS length
FROM (SELECT p_partkey AS cycle, p_partkey % 4 AS segment FROM part)""")
def segment_layout(spark, d):
    cycles = D.table(spark, d, "part").select(F.col("p_partkey").alias("cycle"), (F.col("p_partkey") % 4).alias("segment"))
    return R.segment_positions(cycles).join(F.broadcast(S.segment_lengths(cycles)), "segment").select("cycle", "segment", "pos", "length")


@query(f"SELECT read_id, {_complement('index1')} AS folded, reverse(translate(regexp_replace(lower(index1), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS upper_only FROM reads")
def revcomp(spark, d):
    i = F.col("index1")
    return D.reads(spark, d).select("read_id", B.reverse_complement(i).alias("folded"), B.reverse_complement(F.lower(i), False).alias("upper_only"))


@query(f"SELECT ord, index1 || index2 AS forward, index1 || CASE WHEN index2 <> '' THEN {_complement('index2')} ELSE index2 END AS flipped FROM samples")
def combined_barcode(spark, d):
    a, b = F.col("index1"), F.col("index2")
    return D.samples(spark, d).select("ord", B.combined_barcode(a, b, F.lit(False)).alias("forward"), B.combined_barcode(a, b, F.lit(True)).alias("flipped"))


@query("SELECT read_id, rpad(index1, 12, 'N') || rpad(index2, 6, 'N') AS key FROM reads")
def read_key(spark, d):
    return D.reads(spark, d).select("read_id", B.read_key(F.col("index1"), F.col("index2"), 12, 6).alias("key"))


@query(f"SELECT lane, CAST(count(*) AS BIGINT) AS reads, CAST(sum(CASE WHEN {' OR '.join(f"contains(sequence, '{a}')" for a in B.ADAPTERS)} THEN 1 ELSE 0 END) AS BIGINT) AS with_adapter FROM reads GROUP BY lane")
def adapter_flag(spark, d):
    return D.reads(spark, d).groupBy("lane").agg(F.count("*").alias("reads"), F.sum(B.has_adapter(F.col("sequence")).cast("bigint")).alias("with_adapter"))


TRIMMED = "CTGTCTCTTATACACATCT"


@query(f"""SELECT read_id, CAST(coalesce((SELECT min(p) FROM range(5, length(s) - 5 + 1) t(p) WHERE substr(s, CAST(p + 1 AS INTEGER), CAST(least(19, length(s) - p) AS INTEGER)) = substr('{TRIMMED}', 1, CAST(least(19, length(s) - p) AS INTEGER))), length(s)) AS BIGINT) AS trim_at
FROM (SELECT read_id, CASE WHEN read_id % 3 = 0 THEN substr(read2_sequence, 1, CAST(8 + read_id % 12 AS INTEGER)) || substr('{TRIMMED}', 1, CAST(5 + read_id % 15 AS INTEGER)) ELSE sequence END AS s FROM reads)""")
def adapter_trim(spark, d):
    k = F.col("read_id")
    s = F.when(k % 3 == 0, F.concat(F.substring(F.col("read2_sequence"), F.lit(1), (8 + k % 12).cast("int")), F.substring(F.lit(TRIMMED), F.lit(1), (5 + k % 15).cast("int")))).otherwise(F.col("sequence"))
    return D.reads(spark, d).select("read_id", s.alias("s")).select("read_id", B.trim_position(F.col("s"), TRIMMED, 5).cast("bigint").alias("trim_at"))


@query("""SELECT read_id, round(length(regexp_replace(quality, '[\\x21-\\x34]', '', 'g'))::DOUBLE / length(quality), 6) AS fraction FROM reads
WHERE length(regexp_replace(quality, '[\\x21-\\x34]', '', 'g'))::DOUBLE / length(quality) >= 0.4""")
def quality_fraction_filter(spark, d):
    return D.reads(spark, d).withColumn("_f", B.quality_fraction(F.col("quality"), 20)).where("_f >= 0.4").select("read_id", F.round("_f", 6).alias("fraction"))


@query("SELECT read_id, substr(x, 1, 12) AS r1, substr(x, 13, 6) AS i1, substr(x, 19, 4) AS i2, substr(x, 23, 10) AS r2 FROM (SELECT read_id, sequence AS x FROM reads)")
def segment_slice(spark, d):
    x = F.col("sequence")
    return D.reads(spark, d).select("read_id", *(B.segment(x, a, n).alias(c) for c, a, n in (("r1", 0, 12), ("i1", 12, 6), ("i2", 18, 4), ("r2", 22, 10))))


@query(f"""x AS (SELECT 1) {_matched()}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY route, lane ORDER BY tile, cluster) - 1 AS BIGINT) AS number FROM routes)
SELECT read_id, route, lane, number, '@' || route || '_' || number || '/1' || chr(10) || sequence || chr(10) || '+' || chr(10) || quality AS record1,
'@' || route || '_' || number || '/2' || chr(10) || read2_sequence || chr(10) || '+' || chr(10) || read2_quality AS record2 FROM n""")
def fastq_format(spark, d):
    routed = G.demultiplex(D.reads(spark, d), D.samples(spark, d))
    return R.fastq(R.numbered(routed), True).select("read_id", "route", "lane", "number", "record1", "record2")


@query("SELECT DISTINCT lane, printf('L%03d', lane) AS tag FROM reads")
def lane_tag(spark, d):
    return D.reads(spark, d).select("lane").distinct().select("lane", B.lane_tag(F.col("lane")).alias("tag"))


@query("SELECT lane, tile, cluster, CAST(row_number() OVER (PARTITION BY lane ORDER BY tile, cluster) - 1 AS BIGINT) AS passed FROM clusters WHERE pf")
def pf_compact(spark, d):
    return R.compact(D.clusters(spark, d)).select("lane", "tile", "cluster", "passed")


@query("SELECT lane, tile, CAST(count(*) AS BIGINT) AS clusters, CAST(sum(CASE WHEN pf THEN 1 ELSE 0 END) AS BIGINT) AS passing FROM clusters GROUP BY lane, tile")
def pf_stats(spark, d):
    return S.filter_stats(D.clusters(spark, d))


@query("SELECT file, i, CAST(header_size + coalesce(sum(compressed_size) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset FROM tiles")
def block_offsets(spark, d):
    return R.block_offsets(D.tiles(spark, d)).select("file", "i", "file_offset")


@query("SELECT lane, cycle, file, i, CAST(coalesce(sum(num_clusters) OVER (PARTITION BY lane, cycle ORDER BY file, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cluster_offset FROM tiles")
def cluster_offsets(spark, d):
    return R.cluster_offsets(D.tiles(spark, d)).select("lane", "cycle", "file", "i", "cluster_offset")


@query("SELECT lane, CAST(sum(num_clusters) AS BIGINT) AS raw_clusters FROM tiles t WHERE cycle = (SELECT min(cycle) FROM tiles u WHERE u.lane = t.lane) GROUP BY lane")
def raw_clusters(spark, d):
    return S.raw_clusters(D.tiles(spark, d))


@query(f"x AS (SELECT 1) {_matched()} SELECT read_id, match_ord, match_sample, match_dist FROM matched")
def barcode_match(spark, d):
    return _match(spark, d).select(*MATCH_COLUMNS)


@query(f"x AS (SELECT 1) {_matched('dense_reads', 'dense_samples', 1, 4, 0)} SELECT read_id, match_ord, match_sample, match_dist FROM matched")
def barcode_match_dense(spark, d):
    return _match(spark, d, True).select(*MATCH_COLUMNS)


@query(f"x AS (SELECT 1) {_matched('dense_reads', 'dense_samples', 1, 4, 0, 1)} SELECT read_id, match_ord, match_sample, match_dist FROM matched")
def min_gap_match(spark, d):
    return _match(spark, d, True, 1, 1).select(*MATCH_COLUMNS)


@query(f"x AS (SELECT 1) {_matched('dense_reads', 'dense_samples', 1, 4, 0, 2)} SELECT read_id, match_ord, match_sample, match_dist FROM matched")
def min_gap2_match(spark, d):
    return _match(spark, d, True, 1, 2).select(*MATCH_COLUMNS)


@query(f"x AS (SELECT 1) {_matched(most=2)} SELECT read_id, match_ord, match_sample, match_dist FROM matched")
def barcode_match_k2(spark, d):
    return _match(spark, d, most=2).select(*MATCH_COLUMNS)


@query(f"x AS (SELECT 1) {_matched()} SELECT read_id, match_sample, lane, match_lane FROM matched WHERE match_sample IS NOT NULL AND (match_lane = 0 OR match_lane = lane)")
def lane_restricted_match(spark, d):
    return _match(spark, d).where(F.col("match_sample").isNotNull() & M.lane_fits(F.col("match_lane"), F.col("lane"))).select("read_id", "match_sample", "lane", "match_lane")


@query("SELECT index1 AS barcode, min(ord) AS ord, arg_max(sample_id, ord) AS sample_id, arg_max(lane, ord) AS lane FROM dense_samples GROUP BY index1")
def barcode_map_keep_last(spark, d):
    return M.barcode_map(D.dense_samples(spark, d).withColumn("barcode", F.col("index1")))


@query(f"x AS (SELECT 1) {_matched()} SELECT read_id, has_adapter, route FROM routes")
def route_reads(spark, d):
    return G.demultiplex(D.reads(spark, d), D.samples(spark, d)).select("read_id", "has_adapter", "route")


@query("""bc AS (SELECT b.l AS rlane, index1 AS barcode, min(ord) AS ord, arg_max(sample_id, ord) AS sample_id FROM dense_samples, (SELECT unnest([CAST(1 AS BIGINT), 2, 3, 4]) AS l) b WHERE lane = 0 OR lane = b.l GROUP BY 1, 2),
s AS (SELECT r.read_id, bc.sample_id, bc.ord, hamming(r.index1, bc.barcode) AS d FROM dense_reads r JOIN bc ON bc.rlane = r.lane),
t AS (SELECT read_id, sample_id, row_number() OVER (PARTITION BY read_id ORDER BY d, ord) AS rn, d FROM s)
SELECT r.read_id, CASE WHEN contains(sequence, 'CTGTCTCTTATACACATCT') THEN 'adapter_contamination' ELSE coalesce(t.sample_id, 'undetermined') END AS route FROM dense_reads r LEFT JOIN t ON t.read_id = r.read_id AND t.rn = 1 AND t.d <= 1""")
def lane_aware_route(spark, d):
    return G.demultiplex(D.dense_reads(spark, d), D.dense_samples(spark, d), duplicate_barcodes="lane_aware").select("read_id", "route")


@query(f"x AS (SELECT 1) {_matched()}, c AS (SELECT route, CAST(count(*) AS BIGINT) AS reads FROM routes GROUP BY route) SELECT ord, sample_id, coalesce(reads, 0) AS reads FROM samples LEFT JOIN c ON c.route = samples.sample_id")
def sample_summary(spark, d):
    samples = D.samples(spark, d)
    return S.sample_summary(G.demultiplex(D.reads(spark, d), samples), samples)


@query(f"""x AS (SELECT 1) {_matched()} SELECT CAST(sum(CASE WHEN route IN ('adapter_contamination', 'undetermined') THEN 0 ELSE 1 END) AS BIGINT) AS matched,
CAST(sum(CASE WHEN route IN ('adapter_contamination', 'undetermined') THEN 1 ELSE 0 END) AS BIGINT) AS unmatched, CAST(sum(CASE WHEN has_adapter THEN 1 ELSE 0 END) AS BIGINT) AS with_adapter, CAST(count(*) AS BIGINT) AS total FROM routes""")
def match_totals(spark, d):
    return S.match_totals(G.demultiplex(D.reads(spark, d), D.samples(spark, d)))


@query(f"""flipped AS (SELECT ord, sample_id, index1, {_complement('index2')} AS index2, lane FROM samples)
{_matched(samples='flipped')},
f AS (SELECT CAST(coalesce(sum(CASE WHEN match_sample IS NOT NULL AND (match_lane = 0 OR match_lane = lane) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n FROM matched),
b2 AS (SELECT index1 || {_complement('index2')} AS barcode, min(ord) AS ord, arg_max(lane, ord) AS lane FROM flipped GROUP BY 1),
s2 AS (SELECT k.key, b2.lane AS slane, hamming(k.key, b2.barcode) AS d, row_number() OVER (PARTITION BY k.key ORDER BY hamming(k.key, b2.barcode), b2.ord) AS rn FROM (SELECT DISTINCT key FROM keyed) k, b2),
g AS (SELECT CAST(coalesce(sum(CASE WHEN s2.slane = 0 OR s2.slane = keyed.lane THEN 1 ELSE 0 END), 0) AS BIGINT) AS n FROM keyed JOIN s2 ON s2.key = keyed.key AND rn = 1 AND d <= 1)
SELECT f.n AS score_forward, g.n AS score_flipped, f.n = 0 AND g.n > f.n AS flip FROM f, g""")
def orientation_choice(spark, d):
    sheet = D.samples(spark, d).withColumn("index2", B.reverse_complement(F.col("index2")))
    return M.choose_orientation(M.orientation_scores(D.reads(spark, d), sheet, 10, 8))


@query(f"""f AS (SELECT * FROM reads ORDER BY lane, tile, cluster LIMIT 200000),
k AS (SELECT 'I1' AS kind, index1 AS key FROM f WHERE index1 <> '' UNION ALL SELECT 'I2', index2 FROM f WHERE index2 <> '' UNION ALL SELECT 'I1+I2', index1 || index2 FROM f UNION ALL SELECT 'I1+rc(I2)', index1 || {_complement('index2')} FROM f),
c AS (SELECT kind, key, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY kind, key),
r AS (SELECT kind, key, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY kind), 6) AS pct, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS BIGINT) AS rank FROM c)
SELECT * FROM r WHERE rank <= 50""")
def barcode_topk(spark, d):
    return S.barcode_histogram(D.reads(spark, d))


@query("SELECT ord, sample_id, index1 || index2 AS barcode FROM samples ORDER BY ord LIMIT 20")
def first_barcodes(spark, d):
    return S.first_barcodes(D.samples(spark, d)).select("ord", "sample_id", F.concat("index1", "index2").alias("barcode"))


@query("SELECT lane, false AS all_lanes, CAST(count(*) AS BIGINT) AS reads FROM reads GROUP BY lane UNION ALL SELECT 0, true, CAST(count(*) AS BIGINT) FROM reads")
def reads_per_lane(spark, d):
    return S.reads_per_lane(D.reads(spark, d))


@query("SELECT read_id, lane FROM reads WHERE lane = 1 UNION ALL SELECT read_id, lane FROM reads WHERE lane = 3")
def union_lanes(spark, d):
    reads = D.reads(spark, d)
    return reads.where("lane = 1").unionByName(reads.where("lane = 3")).select("read_id", "lane")


@query("""c AS (SELECT unnest(range(0, 8)) AS cycle), f AS (SELECT cycle, string_agg(file, ',' ORDER BY file) AS files FROM (SELECT DISTINCT cycle, file FROM tiles) GROUP BY cycle)
SELECT c.cycle, f.files, f.files IS NULL AS missing FROM c LEFT JOIN f ON f.cycle = c.cycle""")
def cycle_file_outer(spark, d):
    return R.cycle_files(spark.range(8).withColumnRenamed("id", "cycle"), D.tiles(spark, d).select("cycle", "file").distinct())


@query("""c AS (SELECT lane, cycle, CAST(sum(num_clusters) AS BIGINT) AS clusters FROM tiles GROUP BY lane, cycle)
SELECT lane, CAST(count(DISTINCT clusters) AS BIGINT) AS counts, min(clusters) AS low, max(clusters) AS high, count(DISTINCT clusters) = 1 AS consistent FROM c GROUP BY lane""")
def cluster_count_check(spark, d):
    return S.count_check(D.tiles(spark, d).groupBy("lane", "cycle").agg(F.sum("num_clusters").alias("clusters")))


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, round(CASE WHEN count(*) >= 2 THEN max(value) - min(value) END, 6) AS delta
FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type""")
def telemetry_agg(spark, d):
    return S.telemetry_summary(D.table(spark, d, "events"), "event_type", "value")
