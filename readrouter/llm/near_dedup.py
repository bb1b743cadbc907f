"""Near-duplicate documents through SetSketch registers.

A document's set is its distinct word shingles. A sketch has, for each register, the least of exponentially distributed
values of all shingles, truncated to a power of BASE: registers of a union are the larger of both, and those of similar sets are
mostly equal. Bands of registers give candidates; for a candidate pair the likelihood of its register comparisons, given both
set sizes, decides whether a similarity at the threshold is still possible; what is left is verified on the full sets.

1. Documents of equal sets are one class, represented by the smallest id.
2. Every class is compared with the smallest id of each of its buckets; verified links give components.
3. Buckets that still hold several components make clusters of classes that share them. Within a cluster, classes of different components
   are verified by the bits of their shared shingles, in blocks of bounded size; only links that join two components come out. So every
   pair that shares a bucket is either verified or already connected, and no pair but a link is ever a row.

Sets are of 64-bit hashes of shingles, sketches and verification alike.

Two sets at a similarity of 0.8 share no bucket with a chance of about 4e-7 (28 bands of 4 registers), and more similar ones far less.
BASE is near 1, as unrelated sets of one size would often be equal in registers of a few bits.

Defined results: null and empty texts, and texts of white space, have no shingles, are linked with nothing and are kept; texts of fewer words
than a shingle are one shingle of all words; repeated rows of one id are one node and are kept or dropped together; a
row with a null id is linked with nothing and kept.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_ids, map_arrow, partitions, slices, stage

BANDS, ROWS, BASE = 28, 4, 1.01
#: Added to a register, so that values above 1 have room below it.
ZERO = 2000
REGISTERS = BANDS * ROWS
#: Members of a cluster and shingles of them that are compared in one place (for two blocks 4,096 by 400,000 bits, 205 MB, at most), and partners of one document that are verified in one place.
BLOCK, BLOCK_SHINGLES, PARTNERS = 2048, 400_000, 1000
#: Links whose components one task finds (16 bytes each, in memory some 100); more are followed by joins, round after round.
EDGES_AT_ONCE = 1 << 22
#: Log-likelihood that a similarity at the threshold may lose against the best one before the pair is given up.
SLACK = 18.0
#: Bytes of text that are hashed at once.
CHUNK = 1_000_000

# Odd multipliers and the finaliser of the splitmix64 generator: fixed values.
GOLDEN, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWER = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        inverse = pow(_POWER, -1, 1 << 64)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, p, np.uint64))]) for p in (_POWER, inverse)]
    return _powers


def _hash_shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * up[: len(data)], dtype=np.uint64)])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)
    bounds = np.searchsorted(starts, np.concatenate([[0], ends_of_text]))
    out = []
    n = len(h)
    rolled = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        rolled += h[k : k + len(rolled)] * up[k + 1]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * up[1 : b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    out, held, size = [], [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").lower()  # bytes lower A-Z only
        held.append(data)
        size += len(data)
        if size >= CHUNK:
            out += _hash_shingles(held, words)
            held, size = [], 0
    return out + (_hash_shingles(held, words) if held else [])


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, a row of 16-bit numbers each; an empty set has zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    todo = [i for i, s in enumerate(sets) if len(s)]
    reach = np.log(REGISTERS) + 3.0
    while todo:
        sizes = np.array([len(sets[i]) for i in todo])
        least = np.full(len(todo) * REGISTERS, np.inf)
        of = np.repeat(np.arange(len(todo)), sizes)
        element = np.concatenate([sets[i] for i in todo])
        limit = (reach / sizes)[of]
        at, step = np.zeros(len(element)), 0
        # Each shingle's values come in rising order, as the arrivals of a Poisson process dealt to random registers.
        while len(element):
            step += 1
            r = mix(element + np.uint64(step * int(MIX_1) % (1 << 64)))
            at = at - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / REGISTERS
            near = at < limit
            element, of, at, limit, r = element[near], of[near], at[near], limit[near], r[near]
            register = (mix(r) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(least, of * REGISTERS + register, at)
        least = least.reshape(-1, REGISTERS)
        filled = np.isfinite(least).all(1)
        values = np.clip(np.floor(1 - np.log(least[filled]) / np.log(BASE)) + ZERO, 0, 65535)
        out[np.array(todo)[filled]] = values.astype(np.uint16)
        todo = [i for i, ok in zip(todo, filled) if not ok]
        reach *= 2
    return out


def possible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Of pairs of sketches and set sizes, which may reach the threshold by their joint likelihood."""
    above, below = (a > b).sum(-1), (a < b).sum(-1)
    equal = REGISTERS - above - below
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u, v) / np.maximum(u, v)
    unlike = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, best_near = np.full(len(most), -np.inf), np.full(len(most), -np.inf)
    for share in np.linspace(0, 1, 41):
        for j, near in ((share * most, False), (threshold + share * np.maximum(most - threshold, 0), True)):
            p, q = unlike(u - v * j), unlike(v - u * j)
            ll = above * np.log(np.maximum(p, 1e-9)) + below * np.log(np.maximum(q, 1e-9)) + equal * np.log(np.maximum(1 - p - q, 1e-9))
            best = np.maximum(best, ll)
            if near:
                best_near = np.maximum(best_near, ll)
    return (most >= threshold - 1e-9) & (best_near >= best - SLACK)


def _sketch(batches, words):
    for batch in (part for whole in batches for part in slices(whole, 1)):
        sets = shingle_sets(batch.column(1).to_pylist(), words)
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in sketches(sets)], pa.binary())], ["doc_id", "n", "set_key", "registers"]
        )


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(batches, threshold):
    """Pairs that their sketches don't rule out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ok = possible(_registers(batch.column(2)), _registers(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy(), threshold)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])


def _links(ids: np.ndarray, component: np.ndarray, side: np.ndarray, one: bool, sets: list[np.ndarray], threshold: float):
    """Links between different components of a block, or of a pair of blocks; one for each two components that meet."""
    size, percent = len(ids), round(threshold * 100)
    every, times = np.unique(np.concatenate(sets), return_counts=True)
    shared = every[times > 1]
    width = -(-max(len(shared), 1) // 64)
    bits = np.zeros((size, width), np.uint64)
    for i, s in enumerate(sets):
        at = np.searchsorted(shared, s)
        at = at[(at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == s)] if len(shared) else at[:0]
        row = np.zeros(width * 64, bool)
        row[at] = True
        bits[i] = np.packbits(row).view(np.uint64)
    n = np.array(list(map(len, sets)))
    kinds, label, counts = np.unique(component, return_inverse=True, return_counts=True)
    large = label == counts.argmax()
    index = np.arange(size)
    for i in np.flatnonzero(~large).tolist():
        other = np.flatnonzero((label != label[i]) & (large | (index > i)) & (one | (side != side[i])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        for start in range(0, len(other), 4096):
            near = other[start : start + 4096]
            common = np.bitwise_count(bits[near] & bits[i]).sum(1, dtype=np.int64)
            for j in near[100 * common >= percent * (n[near] + n[i] - common)].tolist():
                if label[j] != label[i]:
                    yield min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))
                    label[label == label[j]] = label[i]


def _between(batches, words, threshold):
    """Links of different components within the blocks of clusters, whose rows come one after another."""
    held: list[dict] = []
    key = None

    def flush():
        if len({r["component"] for r in held}) < 2:
            return
        ids, component, side = (np.array([r[k] for r in held]) for k in ("rep", "component", "block"))
        found = list(_links(ids, component, side, key[1] == key[2], shingle_sets([r["text"] for r in held], words), threshold))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    for batch in batches:
        for row in batch.to_pylist():
            if (new := (row["cluster"], row["low"], row["high"])) != key:
                yield from flush()
                held, key = [], new
            held.append(row)
    yield from flush()


def _verify(batches, words, threshold):
    """Links of a pivot with the partners that follow it; the pivot's row comes first."""
    pivot, own = None, None
    percent = round(threshold * 100)
    for batch in (part for whole in batches for part in slices(whole, 2)):
        found = []
        rows = batch.to_pylist()
        for row, shingles in zip(rows, shingle_sets([r["text"] for r in rows], words)):
            if row["b"] is None:
                pivot, own = row["a"], shingles
            elif row["a"] == pivot:
                common = len(np.intersect1d(own, shingles, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(shingles) - common):
                    found.append((pivot, row["b"]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; texts has rep and text. A pivot with many partners is dealt out."""
    spark = pairs.sparkSession
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).cast("int").alias("_of"))
    partners = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_of")).cast("int").alias("_salt"))
    members = partners.join(texts.withColumnRenamed("rep", "b"), "b").select("a", "_salt", "b", "text")
    pivots = shares.join(texts.withColumnRenamed("rep", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_salt"), F.lit(None).cast("bigint").alias("b"), "text")
    rows = members.unionByName(pivots).repartition(partitions(spark), "a", "_salt").sortWithinPartitions("a", "_salt", F.col("b").asc_nulls_first())
    return map_arrow(rows.select("a", "b", "text"), partial(_verify, words=words, threshold=threshold), "a bigint, b bigint")


def _components(batches):
    """node and component of all the links (x, y): roots are hung under smaller ones that they meet, until none meet."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not found:
        return
    x, y = (np.concatenate(c) for c in zip(*found))
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y, root = at[: len(x)], at[len(x) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    for start in range(0, len(nodes), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[start : start + 65536]), pa.array(nodes[root[start : start + 65536]])], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, of every node of the links (a, b)."""
    edges = stage(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct(), "edges")
    # Every round of joins leaves plans, classes and threads on the driver, so links that fit one task take none.
    if edges.count() <= EDGES_AT_ONCE:
        return stage(map_arrow(edges.coalesce(1), _components, "node bigint, component bigint"), "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # Every larger neighbour of a node is hung under the node's least neighbour, then every node's smaller neighbours.
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = stage(large, "large")
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(low.select("x", F.col("m").alias("y"))).distinct()
        edges = stage(small, "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    found = edges.groupBy("x").agg(F.min("y").alias("component")).select(F.col("x").alias("node"), "component")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(documents: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spark = docs.sparkSession
    sketched = stage(map_arrow(docs, partial(_sketch, words=words), "doc_id bigint, n bigint, set_key binary, registers binary"), "sketches")
    real = sketched.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    first = real.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    classes = stage(first, "classes")
    # The representatives' registers; an id stands for one set here, so rows that repeat an id count once.
    registers = real.select(F.col("doc_id").alias("rep"), "set_key", "registers").join(classes, ["rep", "set_key"], "left_semi")
    nodes = stage(registers.dropDuplicates(["rep", "set_key"]).join(classes, ["rep", "set_key"]).select("rep", "n", "registers"), "nodes")
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("registers", 2 * i * ROWS + 1, 2 * ROWS)) for i in range(BANDS)))
    bands = nodes.select("rep", F.explode(keys).alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("_last"), F.count("*").alias("size")).where("pivot <> _last").drop("_last")
    met = stage(bands.join(buckets, "bucket"), "met")

    def likely(pairs: DataFrame) -> DataFrame:
        of = lambda k: nodes.select(F.col("rep").alias(k), F.col("registers").alias(f"r_{k}"), F.col("n").alias(f"n_{k}"))
        rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b")
        return map_arrow(rows, partial(_likely, threshold=threshold), "a bigint, b bigint")

    stars = met.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stage(likely(stars), "stars")
    texts = stage(keep_ids(docs.select(F.col("doc_id").alias("rep"), "text"), met.select("rep").distinct(), "rep").dropDuplicates(["rep"]), "texts")
    links = stage(verified(stars, texts, words, threshold), "links")
    labels = components(links)
    labelled = met.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("bucket")
    rows = stage(labelled.join(mixed, "bucket", "left_semi").select("rep", "pivot", "component"), "mixed")
    clusters = components(rows.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    members = rows.select("rep", "component").distinct().join(clusters.withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster"), "rep").join(nodes.select("rep", "n"), "rep")
    members = stage(members, "members")
    # A large cluster is compared block by block, each pair of blocks in a place of its own.
    parts = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("_of"), F.countDistinct("component").alias("_kinds")).where("_kinds > 1")
    dealt = members.join(parts, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_of")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    dealt = dealt.select("cluster", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "rep", "component", "block")
    dealt = dealt.join(texts, "rep").repartition(partitions(spark), "cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "rep")
    more = stage(map_arrow(dealt, partial(_between, words=words, threshold=threshold), "a bigint, b bigint"), "more")
    final = components(links.unionByName(more)) if more.head(1) else labels
    of_set = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    found = sketched.drop("registers").join(of_set, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


#: op9 in DuckDB by brute force: different sets that share a shingle are compared on their shingles, and links followed to the smallest id.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
k AS (SELECT doc_id, sh, CAST(len(sh) AS BIGINT) AS n, min(doc_id) OVER (PARTITION BY sh) AS rep FROM s),
e AS (SELECT DISTINCT rep, n, unnest(sh) AS x FROM k WHERE doc_id = rep),
l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT rep AS node, rep AS seen FROM k UNION SELECT c.node, u.b FROM c JOIN u ON c.seen = u.a),
m AS (SELECT node, min(seen) AS least FROM c GROUP BY node)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE least END AS component_id, CASE WHEN n = 0 THEN true ELSE least = doc_id END AS kept
FROM k JOIN m ON k.rep = m.node
"""
