"""Exact-substring dedup by suffix arrays.

A window is a string of `length` bytes. Every window has an anchor, its gram of GRAM bytes of least hash (the leftmost of equal
ones), so equal windows have equal anchors at equal places. The windows of one anchor follow each other and span a snippet.
Only anchors whose gram is an anchor elsewhere can hold repeated windows. Snippets are counted by anchor and digest before they are
shuffled, so equal ones, however many, are one row with their number from there on. The
different snippets of an anchor meet in one shard, where external induced sorting gives all suffixes in order with their common
prefixes: a window is repeated if a neighbour in that order shares `length` bytes with it, or if its snippet was collapsed. All
bytes of repeated windows go.

A passage that many documents share has as many different snippets at its edges as it has neighbourhoods. An anchor of more than HOT
different snippets, and more than the mean shard has, is therefore split: its windows are taken PIECE at a time, by their distance from the gram, and a piece has as its
anchor the bytes that all its windows must hold, length - PIECE + 1 of them. Equal windows still meet; the pieces of one anchor
agree in all but PIECE - 1 bytes, so that few of them differ and equal ones are collapsed before the sort, as whole snippets are.
A shard's anchors come one after another and are sorted GROUP bytes at a time, so a task's memory does not grow with its shard.

Defined results: null text counts as empty; nothing goes from texts of fewer bytes than a window; copies of a text lose all
of it (if as long as a window); a row with a null id neither is searched nor changed; rows that repeat an id must repeat its text,
and repeat each other.
"""

from __future__ import annotations

import hashlib
import mmap
import tempfile
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_ids, keep_ids, map_arrow, partitions, slices, stage
from .induced import sorted_suffixes
from .near_dedup import GOLDEN, MIX_1, MIX_2

LENGTH, GRAM = 200, 32
#: Bytes that are hashed at once; a longer text is taken in overlapping parts.
CHUNK = 1 << 20
#: Shards for each shuffle partition.
SHARDS = 3
#: Different snippets that an anchor may always have without being split, and the windows of a piece of one that is.
HOT, PIECE = 256, 4
#: Bytes of snippets that are sorted at once, and the rest of their last anchor.
GROUP = 1 << 24
_PLACE = np.uint64((1 << 24) - 1)
ROWS = "anchor bigint, digest bigint, doc_id bigint, first int, last int"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h ^= np.ndarray(shape=n, dtype="<u8", buffer=data, offset=k, strides=(1,))
        h *= MIX_1 if k % 16 else MIX_2
        h ^= h >> np.uint64(29)
    h *= GOLDEN
    h ^= h >> np.uint64(32)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of keys[i : i + width] for each i."""
    n = len(keys)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(rows, width)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(texts: list[bytes], length: int):
    """(text's number, anchor, digest of the snippet, first window, last window) as arrays, of texts of `length` bytes at least."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    h = _gram_hashes(data)
    place = np.arange(len(h), dtype=np.uint64)
    chosen = _least((h & ~_PLACE) | place, length - GRAM + 1) & _PLACE
    n = len(chosen)
    start = np.arange(n)
    whole = ends[of[:n]] - start >= length
    change = np.concatenate([[True], chosen[1:] != chosen[:-1]])
    before = np.concatenate([[False], whole[:-1]])
    firsts = np.flatnonzero(whole & (change | ~before))
    after = np.concatenate([whole[1:], [False]])
    lasts = np.flatnonzero(whole & (np.concatenate([change[1:], [True]]) | ~after))
    view, base = memoryview(data), (ends - [len(t) for t in texts])
    digests = np.array([xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(firsts.tolist(), lasts.tolist())], np.uint64)
    number = of[firsts]
    return number, h[chosen[firsts].astype(np.int64)].view(np.int64), digests.view(np.int64), firsts - base[number], lasts - base[number]


def _anchors(batches, length):
    def flush(held):
        ids, offsets, parts = zip(*held)
        number, anchor, digest, first, last = anchors(list(parts), length)
        offsets = np.array(offsets)[number]
        columns = [anchor, digest, np.array(ids, np.int64)[number], (first + offsets).astype(np.int32), (last + offsets).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "digest", "doc_id", "first", "last"])

    for batch in batches:
        held, size = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode("utf-8", "surrogatepass") if text and doc_id is not None else b""
            if len(data) < length:
                continue
            for at in range(0, len(data) - length + 1, CHUNK):
                part = data[at : at + CHUNK + length - 1]
                held.append((doc_id, at, part))
                size += len(part)
                if size >= CHUNK:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)


def _cut_snippets(batches, length):
    for batch in (part for whole in batches for part in slices(whole, 0)):
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            snippets = [data[w["first"] : w["last"] + length] for w in wanted]
            columns = [pa.array([w[k] for w in wanted], pa.int64()) for k in ("anchor", "digest", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(snippets, pa.binary())], ["anchor", "digest", "n", "snippet"])


def pieces(snippet: bytes, anchor: int, length: int):
    """(first window, last window, own anchor, digest) of the pieces of a snippet."""
    windows = len(snippet) - length + 1
    # The gram lies in every window, and each takes the leftmost.
    inside = _gram_hashes(np.frombuffer(snippet, np.uint8)).view(np.int64)[windows - 1 : length - GRAM + 1]
    gram = windows - 1 + int(np.argmax(inside == anchor))
    i = 0
    while i < windows:
        near = (gram - i) // PIECE * PIECE  # the least distance of this piece's windows
        last = min(windows - 1, gram - near)
        core = snippet[gram - near : gram - near + length - PIECE + 1]
        yield i, last, xxhash.xxh3_64_intdigest(core, (anchor + near) % (1 << 64)), xxhash.xxh3_64_intdigest(snippet[i : last + length])
        i = last + 1


PIECES = "anchor bigint, digest bigint, n bigint, doc_id bigint, first int, last int, start int, piece_anchor bigint, piece_digest bigint"


def _cut_pieces(batches, length):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def made(rows):
        *numbers, own, digests = zip(*rows)
        hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (own, digests)]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 3
        return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(numbers, kinds)), *hashes], names)

    for batch in (part for whole in batches for part in slices(whole, 1)):
        rows = []
        for doc_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                for a, b, own, digest in pieces(data[w["first"] : w["last"] + length], w["anchor"], length):
                    rows.append((w["anchor"], w["digest"], w["n"], doc_id, w["first"] + a, w["first"] + b, a, own, digest))
                if len(rows) >= 20_000:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)


def repeated_windows(text: np.ndarray, length: int, limit: int, folder: str | None = None) -> np.ndarray:
    """Of each position of a text of snippets with a 0 after each, whether its window stands anywhere else too."""
    found = np.zeros(len(text), bool)
    before = -1
    for positions, prefixes in sorted_suffixes(text, length, limit, folder):
        same = prefixes >= length
        found[positions[same]] = True
        found[positions[:-1][same[1:]]] = True
        if same[0] and before >= 0:
            found[before] = True
        before = int(positions[-1])
    return found


def _sort_shard(batches, length, limit):
    """The repeated windows of each snippet, as runs counted from its first window, of rows that come by anchor. The text that is sorted lies in a file."""
    meta: list[tuple[int, int, int, int]] = []
    size = 0
    with tempfile.TemporaryFile() as file:
        for batch in batches:
            for anchor, digest, n, snippet in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= GROUP and anchor != meta[-1][0]:
                    yield from _sort_group(file, meta, length, limit)
                    file.seek(0)
                    file.truncate()
                    meta, size = [], 0
                meta.append((anchor, digest, n, len(snippet)))
                # Bytes of UTF-8 stay below 254; 0 is left for the ends.
                file.write((np.frombuffer(snippet, np.uint8) + np.uint8(1)).tobytes() + b"\0")
                size += len(snippet) + 1
        if meta:
            yield from _sort_group(file, meta, length, limit)


def _sort_group(file, meta, length, limit):
    file.flush()
    with mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
        text = np.frombuffer(mapped, np.uint8)
        found = repeated_windows(text, length, limit)
        del text
    at, rows = 0, []
    for anchor, digest, n, size in meta:
        windows = np.ones(size - length + 1, bool) if n > 1 else found[at : at + size - length + 1]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], windows.view(np.int8), [0]])))
        if len(edge):
            rows.append((anchor, digest, [{"from": a, "to": b - 1} for a, b in edge.reshape(-1, 2).tolist()]))
        at += size + 1
        if len(rows) >= 10_000:
            yield _runs(rows)
            rows = []
    if rows:
        yield _runs(rows)


def _runs(rows):
    anchor, digest, runs = zip(*rows)
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), pa.array(runs, kind)], ["anchor", "digest", "runs"])


def _shared(counts: DataFrame, key: str) -> DataFrame:
    """Of counts n by anchor and digest those whose anchor stands twice or more, with the number of its different snippets."""
    by_anchor = Window.partitionBy(key)
    return counts.withColumn("_all", F.sum("n").over(by_anchor)).withColumn("kinds", F.count("*").over(by_anchor)).where(F.col("_all") > 1).drop("_all")


def _representatives(docs: DataFrame, snippets: DataFrame, name: str) -> DataFrame:
    """The texts that hold snippets (anchor, digest, n, doc_id, first, last), each with those wanted of it."""
    wanted = snippets.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "digest", "n", "first", "last")).alias("wanted"))
    wanted = stage(wanted, name)
    return keep_ids(docs, wanted.select("doc_id"), "doc_id").dropDuplicates(["doc_id"]).join(wanted, "doc_id")


def spans(documents: DataFrame, length: int = LENGTH, limit: int = 1 << 24, hot: int = HOT) -> DataFrame:
    """doc_id and spans (array of from, to: byte offsets, not merged) of the documents that lose bytes."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    every = stage(map_arrow(docs, partial(_anchors, length=length), ROWS), "windows")
    repeated = _shared(every.groupBy("anchor", "digest").agg(F.count("*").alias("n")), "anchor")
    met = stage(every.join(repeated, ["anchor", "digest"]), "anchors")
    at = F.min(F.struct("doc_id", "first", "last")).alias("at")
    mixed = stage(met.where("kinds > 1").groupBy("anchor", "digest", "n", "kinds").agg(at).select("anchor", "digest", "n", "kinds", "at.*"), "mixed")
    shards = SHARDS * partitions(spark)
    too_many = F.col("kinds") > max(hot, mixed.count() // shards)
    snippets = mixed.where(~too_many).drop("kinds")
    split = None
    if not mixed.where(too_many).isEmpty():
        holders = _representatives(docs, mixed.where(too_many), "wanted_hot").select("doc_id", "text", "wanted")
        split = stage(map_arrow(holders, partial(_cut_pieces, length=length), PIECES), "pieces")
        keys = ["piece_anchor", "piece_digest"]
        same = split.groupBy(*keys).agg(F.sum("n").alias("n"), at)
        split = split.drop("n", "doc_id")
        same = stage(_shared(same, keys[0]), "same_pieces")
        snippets = snippets.unionByName(same.where("kinds > 1").select(F.col(keys[0]).alias("anchor"), F.col(keys[1]).alias("digest"), "n", "at.*"))
    cut = map_arrow(_representatives(docs, snippets, "wanted").select("text", "wanted"), partial(_cut_snippets, length=length), "anchor bigint, digest bigint, n bigint, snippet binary")
    cut = cut.repartition(shards, "anchor").sortWithinPartitions("anchor")
    runs = stage(map_arrow(cut, partial(_sort_shard, length=length, limit=limit), "anchor bigint, digest bigint, runs array<struct<from:int,to:int>>"), "runs")
    found = runs.select("anchor", "digest", F.explode("runs").alias("run")).select("anchor", "digest", "run.*")
    whole = met.where("kinds = 1").select("doc_id", F.col("first").alias("from"), (F.col("last") + length).alias("to"))
    parts = met.where((F.col("kinds") > 1) & ~too_many).join(found, ["anchor", "digest"])
    if split is not None:
        # What was found of the pieces, counted from the first window of their snippets.
        mine = split.join(same.select(*keys, "kinds"), keys)
        equal = mine.where("kinds = 1").select("anchor", "digest", F.col("start").alias("from"), (F.col("start") + F.col("last") - F.col("first")).alias("to"))
        by_piece = found.select(F.col("anchor").alias(keys[0]), F.col("digest").alias(keys[1]), F.col("from").alias("_from"), F.col("to").alias("_to"))
        unequal = mine.where("kinds > 1").join(by_piece, keys).select("anchor", "digest", (F.col("start") + F.col("_from")).alias("from"), (F.col("start") + F.col("_to")).alias("to"))
        joined = equal.unionByName(unequal).groupBy("anchor", "digest").agg(F.collect_list(F.struct("from", "to")).alias("runs"))
        joined = map_arrow(joined, _join_runs, "anchor bigint, digest bigint, runs array<struct<from:int,to:int>>")
        whole_runs = joined.select("anchor", "digest", F.explode("runs").alias("run")).select("anchor", "digest", "run.*")
        parts = parts.unionByName(met.where(too_many).join(whole_runs, ["anchor", "digest"]))
    parts = parts.select("doc_id", (F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to") + length).alias("to"))
    return whole.unionByName(parts).groupBy("doc_id").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def _join_runs(batches):
    """Runs of windows that follow each other as one; a snippet has at most a window for each place of its gram."""
    for batch in batches:
        rows = []
        for anchor, digest, runs in zip(*(c.to_pylist() for c in batch.columns)):
            ends = [{"from": r["from"], "to": r["to"] + 1} for r in runs]
            rows.append((anchor, digest, [{"from": a, "to": b - 1} for a, b in merge(ends)]))
        if rows:
            yield _runs(rows)


def merge(found: list[dict] | None) -> list[tuple[int, int]]:
    """Spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in found or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remaining(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _digests(batches):
    for batch in (part for whole in batches for part in slices(whole, 1)):
        rows = {"doc_id": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data, runs = (text or "").encode("utf-8", "surrogatepass"), merge(found)
            rows["n_bytes"].append(len(data))
            rows["n_removed"].append(sum(b - a for a, b in runs))
            rows["n_spans"].append(len(runs))
            rows["kept_sha256"].append(hashlib.sha256(_remaining(data, runs)).hexdigest())
        yield pa.RecordBatch.from_pydict(rows)


def _strip(batches, text_at):
    for batch in batches:
        texts = [_remaining(t.encode("utf-8", "surrogatepass"), merge(s)).decode("utf-8", "ignore") if t is not None and s else t for t, s in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(batch.num_columns - 1)], batch.schema.names[:-1])


SPANS = "array<struct<from:int,to:int>>"


def with_spans(documents: DataFrame, found: DataFrame, name: str = "spans") -> DataFrame:
    """documents with their spans under that name, null where nothing goes; only the documents that lose bytes are joined by a shuffle."""
    ids = found.select("doc_id")
    touched = keep_ids(documents, ids, "doc_id").join(found.withColumnRenamed("spans", name), "doc_id")
    rest = drop_ids(documents, ids, "doc_id").withColumn(name, F.lit(None).cast(SPANS))
    return touched.select(*documents.columns, name).unionByName(rest)


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents without the repeated bytes; of a character cut by the edge of a removed run nothing stays. All columns stay."""
    name = "_".join(["spans", *documents.columns])
    joined = with_spans(documents, stage(spans(documents, length), "spans"), name)
    return map_arrow(joined, partial(_strip, text_at=documents.columns.index("text")), documents.schema)


def suffix_dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The op3 contract: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = with_spans(docs, stage(spans(docs, length), "spans"))
    return map_arrow(joined, _digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


#: The same in DuckDB by brute force: every window of every text is grouped by its bytes, written as hexadecimal digits.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
c AS (SELECT doc_id, n, j, substr(h, 2 * j + 1, 2 * (500 + {LENGTH})) AS h FROM (SELECT doc_id, h, n, unnest(range(0, n, 500)) AS j FROM n)),
w AS (SELECT doc_id, j + i AS i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS k
  FROM (SELECT doc_id, j, h, unnest(range(0, least(500, n - j - {LENGTH} + 1))) AS i FROM c WHERE n - j >= {LENGTH})),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM w WHERE k IN (SELECT k FROM r)),
g AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i > b + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH} AS z FROM g GROUP BY doc_id, run),
o AS (SELECT doc_id, list(struct_pack(a := a, z := z) ORDER BY a) AS runs, sum(z - a) AS removed FROM s GROUP BY doc_id),
t AS (SELECT n.doc_id, h, n, coalesce(runs, []) AS runs, coalesce(removed, 0) AS removed FROM n LEFT JOIN o ON n.doc_id = o.doc_id),
e AS (SELECT *, list_concat([0], list_transform(runs, lambda x: x.z)) AS starts, list_concat(list_transform(runs, lambda x: x.a), [n]) AS ends FROM t)
SELECT doc_id, n AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(len(runs) AS BIGINT) AS n_spans,
  sha256(unhex(list_aggregate(list_transform(range(1, len(starts) + 1), lambda j: substr(h, 2 * starts[j] + 1, 2 * (ends[j] - starts[j]))), 'string_agg', ''))) AS kept_sha256
FROM e
"""
