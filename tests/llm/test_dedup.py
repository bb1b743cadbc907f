"""Suffix arrays, near-duplicates and fingerprints against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from readrouter.llm import fingerprints, near_dedup, suffix_dedup
from readrouter.llm.induced import sorted_suffixes

DOC = "doc_id bigint, text string, spans string"
WORDS = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "épsilon") for b in range(40)]


def documents(spark, texts):
    return spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], DOC)


def corpus(seed=0, n=60):
    """Copies, near copies, shared passages, short, empty and long texts."""
    rng = random.Random(seed)
    make = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage, base = make(60), make(120).split()
    texts = [None, "", " \n", "one two", "one two", "ONE Two", "one two three four", "z" * 500, "ab " * 400, make(3000)]
    for i in range(n):
        kind = i % 4
        if kind == 0:
            texts.append(make(rng.randint(1, 150)))
        elif kind == 1:
            texts.append(f"{make(20)} {passage} {make(20)}")
        else:
            own = list(base)
            for _ in range(rng.randint(0, 8)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            texts.append(" ".join(own))
    return texts + texts[12:15]


@pytest.mark.parametrize("limit", [4, 60, 1 << 20])
def test_induced_sorting(limit):
    rng = random.Random(limit)
    for _ in range(60):
        n, k, cap = rng.randint(1, 250), rng.choice([1, 2, 3, 26]), rng.choice([3, 10, 200])
        text = np.array([rng.randint(1, k) for _ in range(n)] + [0], np.uint8)
        if n > 40:
            text[n // 2 : n // 2 + 15] = text[:15]
        found = list(sorted_suffixes(text, cap, limit))
        positions, prefixes = (np.concatenate(x) for x in zip(*found))
        assert sorted(positions.tolist()) == list(range(n + 1))
        keys = [bytes(text)[p : p + cap] for p in positions]
        assert keys == sorted(keys)
        for a, b, m in zip(keys, keys[1:], prefixes[1:].tolist()):
            assert m == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    for b in data:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = True
        yield b, covered


@pytest.mark.parametrize("seed, chunk, hot", [(0, suffix_dedup.CHUNK, suffix_dedup.HOT), (1, 700, suffix_dedup.HOT), (2, suffix_dedup.CHUNK, 2), (3, 700, 3)])
def test_suffix_dedup(spark, monkeypatch, seed, chunk, hot):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup.spans, "__defaults__", (200, 1 << 24, hot))
    staged, stage = [], suffix_dedup.stage
    monkeypatch.setattr(suffix_dedup, "stage", lambda df, name: [staged.append(name), stage(df, name)][1])
    texts = corpus(seed)
    found = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(documents(spark, texts)).collect()}
    assert ("pieces" in staged) == (hot < suffix_dedup.HOT)
    assert len(found) == len(texts)
    for i, (data, covered) in enumerate(brute_spans(texts, 200)):
        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        r = found[i * 3]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("limit", [1 << 24, 300])
def test_shards_are_sorted_by_groups_of_anchors(monkeypatch, limit):
    import pyarrow as pa

    rng = random.Random(limit)
    passage = bytes(rng.choices(range(97, 101), k=80))
    rows = [(anchor, i, 1, bytes(rng.choices(range(97, 101), k=rng.randint(0, 40))) + passage + bytes(rng.choices(range(97, 101), k=rng.randint(0, 40)))) for anchor in range(6) for i in range(rng.randint(1, 12))]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["anchor", "digest", "n", "snippet"])
    batches = [batch.slice(0, 7), batch.slice(7)]
    found = {}
    for group in (1 << 24, 500):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        out = suffix_dedup._sort_shard(batches, 50, limit)
        found[group] = {(r["anchor"], r["digest"]): r["runs"] for b in out for r in b.to_pylist()}
    # Windows of different anchors differ in real shards; here the passage stands under each, so groups of one anchor find less.
    for anchor, digest, _, snippet in rows:
        others = [s for a, d, _, s in rows if a == anchor]
        windows = [sum(s.startswith(snippet[i : i + 50], j) for s in others for j in range(len(s))) > 1 for i in range(len(snippet) - 49)]
        want = {i for i, w in enumerate(windows) if w}
        got = {i for r in found[500].get((anchor, digest), ()) for i in range(r["from"], r["to"] + 1)}
        assert want <= got <= {i for r in found[1 << 24][anchor, digest] for i in range(r["from"], r["to"] + 1)}


def test_pieces_share_their_anchor_where_their_windows_are_equal():
    rng = random.Random(5)
    passage = " ".join(rng.choice(WORDS) for _ in range(60)).encode()
    owners = collections.defaultdict(set)
    cores = collections.defaultdict(set)
    for _ in range(40):
        text = bytes(rng.choices(range(97, 123), k=rng.randint(100, 300))) + passage + bytes(rng.choices(range(97, 123), k=250))
        number, anchor, digest, first, last = suffix_dedup.anchors([text], 200)
        for a, f, z in zip(anchor.tolist(), first.tolist(), last.tolist()):
            covered = 0
            for i, j, own, piece in suffix_dedup.pieces(text[f : z + 200], a, 200):
                assert i == covered and j - i < suffix_dedup.PIECE
                covered = j + 1
                for w in range(i, j + 1):
                    owners[text[f + w : f + w + 200]].add(own)
                cores[own].add(text[f + i : f + j + 200])
            assert covered == z - f + 1
    assert all(len(x) == 1 for x in owners.values())
    assert max(len(x) for x in owners.values()) == 1 and any(len(x) > 1 for x in cores.values())


def test_suffix_dedup_text(spark):
    texts = ["x" + "é" * 150 + "y", "z" + "é" * 150 + "w", None, "short"]
    docs = documents(spark, texts).unionByName(spark.createDataFrame([(None, "z" + "é" * 150 + "w", "x")], DOC))
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str(x) for x in [(0, "xy"), (3, "zw"), (6, None), (9, "short"), (None, texts[1])])
    assert suffix_dedup.suffix_dedup(documents(spark, [])).count() == 0


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return frozenset() if not words else frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_groups(texts, k):
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed, block, partners", [(0, 2048, 1000), (1, 3, 2), (2, 2048, 1000)])
def test_near_duplicates(spark, monkeypatch, seed, block, partners):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PARTNERS", partners)
    texts = corpus(seed, 120)
    docs = documents(spark, texts).unionByName(spark.createDataFrame([(None, texts[20], "x")], DOC))
    docs = docs.unionByName(docs.where("doc_id = 60"))
    rows = near_dedup.near_duplicates(docs, 4).collect()
    assert len(rows) == len(texts) + 2
    found = {r["doc_id"]: r for r in rows}
    for i, (n, group) in enumerate(brute_groups(texts, 4)):
        r = found[i * 3]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (n, group * 3, group == i)
    assert found[None]["component_id"] is None and found[None]["kept"]
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_sketches_of_unions():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (300, 40))
    one, two, both = near_dedup.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(one, two) == both).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 540)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    found = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {n: find(n) for a, b in edges if a != b for n in (a, b)}


@pytest.mark.parametrize("at_once", [0, 1 << 22])
def test_components_of_bounded_links_take_one_round(spark, monkeypatch, at_once):
    """A path, whose rounds of joins grow with its length, a star and a link of a node with itself: two tables staged, as links fit one task, else many."""
    monkeypatch.setattr(near_dedup, "EDGES_AT_ONCE", at_once)
    staged = []
    monkeypatch.setattr(near_dedup, "stage", lambda df, name, stage=near_dedup.stage: staged.append(name) or stage(df, name))
    path = list(range(100, 164))
    random.Random(5).shuffle(path)
    edges = [*zip(path, path[1:]), *((7, i) for i in range(8, 20)), (-(1 << 62), 7), (3, 3)]
    found = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 100 for i in path} | {i: -(1 << 62) for i in [7, *range(8, 20), -(1 << 62)]}
    assert (len(staged) == 2) == (at_once > 0)
    assert near_dedup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def elements(text):
    return collections.Counter(re.findall(r"[^ \t\n\x0b\f\r]+(?:[ \t\x0b\f\r]+[^ \t\n\x0b\f\r]+){0,11}", text))


def likeness(a, b):
    a, b = elements(a), elements(b)
    return 1.0 if not a and not b else sum((a & b).values()) / sum((a | b).values())


@pytest.mark.parametrize("part", [fingerprints.PART, 5])
def test_fingerprints(spark, monkeypatch, part):
    monkeypatch.setattr(fingerprints, "PART", part)
    texts = corpus(7) + ["line\n" * 200, "a b c\n" * 3]
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(documents(spark, texts).repartition(5)).collect()}
    assert len(rows) == len(texts)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        other = plain[(i + 1) % len(plain)]
        k = len(t) // 4
        edited = t[: len(t) - k] + other[:k]
        r = rows[i * 3]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(t, edited)) < 1e-9
        assert abs(r["near_next"] - likeness(t, other)) < 1e-9
    same = collections.defaultdict(set)
    for i, t in enumerate(plain):
        same[t].add(rows[i * 3]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    assert fingerprints.fingerprints(documents(spark, [])).count() == 0
    one = fingerprints.fingerprints(documents(spark, ["only one text"])).first()
    assert one["near_edited"] == 0.0 or one["near_edited"] == 1.0
    plan = fingerprints.with_next(documents(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert F is not None


@pytest.mark.parametrize("part", [fingerprints.PART, 5])
def test_every_pair_of_fingerprints_peels(spark, monkeypatch, part):
    """Dissimilar texts, one that the next holds whole, and one with a large part of the next."""
    monkeypatch.setattr(fingerprints, "PART", part)
    rng = random.Random(11)
    lines = ["\n".join(" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(k)) for k in (60, 700, 90, 90, 300, 2, 400)]
    texts = [lines[0], f"{lines[0]}\n{lines[1]}", lines[2], f"{lines[2][: len(lines[2]) // 5]}\n{lines[3]}", lines[4], lines[5], lines[6], *corpus(3)]
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(documents(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        other = plain[(i + 1) % len(plain)]
        edited = t[: len(t) - len(t) // 4] + other[: len(t) // 4]
        assert abs(rows[i * 3]["near_edited"] - likeness(t, edited)) < 1e-9
        assert abs(rows[i * 3]["near_next"] - likeness(t, other)) < 1e-9


def test_fingerprint_query_takes_runs_of_12_words(spark, tmp_path):
    from readrouter.llm.queries import op7_fingerprints

    rng = random.Random(5)
    text = [rng.choice(WORDS) for _ in range(600)]
    near = [rng.choice(WORDS) if i % 13 == 0 else w for i, w in enumerate(text)]
    texts = [" ".join(text), " ".join(near), " ".join(text[:300])]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in op7_fingerprints(spark, str(tmp_path)).collect()}

    def runs(t):
        w = t.split()
        return collections.Counter(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))

    for i, t in enumerate(texts):
        other = texts[(i + 1) % 3]
        a, b = runs(t), runs(other)
        assert abs(rows[i * 3]["near_next"] - sum((a & b).values()) / sum((a | b).values())) < 1e-9


def test_differences_are_those_of_the_element_sets(spark, monkeypatch):
    """As many digests on each side as elements of one text alone; equal elements have equal digests wherever they stand."""
    monkeypatch.setattr(fingerprints, "PART", 6)
    texts = corpus(13, 24)
    plain = [t or "" for t in texts]
    found = collections.defaultdict(set)
    for r in fingerprints.differences(documents(spark, texts)).collect():
        assert r["digest"] not in found[r["doc_id"], r["pair"], r["side"]]
        found[r["doc_id"], r["pair"], r["side"]].add(r["digest"])
    for i, t in enumerate(plain):
        other = plain[(i + 1) % len(plain)]
        for pair, b in (("next", other), ("edited", t[: len(t) - len(t) // 4] + other[: len(t) // 4])):
            assert len(found[i * 3, pair, 1]) == sum((elements(t) - elements(b)).values())
            assert len(found[i * 3, pair, -1]) == sum((elements(b) - elements(t)).values())


def test_fingerprint_of_an_edited_text_is_that_of_the_same_text(spark):
    texts = corpus(5, 20)
    first = {r["doc_id"]: r for r in fingerprints.fingerprints(documents(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 4] + plain[(i + 1) % len(plain)][: len(t) // 4] for i, t in enumerate(plain)]
    second = {r["doc_id"]: r for r in fingerprints.fingerprints(documents(spark, edited)).collect()}
    for i in range(len(texts)):
        assert first[i * 3]["edited_fingerprint"] == second[i * 3]["fingerprint"]


def test_fingerprints_are_native(spark):
    """No Python, pandas or Arrow step in the plan of the comparison."""
    plan = fingerprints._compare(documents(spark, ["a b", "b c", "c"]), 12)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_external_queue_keeps_its_order_and_takes_time_in_proportion():
    """A text forty times the limit: the order of the one in memory, in seconds."""
    import time

    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).tolist()) for _ in range(3000)]
    text = np.frombuffer(b" ".join(words[i] for i in rng.integers(0, 3000, 160_000))[:800_000] + b"\0", np.uint8)
    inside = [np.concatenate(x) for x in zip(*sorted_suffixes(text, 200))]
    began = time.process_time()
    outside = [np.concatenate(x) for x in zip(*sorted_suffixes(text, 200, 20_000))]
    assert time.process_time() - began < 30
    assert (inside[0] == outside[0]).all() and (inside[1] == outside[1]).all()


def test_removed_passages_leave_every_column(spark):
    texts = ["é" * 300, "é" * 300, "own"]
    rows = suffix_dedup.remove_repeats(documents(spark, texts).withColumn("from", F.lit(1))).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["spans"], r["from"]) for r in rows] == [(0, "", "x", 1), (3, "", "x", 1), (6, "own", "x", 1)]
