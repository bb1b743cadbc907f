"""Toxicity, quality, HTML, BPE, lines, packing and top-k on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readrouter.llm import bpe, html_text, lines, packing, quality, topk, toxicity

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " ", "\n\n", "word", "x" * 300_000, "a  b\t c\n", "é ü ß 漢字 🙂", "<|endoftext|> in a text<|endoftext|>", "it's we'll  don't ", "1 234 5678", "a b  c", "\x1c \x85 x", " lead", "trail "]


def documents(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)], DOC)


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    random.seed(3)
    texts = ODD + ["".join(random.choice("ab '.\n\t 1é🙂") for _ in range(random.randint(0, 60))) for _ in range(200)] + ["the same"] * 3
    found = {r["doc_id"]: r for r in bpe.round_trip(documents(spark, texts)).collect()}
    assert len(found) == len(texts)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        expected = library.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == expected, repr(t)
        assert found[i]["n_tokens"] == len(expected)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(library.decode(expected, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(documents(spark, texts))
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(documents(spark, [])).count() == 0
    assert list(bpe.Encoder(path).many(texts)) == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_every_character_is_split_as_in_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    text = [f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(1, 0x3100)]
    for t, ids in zip(text, bpe.Encoder(path).many(text)):
        assert ids == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def check_packing(rows, capacity):
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD + ["some words " * n for n in range(1, 200, 3)] + ["again and again"] * 40
    rows = packing.best_fit(documents(spark, texts), 64).collect()
    assert check_packing(rows, 64) == -(-sum(r["length"] for r in rows) // 64)
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 64 for r in own[1:])
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
    assert packing.best_fit(documents(spark, []), 64).count() == 0


@pytest.mark.parametrize("slots", [0, 500_000])
def test_packing_by_blocks_of_ranks(spark, monkeypatch, slots):
    """A length that most pieces share is placed by blocks of its ranks, with the plan broadcast or dealt by a shuffle."""
    monkeypatch.setattr(packing, "BLOCK", 16)
    monkeypatch.setattr(packing, "BROADCAST_SLOTS", slots)
    lengths = [64] * 700 + random.Random(3).choices(range(1, 65), k=300)
    pieces = spark.createDataFrame([(i // 2, i % 2, n) for i, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint")
    rows = packing.pack(pieces, 64).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in rows) == sorted((i // 2, i % 2, n) for i, n in enumerate(lengths))
    assert check_packing(rows, 64) == sum(n for _, n in packing.plan({n: lengths.count(n) for n in set(lengths)}, 64))


def test_fullest_is_best():
    random.seed(1)
    for _ in range(200):
        counts = {random.randint(1, 12): random.randint(1, 3) for _ in range(4)}
        room = random.randint(0, 30)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        chosen = packing.fullest(counts, room)
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in chosen.items())
        bins = packing.plan(counts, 30)
        assert {x: sum(c.get(x, 0) * t for c, t in bins) for x in counts} == counts


@pytest.mark.parametrize("limit", [lines.BROADCAST_LINES, 0])
def test_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_LINES", limit)
    rows = [(i, f"menu\nown {i}\n\n menu ", "a", "x") for i in range(10)] + [(10, None, "a", "x"), (11, "", None, "x"), (12, "menu", "b", "x"), (13, "menu\nmenu", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_lines string")
    found = {r["doc_id"]: r for r in lines.drop_boilerplate(docs).collect()}
    assert len(found) == 14
    assert found[3]["text"] == "own 3\n" and (found[3]["n_lines"], found[3]["n_dropped"]) == (4, 2)
    assert found[10]["text"] is None and found[10]["n_lines"] == 0
    assert found[11]["text"] == "" and found[12]["text"] == "menu" and found[13]["text"] == "menu\nmenu"
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


def test_lines_are_native(spark):
    plan = lines.line_dedup(documents(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_top(rows, k):
    bits = {i: [bool(v is not None and j < len(v) and v[j] is not None and v[j] > 0) for j in range(64)] for i, v in rows if i is not None}
    out = set()
    for q in bits:
        if q % 100 == 0:
            near = sorted((sum(a != b for a, b in zip(bits[q], bits[i])), i) for i in bits)[:k]
            out |= {(q, n, i, d) for n, (d, i) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("n, copies", [(300, 0), (120, 60), (5, 0), (0, 0)])
def test_top_k(spark, n, copies):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(n)] + [(1000 + i, [1.0] * 64) for i in range(copies)]
    if n > 100:
        rows += [(2000, None), (2100, [1.0, None, -1.0]), (None, [1.0] * 64), (2200, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = topk.exact_top_k(df, 7).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in found} == brute_top(rows, 7)
    assert len(found) == len(brute_top(rows, 7))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a></ul></nav><header><h2>Site name</h2></header><div class="cookie-banner">We use cookies</div>
%s<aside>Side</aside><section id="comments"><p>First!</p></section><form><p>Subscribe</p></form><footer><p>&copy; me</p></footer></body></html>"""


@pytest.mark.parametrize(
    "body, expected",
    [
        ("<article><header><h1>Title</h1></header><p>One  two\n three.<p>Fish &amp; <b>chips</b>&nbsp;&#33;<br>More</article>", "Title\nOne two three.\nFish & chips ! More"),
        ("<div id=main><div><p>" + "Long text goes here. " * 20 + "</p><p>" + "And more of it. " * 20 + "</p></div></div>", ("Long text goes here. " * 20).strip() + "\n" + ("And more of it. " * 20).strip()),
        ("<main><h1>A</h1><div class=ad>Buy</div><ul><li>x<li>y</ul><!-- no --><p hidden>no</p></main>", "A\nx\ny"),
        ("<article></article>", ""),
    ],
)
def test_html(body, expected):
    assert html_text.main_text(PAGE % body) == expected


def test_html_odd(spark):
    assert html_text.main_text("just text") == "just text"
    for broken in ("<p", "<!-- x", "<script>x", "<p a='", "</p>", "<", "a < b", "<![CDATA[x", "<div>" * 3000 + "deep", '<a href="' * 2000):
        assert isinstance(html_text.main_text(broken), str)
    assert html_text.main_text("a < b &lt; c") == "a < b < c"
    rows = [(1, "u", None, 1), (2, None, "", 1), (3, "u", PAGE % "<article><p>x</p></article>", 1)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in found) == [(1, "", 0), (2, "", 0), (3, "x", 1)]
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def labelled(spark, n=600):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, labels = [], []
    for i in range(n):
        bad, junk = i % 4 == 0, i % 5 == 0
        words = [word() for _ in range(40)]
        if bad:
            words[rng.randrange(40)] = "idiot"
            words[rng.randrange(40)] = "moron"
        text = " ".join(w + "$$$" for w in words) if junk else " ".join(words) + "."
        texts.append(text)
        labels.append((i, int(not junk), int(bad)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity(spark):
    docs, labels = labelled(spark)
    extra = spark.createDataFrame([(9000, None, "x", "x", None), (9001, "", "x", "x", 0), (9002, "z" * 100_000, "x", "x", 0), (None, "idiot moron", None, None, None)], DOC)
    rows = toxicity.toxicity(docs.unionByName(extra), labels).collect()
    assert len(rows) == 604 and all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    for r in rows:
        if r["doc_id"] in truth:
            assert r["held_out"] == fold(r["doc_id"]) and r["predicted"] == truth[r["doc_id"]] == int(r["score"] >= 0.5)
    kept = toxicity.reject_toxic(docs.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == [*docs.columns, "score"] and {r["doc_id"] for r in kept.collect()} == {i for i, t in truth.items() if not t}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = labelled(spark, 200)
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, x).collect()} for x in (labels, wrong))
    assert a == b


def test_machine_learns_pairs():
    """Two terms that are harmless apart and toxic together."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 2))
    rows = [np.flatnonzero(r).tolist() for r in x]
    machine = toxicity.fit_machine(rows, (x[:, 0] & x[:, 1]).astype(int), [10, 20], steps=600)
    assert machine.score([0, 1]) > 0.8 and max(machine.score([0]), machine.score([1]), machine.score([])) < 0.3


def test_quality(spark):
    docs, labels = labelled(spark)
    extra = spark.createDataFrame([(9000, None, "x", "x", None), (9001, "", "x", "x", 0)], DOC)
    rows = quality.quality(docs.unionByName(extra), labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["doc_id"] in truth and r["held_out"]]
    assert len(rows) == 602 and np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_prior():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    unlabelled = np.concatenate([good[:1200], bad[:2800]])
    assert abs(quality.estimate_prior(good[2000:], unlabelled) - 0.3) < 0.06


LONG = "A sentence of the article that goes on for a good while, with words enough to be dense. " * 6


@pytest.mark.parametrize("body, held", [
    (f'<div class="content has-sidebar"><article><p>{LONG}</p></article></div>', LONG.strip()),
    (f'<div class="sidebar"><div><p>{LONG}</p><p>{LONG}</p></div></div>', LONG.strip()),
    (f'<article><p>{LONG}</p><h2 id="side-effects">Side effects</h2><h2 class="related">Related work</h2><p>{LONG}</p></article>', "Side effects\nRelated work"),
    (f'<article><p>{LONG}</p><section id="search-methods"><p>We searched.</p></section></article>', "We searched."),
    (f'<article><p>{LONG} <math><mi>x</mi></math> end</p></article>', "x end"),
])
def test_html_keeps_what_only_sounds_apart(body, held):
    assert held in html_text.main_text(f"<html><body>{body}</body></html>")


def test_html_density_alone_finds_what_an_article_element_marks():
    import re

    import pyarrow.parquet as pq

    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        page = row["html"] or ""
        plain = re.sub(r"<(/?)(article|main)\b", r"<\1div", page)
        assert plain == page or html_text.main_text(plain) == html_text.main_text(page)


def brute_density(node, whole):
    """(chars, link chars, tags, link tags), density and density sum, each from the whole subtree again."""
    import math

    def counts(x, linked):
        chars = link_chars = tags = link_tags = 0
        for c in x.children:
            if isinstance(c, str):
                chars += len(" ".join(c.split()))
                link_chars += linked * len(" ".join(c.split()))
            else:
                a = counts(c, linked or c.tag == "a")
                chars, link_chars, tags = chars + a[0], link_chars + a[1], tags + a[2] + 1
                link_tags += a[3] + (c.tag == "a" and not linked) * (a[2] + 1 - a[3])
        return chars, link_chars, tags, link_tags

    def density(chars, link_chars, tags, link_tags):
        if not chars:
            return 0.0
        ratio = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
        base = math.log(chars / max(chars - link_chars, 1) * link_chars + whole * chars + math.e)
        log = math.log(max(ratio, 1 + 1e-9))
        return chars / max(tags, 1) * max(log / math.log(max(base, 1 + 1e-9)) if base > 1 else log, 0.0)

    return counts(node, node.tag == "a"), density(*counts(node, node.tag == "a"))


def test_html_densities_of_random_trees():
    rng = random.Random(9)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return "text " * rng.randint(0, 12)
        tag = rng.choice(["div", "p", "section", "b", "span", "td"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>" + ("<a href=x>a link</a>" if rng.random() < 0.2 else "")

    for _ in range(60):
        root = html_text.parse(f"<body>{tree(5)}</body>")
        order = html_text._nodes(root)
        body = next(n for n in order if n.tag == "body")
        html_text._measure(order, body)
        whole = body.link_chars / max(body.chars, 1)
        for node in order:
            expected, density = brute_density(node, whole)
            assert (node.chars, node.link_chars, node.tags) == expected[:3]
            if node.tag != "a":
                assert abs(node.density - density) < 1e-6 * max(1.0, density)
            # The sum of the densities of block children, without runs of text, never passes the density sum.
            blocks = [c.density for c in node.children if not isinstance(c, str) and (c.tag not in html_text.INLINE or c.holds_block)]
            assert node.total >= sum(blocks) - 1e-6


@pytest.mark.parametrize("page", ["<b>" * 16_000 + "x", "<b>" * 8_000 + "<hr>" * 8_000, "<div>" * 8_000 + "<li>a</li>" * 8_000, "<i><div>" + "<b>" * 8_000 + "</i>" * 8_000, "<td><table>" + "<div>" * 8_000 + "<td>x</td>" * 8_000])
def test_html_takes_time_in_proportion(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 3


@pytest.mark.parametrize("filler, vocabulary", [(20, 300), (40, 1000)])
def test_toxicity_finds_terms_that_matter_only_in_pairs(spark, filler, vocabulary):
    """Toxic where exactly one of two words stands: neither says anything alone."""
    rng = random.Random(filler)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(vocabulary)]
    texts, truth = [], {}
    for i in range(1500):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        own = rng.choices(words, k=filler) + ["ravenous"] * one + ["quill"] * two
        rng.shuffle(own)
        texts.append((i, " ".join(own)))
        truth[i] = int(one != two)
    docs, labels = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(list(truth.items()), "doc_id bigint, toxic int")
    rows = toxicity.toxicity(docs, labels).where("held_out").collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.9


def test_toxicity_of_repeated_rows_and_clashing_columns(spark):
    docs, labels = labelled(spark, 200)
    twice = docs.unionByName(docs.where("doc_id < 50"))
    rows = toxicity.toxicity(twice, labels).collect()
    scores = {}
    for r in rows:
        scores.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(rows) == 250 and all(len(s) == 1 for s in scores.values())
    clash = docs.withColumn("label", F.lit("x")).withColumn("present", F.lit("x")).withColumn("held_out", F.lit("x"))
    assert toxicity.toxicity(clash, labels.withColumn("text", F.lit("x")).withColumn("label", F.lit(7))).count() == 200
    assert toxicity.toxicity(docs, labels.withColumn("toxic", F.lit(None).cast("int"))).count() == 200


@pytest.mark.parametrize("sf, least", [("sf0.1", 0.985)])
def test_toxicity_ranks_the_held_out_fold(spark, sf, least):
    folder = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    good, bad = ([r["score"] for r in rows if r["toxic"] == k] for k in (0, 1))
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) >= least


def test_quality_tells_fluent_texts_apart_by_their_words(spark):
    """Good and bad texts of equal statistics, which differ in the words that they use."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    texts, truth = [], {}
    for i in range(1200):
        truth[i] = int(rng.random() < 0.5)
        texts.append((i, " ".join(rng.choices(words[:160] if truth[i] else words[120:280], k=60)) + "."))
    docs, labels = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(list(truth.items()), "doc_id bigint, quality int")
    rows = quality.quality(docs, labels).where("held_out").collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.9


def test_quality_of_long_and_repeated_texts_and_clashing_columns(spark):
    docs, labels = labelled(spark, 200)
    docs = docs.unionByName(documents(spark, ["word " * 200_000, "x" * 1_000_000]).withColumn("doc_id", F.col("doc_id") + 9000)).unionByName(docs.where("doc_id < 50"))
    clash = docs.withColumn("half", F.lit("x")).withColumn("held_out", F.lit("x")).withColumn("x", F.lit(1)).withColumn("words", F.lit(1))
    rows = quality.quality(clash, labels.withColumn("text", F.lit("x")).withColumn("half", F.lit("x"))).collect()
    scores = {}
    for r in rows:
        scores.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(rows) == 252 and all(len(s) == 1 and 0 <= min(s) and max(s) <= 1 for s in scores.values())


def test_quality_ranks_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.quality(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (b == g) for b in bad for g in good]) >= 0.99
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


def test_top_k_of_long_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=int(rng.integers(60, 150))).tolist()) for i in range(301)]
    found = topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), 5).collect()
    signs = {i: [j < len(v) and v[j] > 0 for j in range(150)] for i, v in rows}
    for q in (0, 100, 200, 300):
        expected = sorted((sum(a != b for a, b in zip(signs[q], signs[i])), i) for i in signs)[:5]
        assert [(r["distance"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == expected


def test_lines_of_clashing_columns(spark):
    rows = [(i, f"menu\nown {i}", "a", "h", 7) for i in range(10)]
    found = lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string, _host string, _lines int")).collect()
    assert sorted((r["doc_id"], r["text"], r["_host"], r["_lines"]) for r in found) == [(i, f"own {i}", "h", 7) for i in range(10)]
