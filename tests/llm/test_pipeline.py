"""The pipeline's stages on the smallest tables, each against what its operator says of its own input."""

import collections

import numpy as np

import corpus_pipeline as pipeline
from readrouter.llm.common import stage, table
from readrouter.llm.lines import LEAST_PAGES, RATIO
from readrouter.llm.near_dedup import near_duplicates
from readrouter.llm.packing import cut

from test_dedup import brute_groups, brute_spans
from test_text import check_packing

SF = "/root/testdata/sf0.001"


def check_near(before, after):
    """One document of each group by brute force stays, texts as they were."""
    docs = sorted((r["doc_id"], r["text"]) for r in before.collect())
    kept = [docs[i] for i, (_, group) in enumerate(brute_groups([t for _, t in docs], 5)) if group == i]
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == kept


def check_suffix(before, after):
    docs = sorted((r["doc_id"], r["text"]) for r in before.collect())
    found = {r["doc_id"]: r["text"] for r in after.collect()}
    for (i, _), (data, covered) in zip(docs, brute_spans([t for _, t in docs], 200)):
        assert found[i] == np.frombuffer(data, np.uint8)[~covered].tobytes().decode("utf-8", "ignore")


def check_lines(before, after):
    """Lines of more than a twentieth of a source's documents, and of five at least, go."""
    pages, holds = collections.Counter(), collections.Counter()
    for r in before.collect():
        pages[r["source"]] += 1
        holds.update({(r["source"], x.strip(" ")) for x in (r["text"] or "").split("\n") if x.strip(" ")})
    found = {r["doc_id"]: r["text"] for r in after.collect()}
    for r in before.collect():
        own = [x for x in (r["text"] or "").split("\n") if not x.strip(" ") or not (holds[r["source"], x.strip(" ")] >= LEAST_PAGES and holds[r["source"], x.strip(" ")] > pages[r["source"]] * RATIO)]
        assert found[r["doc_id"]] == "\n".join(own)


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, held = docs.columns, {}
    for name, function in pipeline.STAGES:
        out = stage(function(spark, docs, SF), "out")
        held[name] = (docs, out)
        if name != "packing":
            assert out.columns == columns and out.count() <= docs.count()
        docs = out
    before, after = held["near dedup"]
    kept = {r["doc_id"] for r in near_duplicates(before).where("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept and 0 < len(kept) < before.count()
    before, after = held["line dedup"]
    assert before.count() == after.count()
    before, after = held["suffix dedup"]
    assert before.count() == after.count()
    assert sum(len(r["text"]) for r in after.collect()) < sum(len(r["text"]) for r in before.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    check_near(*held["near dedup"])
    check_suffix(*held["suffix dedup"])
    check_lines(*held["line dedup"])
    before, packed = held["packing"]
    assert check_packing(packed.collect(), 2048) == max(-(-sum(r["length"] for r in packed.collect()) // 2048), 1)
    assert packed.count() == cut(before).count()


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
