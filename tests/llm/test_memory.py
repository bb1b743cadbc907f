"""What goes to Python workers at once, and what they keep."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from readrouter.llm import common

MB = 1 << 20


def test_batches_are_bounded(spark):
    """3,000 texts of 10,000 bytes come in batches of the bound and a row, none is lost, and a lower bound of the session stays."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes], "total": [sum(batch.column(0).to_pylist())]})

    key = common._BATCH_KEY
    docs = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    schema = "n bigint, bytes bigint, total bigint"
    try:
        spark.conf.unset(key)
        found = common.map_arrow(docs, sizes, schema).collect()
        assert max(r["bytes"] for r in found) < common.BATCH_BYTES + MB
        assert sum(r["n"] for r in found) == 3000 and sum(r["total"] for r in found) == 3000 * 2999 // 2
        spark.conf.set(key, "1m")
        found = common.map_arrow(docs, sizes, schema).collect()
        assert max(r["bytes"] for r in found) < 2 * MB and sum(r["n"] for r in found) == 3000
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def resident():
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_freed_memory_goes_back():
    """A task frees 200 MB below objects that stay; at its end the process has given them back."""
    kept, during = [], []

    def function(batches):
        held = [bytes(10_000) for _ in range(20_000)]
        kept.append([bytes(10_000) for _ in range(100)])
        during.append(resident())
        yield from batches
        del held

    assert list(common._tidy(iter([1, 2]), function)) == [1, 2]
    assert resident() < during[0] - 150 * MB
