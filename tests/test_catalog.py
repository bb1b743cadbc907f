"""Every query with SQL gives the SQL's rows; every query without it runs."""

import glob
import math
import os

import pytest

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def names():
    from readrouter.plans import runfolders
    from readrouter.plans.catalog import QUERIES

    assert runfolders.QUERIES is QUERIES
    return sorted(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, sql, name):
    from readrouter.plans.catalog import ORACLE_SQL, QUERIES

    found, expected = QUERIES[name](spark, SF), sql.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_routes_like_a_batch(spark, tmp_path):
    from readrouter.operators.routing import demultiplex
    from readrouter.plans import derive as D
    from readrouter.streaming import arriving_reads, route_stream

    reads, samples = D.reads(spark, SF), D.samples(spark, SF)
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    query = route_stream(arriving_reads(spark, str(tmp_path / "in"), reads.schema, 1), samples, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).groupBy("route").count()
    expected = demultiplex(reads, samples).groupBy("route").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
