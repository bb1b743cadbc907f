"""Every text query with SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


def names():
    from readrouter.llm.queries import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    import duckdb
    from readrouter.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found, expected = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, expected.select(*columns).fetchall()))


def edge_cases():
    passage = "".join(f"word{i} " for i in range(60))
    same = "one two three four five six seven eight nine ten"
    texts = [None, "", " \t\n", "a b", "A B", "b a", same, same.upper(), same + " eleven", "é" * 300, "x" * 500, passage, "before " + passage + "after", passage * 3, "ü " + passage]
    return list(enumerate(texts))


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op9_near_dedup"])
def test_edge_cases(spark, tmp_path, name):
    """Nulls, empty and short texts, letters of several bytes, copies and a passage repeated in one text."""
    import duckdb
    from readrouter.llm.queries import ORACLE_SQL, QUERIES

    spark.createDataFrame(edge_cases(), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found, expected = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, expected.select(*columns).fetchall()))
