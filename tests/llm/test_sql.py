"""Queries against their SQL, over whole small tables."""

import os

import duckdb
import pytest

from lexweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(found.fetchall())


def test_sql_of_odd_texts(spark, tmp_path):
    """Null, empty, accented and repeated texts, and entities that one term gives away."""
    texts = [None, "", " \n", "x" * 250, "y" + "x" * 250, "é😀 a.b+c@d-e.f.g, 1.2.3.4 256.1.1.1 001.002.003.0255 1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111, +1 (234) 567-8901"]
    texts += [f"{w} Zanzibarquelle {w} reach secret@hidden.org soon {w}" for w in ("one", "two", "three", "four", "five")] + ["plain words only"] * 200
    texts += [f"{w} Quarzblende {w} ann@hidden.org or +1 234 567 8901 or 10.1.2.3" for w in ("one", "two", "three") for _ in range(4)] + ["Quarzblende"] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "plain WORDS"), (2, None), (3, "...")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for name, sql in ORACLES.items():
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
        assert sorted(map(tuple, got)) == sorted(found.fetchall()), name
