"""Queries against their SQL, over whole small tables."""

import os

import duckdb
import pytest

from lexweave.plans.oracles import ORACLES
from lexweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(k for k in ORACLES if k.startswith("unigram")))
def test_query_equals_sql(spark, con, name):
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(found.fetchall())
