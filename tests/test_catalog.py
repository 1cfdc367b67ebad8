"""Every query against its reference SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from voxtally.plans.catalog import QUERIES
from voxtally.plans.oracle import ORACLE

SF = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(table):
    names = sorted(table.column_names)

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9) + 0.0
        return v

    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted((tuple(value(v) for v in row) for row in zip(*columns)), key=repr)


def test_survey_queries_have_reference_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = canonical(QUERIES[name](spark, str(SF)).toArrow())
    want = canonical(duck.sql(ORACLE[name]).to_arrow_table())
    assert got == want
    assert want[1], "an empty result checks nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
