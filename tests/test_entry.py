"""The driver contract: names, columns, and agreement with SQL on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def values(rows, columns):
    out = []
    for r in rows:
        out.append(tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in (r[c] for c in columns)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["p2_dictionary", "p4_currency", "f_pair_features", "a_group_features", "r5_full_chain", "e1_pairwise_f1", "m1_positives"])
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert values([r.asDict() for r in got.collect()], columns) == values(want.to_dict("records"), columns)
