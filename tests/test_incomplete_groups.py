"""Group queries against their SQL where the last group has fewer than five items, or one."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.test_entry import values


@pytest.fixture(scope="module", params=[496, 498])
def odd_folder(request, tmp_path_factory):
    """The small tables with the first 496 (or 498) vectors, and a connection to them."""
    path, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    for t in ("embeddings", "documents", "part"):
        where = f" where vec_id < {request.param}" if t == "embeddings" else ""
        con.sql(f"copy (select * from '{SF}/{t}.parquet'{where}) to '{path}/{t}.parquet' (format parquet)")
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["a_group_features", "s2_group_scan", "s9_answer_lines", "a10_group_answers"])
def test_against_sql(spark, odd_folder, name):
    path, con = odd_folder
    got, want = entry.queries()[name](spark, path), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert values([r.asDict() for r in got.collect()], columns) == values(want.to_dict("records"), columns)
