"""Every core query against its SQL twin in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from corpusloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_all_but_the_stream_have_a_twin():
    assert set(QUERIES) - set(ORACLES) == {"o14_file_watch", "o2_tokenizer_shards", "m6_training"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    rows = sorted(tuple(str(r[c]) for c in names) for r in df.collect())
    at = [want.columns.index(c) for c in names]
    assert rows == sorted(tuple(str(r[k]) for k in at) for r in want.fetchall())
    assert rows


@pytest.mark.parametrize("name", ["e7_headline", "e8_deltas", "e9_factorial", "f10_planned_steps", "f13_cache_footprint", "f7_weights", "f9_cosine_rate", "m2_rotary_table", "m3_parameter_groups", "o13_preflight"])
def test_parameters_come_from_a_table(spark, tmp_path, name):
    """Without the tables there is nothing to compute."""
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        QUERIES[name](spark, str(tmp_path)).collect()
