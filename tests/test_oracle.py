"""Every query of the engine with SQL, against DuckDB on the smallest tables, as bags of rows."""

import math
from collections import Counter

import duckdb
import pytest

from vivaspark.plans import registry
from vivaspark.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cur = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want


#: Queries without SQL that another test compares with a plain version.
ELSEWHERE = {"fused_turns", "stream_queue", "classifier_selection", "connected_components_all", "split_by_component", "nfkc_normalisation", "stream_leases", "grouped_folds"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - ELSEWHERE))
def test_query_without_sql_repeats_itself(spark, sf, name):
    first, again = (sorted(map(str, registry.QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert first and first == again
