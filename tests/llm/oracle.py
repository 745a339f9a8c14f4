"""Compare a query with its SQL in DuckDB, row for row, as bags."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(df, sql: str, sf: str) -> int:
    cur = duck(sf).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(row) for row in cur.fetchall())
    got = Counter(tuple(r[c] for c in names) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
