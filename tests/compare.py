"""Spark rows against DuckDB's, whatever the order."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    expected = sorted((str(tuple(_plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall()))
    found = sorted(str(tuple(_plain(r[c]) for c in cols)) for r in df.collect())
    assert found == expected
