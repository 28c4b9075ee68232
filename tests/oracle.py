"""Comparison of a query with its SQL in DuckDB, column by column and without regard to order."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, (list, np.ndarray)):
        return str([cell(x) for x in v])
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False, name=None))


def same(df, con, sql):
    ours, theirs = df.toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
