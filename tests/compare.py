"""Rows of Spark and of DuckDB in one form."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v).replace("+00:00", "")


def spark_rows(df, columns):
    return sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def duck_rows(connection, sql, columns):
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in columns]
    return sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
