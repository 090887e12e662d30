"""Runs a query and its SQL over the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order)) for r in rows)


def compare(spark, sf_dir, query, sql):
    found = query(spark, sf_dir)
    con = connect(sf_dir)
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    wanted = result.fetchall()
    assert sorted(found.columns) == sorted(names)
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    assert got == rows_of(names, wanted)
