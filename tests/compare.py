"""Running a registered query and its SQL on the same tables, and comparing the rows in any order."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), sorted(names)


def check(spark, con, name, query, sql, sf_dir):
    got = query(spark, sf_dir)
    ours, our_names = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs, their_names = rows_of(names, cur.fetchall())
    assert our_names == their_names, (name, our_names, their_names)
    assert len(ours) == len(theirs), (name, len(ours), len(theirs))
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not wrong, (name, len(wrong), wrong[:3])
    return len(ours)
