"""Side-by-side comparison of a registered query with its checking SQL."""

import math

import duckdb

from stellwerk.plans.adapters import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in data)


def compare(spark, con, sf_dir, build, sql):
    frame = build(spark, sf_dir)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    assert sorted(frame.columns) == sorted(names), (sorted(frame.columns), sorted(names))
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, (len(wrong), wrong[:3])
    return len(got)
