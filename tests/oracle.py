"""Holding a query against its SQL on the small tables, if these are there."""

import os

import duckdb

FOLDER = os.environ.get("TURNLOOM_TESTDATA", "/root/testdata/sf0.001")


def _plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, float):
        return round(x, 9)
    if hasattr(x, "isoformat"):
        return str(x)[:26]
    return [_plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def differences(spark, query, sql):
    """Rows of one side only, as two lists, with the columns in the order of their names."""
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    df = query(spark, FOLDER)
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(sql).columns)
    ours = sorted(([_plain(x) for x in r] for r in df.select(*columns).collect()), key=repr)
    theirs = sorted(([_plain(x) for x in r] for r in con.sql(f"select {', '.join(columns)} from ({sql})").fetchall()), key=repr)
    return [r for r in ours if r not in theirs][:3], [r for r in theirs if r not in ours][:3], len(ours) - len(theirs)
