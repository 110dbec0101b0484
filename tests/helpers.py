"""Comparison of a query with its SQL."""

import math

DATA = "/root/testdata/sf0.001"


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value + 0.0 if isinstance(value, float) else value


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == expected
