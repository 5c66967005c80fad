"""Compares a query with its SQL: column names and rows without order, numbers to six digits."""

import math
from decimal import Decimal


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(df, relation) -> None:
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    want = sorted(repr([plain(r[k]) for k in at]) for r in relation.fetchall())
    assert got == want
