"""Comparing a query's rows with those of its SQL."""

import math

import numpy as np


def plain(v):
    """A value in a form that both engines share."""
    if hasattr(v, "item"):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return format(float(v), ".9g")
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(duck, text):
    rel = duck.sql(text)
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    return names, sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
