"""Comparing rows of Spark and DuckDB, whatever their order."""

from __future__ import annotations

import decimal


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def same_rows(frame, con, sql: str) -> None:
    """Equal column names and rows."""
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in frame.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    assert ours == theirs
