"""Rows of small results."""

from __future__ import annotations


def ids(df, *columns):
    """Rows as a sorted list of tuples (or values for one column)."""
    columns = columns or ("HMDAIndex_s", "HMDAIndex_p")
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    return [r[0] for r in rows] if len(columns) == 1 else rows
