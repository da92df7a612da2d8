"""Edit distance in code points, over Arrow batches: a bit-parallel column step on whole-number bit sets of any length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def distance(a: str, b: str, most: int | None = None) -> int:
    """Insertions, deletions and replacements between two texts; ``most + 1`` as soon as there must be more than ``most``.

    What both begin and end with costs nothing and is left out. The longer text's positions are the bits of one number, and each
    character of the shorter moves the differences between neighbouring cells of the table on by a few operations on such numbers.
    """
    n = _shared(a, b)
    a, b = a[n:], b[n:]
    n = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if len(a) < len(b):
        a, b = b, a
    out = len(a)
    if most is not None and len(a) - len(b) > most:
        return most + 1
    if b and a:
        where: dict[str, int] = {}
        for i, c in enumerate(a):
            where[c] = where.get(c, 0) | 1 << i
        every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
        up, down = every, 0  # cells that are one more, or one less, than the cell above
        for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
            same = where.get(c, 0)
            flat = (((same & up) + up) ^ up) | same | down
            more = down | (every & ~(flat | up))
            less = up & flat
            out += bool(more & last) - bool(less & last)
            if most is not None and out - left > most:
                return most + 1
            more, less = (more << 1 | 1) & every, (less << 1) & every
            fixed = same | down
            up, down = less | (every & ~(fixed | more)), more & fixed
    return out if most is None else min(out, most + 1)


def edit_distance(a: Column, b: Column) -> Column:
    """The distance of two text columns; null if one is null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else distance(p, q) for p, q in zip(x, y, strict=True)], dtype="Int64")

    return F.pandas_udf(run, "long")(a, b)


def similarity(a: Column, b: Column, least: float | None = None) -> Column:
    """1 minus the distance over the longer length; 1 for two empty texts.

    With ``least`` the search stops once a text can't be as similar as that, and the value is null.
    """

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            n = 0 if p is None or q is None else max(len(p), len(q))
            if p is None or q is None:
                out.append(None)
            elif least is None:
                out.append(1 - distance(p, q) / n if n else 1.0)
            else:
                value = 1 - distance(p, q, int(n * (1 - least)) + 1) / n if n else 1.0
                out.append(value if value >= least else None)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")(a, b)
