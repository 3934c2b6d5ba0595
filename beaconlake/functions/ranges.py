"""Ranges of an order that hold a bounded number of rows each."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: About how many rows a range holds at most.
ROWS = 1_000_000


def place(order: str, ends: list[int]) -> Column:
    """The number of the range that a row is in, from 0: how many of ``ends`` are not above its order."""
    return reduce(add, [(F.col(order) >= end).cast("int") for end in ends], F.lit(0))


def cuts(rows: DataFrame, *ends: int, order: str = "seq", most: int = ROWS) -> list[int]:
    """Numbers of order before which ranges end: ``ends``, and others so that no range has many more than ``most`` rows."""
    found = sorted(set(ends))
    part = place(order, found).alias("part_")
    ranges = {r.part_: -(-r.n // most) for r in rows.where(F.col(order).isNotNull()).groupBy(part).agg(F.count("*").alias("n")).collect()}
    large = {p: n for p, n in ranges.items() if n > 1}
    if large:
        shares = sorted({i / n for n in large.values() for i in range(1, n)})
        for r in rows.select(order, part).where(F.col("part_").isin(list(large))).groupBy("part_").agg(F.percentile_approx(order, shares, 100_000).alias("at")).collect():
            at = dict(zip(shares, r["at"], strict=True))
            found += [int(at[i / large[r.part_]]) for i in range(1, large[r.part_])]
    return sorted(set(found))
