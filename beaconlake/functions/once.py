"""Columns that are worked out once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row, however many filters and columns above read them: Spark copies a
    projected expression to wherever it is used, pattern matching and all, but not what a generator makes."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
