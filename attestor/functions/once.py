"""Evaluate an expensive expression once per row.

The optimizer substitutes a column's expression wherever the column is used, in particular into
filters it pushes down, so an expensive regular expression could run several times per row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside one expression."""
    return F.get(F.transform(F.array(value), body), 0)


def add_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns behind a generator of one row, through which nothing is pushed or copied."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(packed)).alias("_once")).select(*df.columns, "_once.*")
