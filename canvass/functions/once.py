"""Evaluate costly columns a single time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(values: dict[str, Column], build) -> Column:
    """``build(v)`` over named intermediate values that are computed a single time.

    Unlike ``with_once`` this is an ordinary expression, pruned when nobody reads it.
    """
    packed = F.struct(*[c.alias(n) for n, c in values.items()])
    return F.get(F.transform(F.array(packed), build), F.lit(0))


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a generator, so that later filters and projections reuse
    their values; a plain projection would be inlined into every place that reads it.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))
