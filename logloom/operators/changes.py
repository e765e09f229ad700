"""Change sets: what acts on stored rows, one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def last_per_key(changes: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The change that acts last on each key, as the last statement wins.

    Changes act in the order of the column ``order`` where the set has one; without it,
    or where it ties or is NULL, the greatest row counts, so the outcome is the same on
    every run. Rows without a key name nothing and go.
    """
    others = [c for c in changes.columns if c != key]
    row = F.struct(*others)
    place = F.struct(F.col(order), row) if order in others else row
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, place).alias("_last"))
    return last.select(*[F.col(key) if c == key else F.col("_last")[c].alias(c) for c in changes.columns])


def first_per_key(changes: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The same for changes of which the first counts."""
    others = [c for c in changes.columns if c != key]
    row = F.struct(*others)
    place = F.struct(F.col(order), row) if order in others else row
    first = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, place).alias("_first"))
    return first.select(*[F.col(key) if c == key else F.col("_first")[c].alias(c) for c in changes.columns])
