"""Running sums over an order that one task could not hold: by ranges of the order, then inside each range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.arrow_text import free_name, quoted
from logloom.session import stage


def running(df: DataFrame, by: list[str], order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """``df`` and, for every name of ``amounts``, ``<name>_before``, its sum over earlier rows of the same ``by``, and ``<name>_total``, over all of them.

    Rows are dealt out by ranges of (by, order), so a group with a third of all rows lies in
    as many tasks as its size asks for; sums per range, a row for each range and group,
    join the ranges up. Rows that ``order`` can't tell apart follow each other in any order, and a
    number of their own keeps a long row of ties from meeting in one range. Null is a group like any
    other; an empty table gives an empty table. ``df`` is read twice, first for the ranges' bounds.
    """
    made = [f"{name}_{what}" for name in amounts for what in ("before", "total")]
    taken = [*df.columns, *made]
    part, row = free_name("part", taken), free_name("row", taken)
    own = {name: free_name(f"{name}_own", taken) for name in amounts}
    keys = [quoted(c) for c in by]
    numbered = df.select("*", F.monotonically_increasing_id().alias(row), *[c.alias(own[name]) for name, c in amounts.items()])
    dealt = stage(numbered.repartitionByRange(*keys, *order, F.col(row)).withColumn(part, F.spark_partition_id()), "ranges")
    # One row a range and group, so these windows hold no more rows than there are ranges.
    sums = dealt.groupBy(part, *keys).agg(*[F.sum(o).alias(o) for o in own.values()])
    ranges, met = Window.partitionBy(*keys), {}
    for name in (part, *by):
        met[name] = free_name("met", [*taken, part, row, *own.values(), *met.values()])
    sums = sums.select(*[quoted(c).alias(n) for c, n in met.items()], *[c for name, o in own.items() for c in (
        (F.sum(o).over(ranges.orderBy(part)) - F.col(o)).alias(f"{name}_before"), F.sum(o).over(ranges).alias(f"{name}_total"))])
    inside = Window.partitionBy(part, *keys).orderBy(*order, row).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(sums, reduce(Column.__and__, [quoted(c).eqNullSafe(F.col(n)) for c, n in met.items()]))
    return joined.select(*[quoted(c) for c in df.columns], *[c for name, o in own.items() for c in (
        (F.col(f"{name}_before") + F.sum(o).over(inside) - F.col(o)).alias(f"{name}_before"), F.col(f"{name}_total"))])
