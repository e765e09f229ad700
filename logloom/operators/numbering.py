"""Dense numbering without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

_BLOCK_BITS = 20


def number_rows(df: DataFrame, key: str, start, name: str, at_most: int | None = None) -> DataFrame:
    """Number rows ``start+1, start+2, ...`` in the order of a unique, non-negative bigint key.

    The key's bits cut the rows into blocks of at most 2^20 keys, so no block can
    grow with the data or with skew. Rows are ranked inside their block; block
    counts are summed up inside regions of 2^20 blocks; only one row per region
    meets in the last running sum. When the caller knows that there are ``at_most``
    as many rows as a block may have, they are one block.
    """
    start = F.lit(start) if isinstance(start, int) else start
    if at_most is not None and at_most <= 1 << _BLOCK_BITS:
        rank = F.row_number().over(Window.orderBy(key))
        return df.withColumn(name, (start + rank).cast("bigint"))
    # The explicit filter and the null-safe join keep both uses of the counts one and
    # the same plan, so the exchange behind them runs once.
    blocks = df.withColumn("_block", F.shiftright(key, _BLOCK_BITS)).where("_block is not null")
    counts = (
        blocks.groupBy("_block").agg(F.count("*").alias("_n"))
        .withColumn("_region", F.shiftright("_block", _BLOCK_BITS))
    )
    regions = counts.groupBy("_region").agg(F.sum("_n").alias("_rn"))
    before_region = regions.select(
        F.col("_region").alias("_of"), (F.sum("_rn").over(Window.orderBy("_region")) - F.col("_rn")).alias("_region_start")
    )
    in_region = Window.partitionBy("_region").orderBy("_block")
    before_block = (
        counts.withColumn("_block_start", F.sum("_n").over(in_region) - F.col("_n"))
        .join(before_region, F.col("_region").eqNullSafe(F.col("_of")))
        .select("_block", (F.col("_region_start") + F.col("_block_start")).alias("_start"))
    )
    in_block = Window.partitionBy("_block").orderBy(key)
    return (
        blocks.withColumn("_rank", F.row_number().over(in_block))
        .join(before_block, "_block")
        .withColumn(name, (start + F.col("_start") + F.col("_rank")).cast("bigint"))
        .drop("_block", "_rank", "_start")
    )
