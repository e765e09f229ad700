"""Joins that stay whole and balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
ROWS_PER_SALT = 2_000_000
SALT_LIMIT = 4096


def measure(table: DataFrame) -> tuple[int, int]:
    """Rows of a staged table, and bytes: eight per column and the length of its texts."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in table.dtypes if t == "string"]
    width = sum(text, F.lit(8 * len(table.columns)))
    seen = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return seen["n"], seen["b"]


def fits_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    n, b = measure(small)
    return n <= rows and b <= size


def attach(
    big: DataFrame,
    small: DataFrame,
    key: str,
    spread: Column,
    how: str = "left",
    uses: str | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Join ``big`` with ``small`` (one row per text key), whatever the size of ``small``; the key is dropped.

    A measured small table is broadcast. Beyond that the join shuffles on the key
    and hot keys are split: ``uses`` names the column of ``small`` that holds how
    many rows of ``big`` use the key; a key with more than ``ROWS_PER_SALT`` uses
    is replicated that many times and ``spread`` (a per-row number) deals its rows
    out. The hot list itself has at most total / ROWS_PER_SALT keys.
    """
    if fits_broadcast(small) if fits is None else fits:
        return big.join(F.broadcast(small), key, how).drop(key)
    # Rows without a key must not meet in one partition: each gets a key nothing matches.
    stray = F.concat(F.lit("\ufdd1"), spread.cast("string"))
    big = big.withColumn("_key", F.coalesce(F.col(key), stray)).drop(key)
    small = small.withColumnRenamed(key, "_key")
    key = "_key"
    if uses is None:
        return big.join(small, key, how).drop(key)
    salts = F.least(F.ceil(F.col(uses) / F.lit(ROWS_PER_SALT)), F.lit(SALT_LIMIT)).cast("int")
    sized = small.withColumn("_salts", F.greatest(F.coalesce(salts, F.lit(1)), F.lit(1)))
    hot = sized.where("_salts > 1").select(key, F.col("_salts").alias("_deal"))
    dealt = big.join(hot, key, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_deal")), F.lit(0)).cast("int")
    ).drop("_deal")
    copies = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt", key)


def max_id(table: DataFrame, column: str) -> int:
    """Highest id of a table, 0 when it is empty."""
    return table.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
