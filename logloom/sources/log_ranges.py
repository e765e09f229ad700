"""Log rows in folders of equal ranges of log_id, so that an edit writes the ranges it touches and no others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logloom.session import stage

RANGE = "log_range"


@dataclass(frozen=True)
class LogRanges:
    """A parquet table of log rows under ``path``, one folder for ``width`` consecutive log ids.

    Ids are dense and rows of a range are near each other, so folders are of equal size
    whatever the patterns are. One writer at a time.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    width: int = 1 << 20
    row_group_bytes: int = 16 << 20

    def _number(self, log_id: Column) -> Column:
        return F.floor(log_id / F.lit(self.width)).cast("bigint")

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.select(*self.schema.fieldNames()).withColumn(RANGE, self._number(F.col("log_id"))).repartition(RANGE)
        # Ids rise inside a file, so their bounds tell row groups apart; patterns are told by dictionary or Bloom filter.
        dealt.sortWithinPartitions(RANGE, "log_id").write.mode(mode).options(**{
            "partitionOverwriteMode": "dynamic", "parquet.block.size": str(self.row_group_bytes),
            "parquet.bloom.filter.enabled#pattern_id": "true", "parquet.bloom.filter.adaptive.enabled": "true",
        }).partitionBy(RANGE).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """Add a batch; its ids follow those stored, so it shares at most one range with them."""
        self._write(rows, "append")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(RANGE, T.LongType())])).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._stored().drop(RANGE)

    def of_pattern(self, pattern_id: int) -> DataFrame:
        """Rows of one pattern; row groups that don't hold it are not read."""
        return self.rows().where(F.col("pattern_id") == pattern_id)

    def of_logs(self, first: int, last: int) -> DataFrame:
        """Rows of the log ids from ``first`` to ``last``: their folders alone, and of these the row groups they lie in."""
        inside = self._stored().where(F.col(RANGE).between(first // self.width, last // self.width))
        return inside.where(F.col("log_id").between(first, last)).drop(RANGE)

    def ranges_of_logs(self, keys: DataFrame) -> list[int]:
        """Numbers of the ranges that the ``log_id`` of ``keys`` fall into: one number a folder at most."""
        named = keys.where("log_id is not null").select(self._number(F.col("log_id")).alias("r")).distinct()
        return sorted(r["r"] for r in named.collect())

    def ranges_of_patterns(self, keys: DataFrame) -> list[int]:
        """Numbers of the ranges that hold logs of the ``pattern_id`` of ``keys``. Reads that column alone."""
        met = self._stored().select("pattern_id", RANGE).join(keys.select("pattern_id").distinct(), "pattern_id", "left_semi")
        return sorted(r[RANGE] for r in met.select(RANGE).distinct().collect())

    def rewrite(self, ranges: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows of the given ranges by what ``change`` makes of them; it keeps log ids.

        The result is staged first: folders are replaced by rows that no longer depend on them, so
        a lost executor can't find half of its input gone. A range without rows stays as it is.
        """
        if not ranges:
            return
        part = self._stored().where(F.col(RANGE).isin(ranges)).drop(RANGE)
        self._write(stage(change(part), "range-edits"), "overwrite")
