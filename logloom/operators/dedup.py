"""Exact deduplication of raw lines with counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logloom.functions.text import drop_bad_bytes, strip
from logloom.schemas import UNIQUE_LINES


def unique_lines(lines: DataFrame) -> DataFrame:
    """Distinct non-blank lines: count, first and last file and time.

    ``lines``: value, source_file, line_seq, seen_at. Only line ends are cut from
    a line, other white space counts.
    """
    raw = F.rtrim(drop_bad_bytes(F.col("value")), F.lit("\r\n"))
    counted = (
        lines.select(raw.alias("raw_line"), "source_file", "line_seq", "seen_at")
        .where(strip(F.col("raw_line")) != "")
        # A first step per file leaves one row per line and file; a line that fills
        # a third of the data is counted where it is read.
        .groupBy("raw_line", "source_file")
        .agg(F.count("*").alias("count"), F.min("line_seq").alias("first_seq"), F.max("line_seq").alias("last_seq"),
             F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))
    )
    return counted.groupBy("raw_line").agg(
        F.sum("count").alias("count"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.min_by("source_file", "first_seq").alias("first_seen_file"),
        F.max_by("source_file", "last_seq").alias("last_seen_file"),
    ).select(*UNIQUE_LINES.fieldNames())


def merge_unique(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Add a later run to the stored lines: counts add up, the first sighting stays, the last moves."""
    both = previous.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)))
    return both.groupBy("raw_line").agg(
        F.sum("count").alias("count"),
        F.min_by("first_seen_at", "_run").alias("first_seen_at"),
        F.max_by("last_seen_at", "_run").alias("last_seen_at"),
        F.min_by("first_seen_file", "_run").alias("first_seen_file"),
        F.max_by("last_seen_file", "_run").alias("last_seen_file"),
    ).select(*UNIQUE_LINES.fieldNames())


def unique_totals(unique: DataFrame) -> DataFrame:
    """Number of distinct lines and of all lines."""
    return unique.agg(F.count("*").alias("total"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_count"))
