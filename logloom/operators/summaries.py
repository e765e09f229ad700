"""Counts of log rows that add up: reports that only count read these instead of the logs.

A summary has one row for every hour, host, component, pattern, known flag and class that
occur together, and ``lines``, the number of log rows it stands for. The counts have a
sign, so summaries of batches add up, and an edit is the summary of the rows as they
are now less that of the same rows as they were; neither reads any other row.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.text import wall_time
from logloom.schemas import schema_of

SUMMARY = schema_of(
    "hour timestamp_ntz, host string, component string, pattern_id bigint, is_known boolean, classification string, lines bigint")
KEYS = tuple(SUMMARY.fieldNames()[:-1])
HOUR = dt.timedelta(hours=1)


def hour_of(ts: Column) -> Column:
    """The hour of a timestamp without zone, whatever the session's zone."""
    return F.to_timestamp_ntz(F.substring(ts.cast("string"), 1, 13), F.lit("yyyy-MM-dd HH"))


def summarize(logs: DataFrame) -> DataFrame:
    """The summary of log rows: one pass, counted before the shuffle, so hot hosts and patterns weigh one row a task."""
    return logs.select(hour_of(F.col("ts")).alias("hour"), *KEYS[1:]).groupBy(*KEYS).agg(F.count("*").alias("lines"))


def merged(*summaries: DataFrame) -> DataFrame:
    """Summaries added up; combinations that no log row has any more go. Order and grouping of the parts don't matter."""
    both = reduce(DataFrame.unionByName, (s.select(*SUMMARY.fieldNames()) for s in summaries))
    return both.groupBy(*KEYS).agg(F.sum("lines").alias("lines")).where("lines <> 0")


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """What edited log rows add to a summary: the rows as they are, less the same rows as they were."""
    gone = summarize(before).withColumn("lines", -F.col("lines"))
    return merged(gone, summarize(after))


def since(summary: DataFrame, start: dt.datetime, cut_hour: DataFrame | None = None) -> DataFrame:
    """The summary of log rows from ``start`` on.

    Whole hours come from the summary. Where ``start`` lies inside an hour, the rows of that hour are
    counted from the logs given as ``cut_hour``; without them that is an error, not a wrong number.
    """
    first = start.replace(minute=0, second=0, microsecond=0)
    whole = first if first == start else first + HOUR
    later = summary.where(F.col("hour") >= wall_time(whole))
    if whole == start:
        return later
    if cut_hour is None:
        raise ValueError(f"{start} is inside an hour: the logs of that hour are needed")
    part = cut_hour.where((F.col("ts") >= wall_time(start)) & (F.col("ts") < wall_time(whole)))
    return merged(later, summarize(part))


def is_summary(table: DataFrame) -> bool:
    return "lines" in table.columns


def line_count(table: DataFrame, condition: Column | None = None) -> Column:
    """Number of log rows in a group, of those meeting a condition: rows of logs, or what rows of a summary stand for."""
    if not is_summary(table):
        return F.count("*") if condition is None else F.count_if(condition)
    lines = F.col("lines") if condition is None else F.when(condition, F.col("lines"))
    return F.coalesce(F.sum(lines), F.lit(0))
