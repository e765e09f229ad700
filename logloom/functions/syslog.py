"""Syslog line parsing as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.text import DIGIT, NON_SPACE, SPACE, WORD, drop_bad_bytes, strip, wall_time

# Month abbreviations of the syslog date.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Fixed format: "<Mon> <day> <HH:MM:SS> <host> <component>: " before the message.
HEADER = (
    f"^{WORD}{{3}}{SPACE}+{DIGIT}{{1,2}}{SPACE}+{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}"
    f"{SPACE}+{NON_SPACE}+{SPACE}+{NON_SPACE}+?:{SPACE}+"
)


def header(line: Column) -> Column:
    """The part of a stripped line before the message, ``''`` when it is not syslog."""
    return F.regexp_extract(line, HEADER, 0)


def syslog_time(month: Column, day: Column, clock: Column, year: Column | int) -> Column:
    """Timestamp of a syslog date; NULL for dates and times that do not exist."""
    year = F.lit(year) if isinstance(year, int) else year
    month_no = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month).cast("int")
    hms = F.split(clock, ":")
    second = hms[2].try_cast("int")
    # Second 60 would be carried into the next minute; it counts as no time.
    return F.when(
        second < 60,
        F.try_make_timestamp_ntz(
            year, F.nullif(month_no, F.lit(0)), day.try_cast("int"),
            hms[0].try_cast("int"), hms[1].try_cast("int"), second.cast("decimal(16,6)"),
        ),
    )


def parse_lines(lines: DataFrame, default_year: int, ingest_ts: dt.datetime) -> DataFrame:
    """Split ``value`` into ts, host, component, message and raw_line.

    One regex finds the header; its fields are cut from that short text. Lines
    without a header keep their whole text as message. ``parse_ok`` tells them
    apart; a missing or impossible date becomes ``ingest_ts``.
    """
    now = wall_time(ingest_ts)
    return (
        lines.withColumn("raw_line", strip(drop_bad_bytes(F.col("value"))))
        .withColumn("_head", header(F.col("raw_line")))
        .withColumn("parse_ok", F.col("_head") != "")
        .withColumn("_part", F.split("_head", f"{SPACE}+"))
        .withColumn(
            "ts",
            F.when(F.col("parse_ok"), F.coalesce(
                syslog_time(F.col("_part")[0], F.col("_part")[1], F.col("_part")[2], default_year), now,
            )).otherwise(now),
        )
        .withColumn("host", F.when(F.col("parse_ok"), F.col("_part")[3]))
        .withColumn(
            "component",
            F.when(F.col("parse_ok"), F.expr("left(_part[4], length(_part[4]) - 1)")),
        )
        .withColumn("message", F.expr("substring(raw_line, length(_head) + 1)"))
        .drop("_head", "_part", "value")
    )
