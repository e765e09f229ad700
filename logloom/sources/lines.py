"""Text log files as lines with a total arrival order."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logloom.operators.joins import fits_broadcast
from logloom.session import local_table, stage


def file_name() -> Column:
    """Name of the file a line comes from; Spark gives it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("source_file")


# Spark spells local paths with one or three slashes, depending on the place.
_LOCAL = "^file:/+"


def _plain(path: str) -> str:
    return re.sub(_LOCAL, "file:/", path)


def scanned(lines: DataFrame, *more: Column) -> DataFrame:
    """What numbering needs of a text scan: value, source_file, and where each line stands."""
    return lines.select(
        "value", F.regexp_replace("_metadata.file_path", _LOCAL, "file:/").alias("_path"), file_name(),
        F.col("_metadata.file_block_start").alias("_start"), *more)


def numbered(lines: DataFrame, order: list[str], ranks: DataFrame | None = None, first: int = 0) -> DataFrame:
    """Lines of a scan (value, source_file, line_seq), numbered ``first, first + 1, ...`` in arrival order.

    A first pass counts the lines of each file block; the running sum of these counts,
    one row a block of some hundred MB, tells where each block begins. Inside a block the
    scan's own row number counts on. Nothing but the counts is shuffled, and numbers end
    where the lines do. ``order`` names columns that order the files; ``ranks`` gives
    them by ``_path``, and files that it does not name are left out.
    """
    rows = lines.withColumn("_row", F.monotonically_increasing_id())
    known = [c for c in order if c in lines.columns]
    blocks = rows.groupBy("_path", "_start", *known).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_least"))
    if ranks is not None:
        blocks = blocks.join(ranks, "_path")
    before = F.sum("_n").over(Window.orderBy(*order, "_start")) - F.col("_n")
    blocks = stage(blocks.select("_path", "_start", (F.lit(first) + before - F.col("_least")).alias("_shift")), "blocks")
    if fits_broadcast(blocks):
        blocks = F.broadcast(blocks)
    return rows.join(blocks, ["_path", "_start"]).select("value", "source_file", (F.col("_row") + F.col("_shift")).alias("line_seq"))


def read_lines(spark: SparkSession, paths: list[str], first: int = 0) -> DataFrame:
    """Lines of the files in the given order (value, source_file, line_seq), numbered from ``first``.

    A directory or glob contributes its files in name order, a file named twice counts at
    its first place. A file that vanishes while it is read is an error. Bytes that are no
    UTF-8 are dropped by the parser.
    """
    if not paths:
        return local_table(spark, [], "value string, source_file string, line_seq bigint")
    # The listing that Spark itself keeps on the driver; it meets the blocks, never the lines.
    listed = list(dict.fromkeys(_plain(f) for path in paths for f in sorted(spark.read.text(path).inputFiles())))
    ranks = local_table(spark, [(f, i) for i, f in enumerate(listed)], "_path string, _rank bigint")
    return numbered(scanned(spark.read.text(list(dict.fromkeys(paths)))), ["_rank"], ranks, first)


def read_ordered_files(spark: SparkSession, directory: str, names: list[str]) -> DataFrame:
    """Lines of named files of a directory in list order, leaving out those that do not exist when it is listed."""
    present = {}
    for found in spark.read.option("pathGlobFilter", "*").text(directory).inputFiles():
        path = unquote(found)
        present[path.rsplit("/", 1)[-1]] = path
    return read_lines(spark, [present[n] for n in names if n in present])
