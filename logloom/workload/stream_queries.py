"""Continuous ingest over the lines of the given tables, and tables written and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.operators.joins import max_id
from logloom.operators.matching import manual_patterns
from logloom.session import staging_path
from logloom.sources import exports
from logloom.sources.lines import read_ordered_files
from logloom.streaming import known as streaming
from logloom.workload import oracle_tables as o
from logloom.workload.lines import FIRST_RUN, YEAR, event_lines, order_lines, table
from logloom.workload.registry import query
from logloom.workload.state import seed_catalog, state


def _arrivals(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Event lines, then order lines, with places that go on from one to the other."""
    events = event_lines(spark, sf).withColumn("line_seq", F.col("line_seq") + 1)
    last = events.agg(F.coalesce(F.max("line_seq"), F.lit(0))).first()[0]
    return [events, order_lines(spark, sf).withColumn("line_seq", F.col("line_seq") + last + 1)]


def streamed(spark: SparkSession, sf: str) -> str:
    """Both files through the streams, the second after a restart from the checkpoints; gives the folder of the tables."""
    incoming, root = staging_path(spark, "incoming"), staging_path(spark, "streamed")
    catalog = seed_catalog(spark)
    patterns, last = manual_patterns(catalog), max_id(catalog, "pattern_id")
    for lines in _arrivals(spark, sf):
        lines.write.mode("append").parquet(incoming)
        for run, name, more in ((streaming.stream_sightings, "sightings", {"last_id": last}), (streaming.stream_lines, "lines", {})):
            stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 100_000).parquet(incoming)
            done = run(stream, patterns, root, f"{root}/checkpoints/{name}", as_of=FIRST_RUN, default_year=YEAR, **more)
            done.awaitTermination()
    return root


@query("stream_flags", o.with_ctes(o.state_ctes(), "SELECT log_id, is_known, pattern_id FROM logs"))
def _(spark, sf):
    return streaming.flagged(spark, streamed(spark, sf)).select(F.col("line_seq").alias("log_id"), "is_known", "pattern_id")


@query("stream_templates", o.with_ctes(
    o.state_ctes(), "SELECT pattern_id, regex_rule, sample_message, total_count FROM catalog WHERE regex_rule IS NOT NULL"))
def _(spark, sf):
    found = streaming.templates(spark, streamed(spark, sf))
    return found.select(F.col("template_id").alias("pattern_id"), F.col("template").alias("regex_rule"), "sample_message", F.col("n").alias("total_count"))


# --- sources and sinks: written, read back ---------------------------------------------

@query("ordered_files", """SELECT CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 END AS place, event_id, event_type || '.log' AS source_file
  FROM events WHERE event_type IN ('view', 'click', 'error')""")
def _(spark, sf):
    """A file for each of three kinds of events, read by lists that name files which don't exist."""
    folder = staging_path(spark, "ordered")
    kinds, rows = ("view", "click", "error"), []
    for place, kind in enumerate(kinds, 1):
        events = table(spark, sf, "events").where(F.col("event_type") == kind)
        events.select(F.col("event_id").cast("string")).coalesce(1).write.text(f"{folder}/{kind}.log")
        file = spark.read.text(f"{folder}/{kind}.log").inputFiles()[0].rsplit("/", 1)[1]
        lines = read_ordered_files(spark, f"{folder}/{kind}.log", ["missing.txt", file, "also-missing.txt"])
        rows.append(lines.select(F.lit(place).alias("place"), F.col("value").cast("bigint").alias("event_id"), F.lit(f"{kind}.log").alias("source_file")))
    return reduce(DataFrame.unionByName, rows)


@query("csv_export", o.with_ctes(o.state_ctes(), "SELECT log_id, host, component, nullif(message, '') AS message, classification, severity FROM logs WHERE NOT is_known"))
def _(spark, sf):
    """Unknown logs as CSV with a header, quotes and line breaks kept, read back; there an empty text is no text."""
    rows = state(spark, sf)["logs"].where("not is_known").select("log_id", "host", "component", "message", "classification", "severity")
    path = staging_path(spark, "csv")
    exports.to_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query("appended_rows", o.with_ctes(o.state_ctes(), "SELECT log_id, pattern_id, classification FROM logs"))
def _(spark, sf):
    """Log rows of both batches appended to one table, the second after the first."""
    now, path = state(spark, sf), staging_path(spark, "appended")
    last = now["second_rows"].agg(F.min("log_id")).first()[0]
    for batch in (now["logs"].where(F.col("log_id") < last), now["logs"].where(F.col("log_id") >= last)):
        batch.write.mode("append").parquet(path)
    return spark.read.schema(now["logs"].schema).parquet(path).select("log_id", "pattern_id", "classification")
