"""Known or new, decided by the state of the templates that a micro-batch names.

The stream of lines is grouped by template; Spark's state store keeps first place,
last place and count of each, updates those of the templates at hand and hands out
just them. Nothing of the history is read: not the catalog, not the logs. Lines combine
before the shuffle, so a template with a third of all lines is one row a task.

An epoch writes ``seen/epoch=N`` (a row for each template it met) and
``marks/epoch=N`` (one row: the last place and the last id given), both overwritten
when the epoch is tried again. A line is new exactly if it stands at the first place of a new
template, so the flags of an epoch's lines need no more than the new templates of that epoch.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.regexes import Pattern
from logloom.operators.joins import attach
from logloom.operators.numbering import number_rows
from logloom.plans.ingest import abstract_lines
from logloom.schemas import schema_of

SEEN = schema_of("template string, first_seq bigint, last_seq bigint, n bigint, sample_message string, template_id bigint")
MARKS = schema_of("last_seq bigint, last_id bigint")
LINES = schema_of("line_seq bigint, source_file string, message string, manual_id bigint, template string")


def sightings(lines: DataFrame, patterns: list[Pattern], as_of: dt.datetime, default_year: int) -> DataFrame:
    """template, first_seq, last_seq, n, sample_message of a stream of lines (value, source_file, line_seq); updated templates only.

    ``line_seq`` ascends over the whole stream, as offsets of a queue do.
    """
    abstracted = abstract_lines(lines, patterns, as_of, default_year)
    return abstracted.where("template is not null").groupBy("template").agg(
        F.min("line_seq").alias("first_seq"), F.max("line_seq").alias("last_seq"), F.count("*").alias("n"),
        F.min_by("message", "line_seq").alias("sample_message"))


def stream_sightings(lines: DataFrame, patterns: list[Pattern], root: str, checkpoint: str, *, as_of: dt.datetime, default_year: int,
                     known: DataFrame | None = None, last_id: int = 0, trigger: dict | None = None) -> StreamingQuery:
    """Keep ``root/seen`` up to date with a stream of lines.

    New templates get the ids after ``last_id`` in the order of their first lines. ``known``
    (template, template_id) are the texts of a catalog from before the stream; they are never new.
    """
    spark = lines.sparkSession

    def decide(met: DataFrame, epoch: int) -> None:
        before = (0, last_id) if epoch == 0 else spark.read.schema(MARKS).parquet(f"{root}/marks/epoch={epoch - 1}").first()
        later = F.col("first_seq") > F.lit(before[0]) if epoch else F.lit(True)
        met = met.persist()
        try:
            fresh = met.where(later)
            if known is not None:
                fresh = fresh.join(known.select("template"), "template", "left_anti")
            ids = number_rows(fresh.select("template", "first_seq"), "first_seq", before[1], "template_id")
            met.join(ids.select("template", "template_id"), "template", "left").select(*SEEN.fieldNames()) \
                .write.mode("overwrite").parquet(f"{root}/seen/epoch={epoch}")
            written = spark.read.schema(SEEN).parquet(f"{root}/seen/epoch={epoch}")
            written.agg(F.greatest(F.max("last_seq"), F.lit(before[0])).alias("last_seq"), F.greatest(F.max("template_id"), F.lit(before[1])).alias("last_id")) \
                .coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/epoch={epoch}")
        finally:
            met.unpersist()

    query = sightings(lines, patterns, as_of, default_year).writeStream.outputMode("update").foreachBatch(decide).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def stream_lines(lines: DataFrame, patterns: list[Pattern], root: str, checkpoint: str, *, as_of: dt.datetime, default_year: int,
                 trigger: dict | None = None) -> StreamingQuery:
    """Write the parsed lines of a stream to ``root/lines``, each once; nothing is looked up."""
    parsed = abstract_lines(lines, patterns, as_of, default_year).select(*LINES.fieldNames())
    query = parsed.writeStream.format("parquet").option("path", f"{root}/lines").option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def templates(spark: SparkSession, root: str) -> DataFrame:
    """New templates of all epochs: template, template_id, first_seq, sample_message, and ``n``, their lines up to the last epoch."""
    seen = spark.read.schema(SEEN).parquet(f"{root}/seen")
    return seen.groupBy("template").agg(F.max("template_id").alias("template_id"), F.min("first_seq").alias("first_seq"), F.max("n").alias("n"),
                                        F.min_by("sample_message", "first_seq").alias("sample_message")).where("template_id is not null")


def flagged(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """Stored lines with ``is_known`` and ``pattern_id``, as one ingest after the other gives them.

    A line is unknown if it is the first of a new template, or has neither template nor pattern.
    """
    lines = spark.read.schema(LINES).parquet(f"{root}/lines")
    ids = templates(spark, root).select("template", "template_id", "first_seq", "n")
    if known is not None:
        ids = ids.unionByName(known.select("template", "template_id").withColumns({"first_seq": F.lit(None).cast("bigint"), "n": F.lit(1).cast("bigint")}))
    met = attach(lines, ids, "template", F.col("line_seq"), uses="n")
    pattern = F.coalesce("manual_id", "template_id")
    first = F.coalesce(F.col("first_seq") == F.col("line_seq"), F.lit(False))
    return met.select("line_seq", "source_file", "message", pattern.alias("pattern_id"), (pattern.isNotNull() & ~first).alias("is_known"))
