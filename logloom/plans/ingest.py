"""Ingesting a batch of lines: the same answer as one line after the other, as set operations.

A line is *known* when a hand-written pattern matches it, when its template is in
the catalog, or when it is not the first line of its template in arrival order.
So the arrival order matters only through the first line of each template, which
one aggregate finds.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from logloom.functions.text import wall_time
from logloom.functions.regexes import Pattern
from logloom.functions.syslog import parse_lines
from logloom.functions.templates import template_of
from logloom.operators.alerts import new_alerts
from logloom.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, attach, max_id, measure
from logloom.operators.matching import manual_patterns, match_id
from logloom.operators.numbering import number_rows
from logloom.operators.params import explode_params, params_of
from logloom.operators.rules import apply_verdict, judge
from logloom.operators.summaries import summarize
from logloom.schemas import CATALOG, LOGS
from logloom.session import local_table, stage


@dataclass(frozen=True)
class Batch:
    """An ingested batch. ``rows`` are the log rows (T2) with their parameter map.

    Everything else follows from ``rows`` and ``templates``; a job that keeps the
    result writes ``rows`` first and derives the rest from what was written
    (:meth:`over`), so the lines are read and parsed only once for all outputs.
    """

    rows: DataFrame
    templates: DataFrame
    catalog_before: DataFrame
    as_of: dt.datetime

    def over(self, rows: DataFrame) -> "Batch":
        return Batch(rows, self.templates, self.catalog_before, self.as_of)

    @property
    def logs(self) -> DataFrame:
        return self.rows.select(*LOGS.fieldNames())

    @property
    def params(self) -> DataFrame:
        return explode_params(self.rows)

    def alerts(self, last_alert_id: int = 0) -> DataFrame:
        return new_alerts(self.rows, self.as_of, last_alert_id)

    @property
    def catalog(self) -> DataFrame:
        return catalog_after(self.catalog_before, self.templates, self.rows, self.as_of)

    @property
    def stats(self) -> DataFrame:
        return ingest_stats(self.rows)

    @property
    def summary(self) -> DataFrame:
        """Counts of the batch's log rows, to be merged with those of other batches."""
        return summarize(self.rows)


def abstract_lines(
    lines: DataFrame, patterns: list[Pattern], as_of: dt.datetime, default_year: int
) -> DataFrame:
    """Parse lines, match the hand-written patterns, and give the rest a template.

    An empty message has no template: it is stored, unknown, without a pattern.
    """
    return (
        parse_lines(lines, default_year, as_of)
        .withColumn("manual_id", match_id(F.col("message"), patterns))
        .withColumn(
            "template",
            F.when(F.col("manual_id").isNull() & (F.col("message") != ""), template_of(F.col("message"))),
        )
    )


def count_templates(abstracted: DataFrame) -> DataFrame:
    """Lines and first line per template. Fixed-size buffers, so it aggregates before the shuffle.

    Lines without a template form one group, recognised by its missing first line. A
    filter on the template itself would be pushed below the parsing and make every
    line pay for it twice.
    """
    with_template = F.when(F.col("template").isNotNull(), F.col("line_seq"))
    return (
        abstracted.groupBy("template")
        .agg(F.count("*").alias("n"), F.min(with_template).alias("first_seq"))
        .where("first_seq is not null")
    )


def resolve_templates(counted: DataFrame, catalog: DataFrame, at_most: int | None = None) -> DataFrame:
    """Give each template its catalog row, or the next id in order of first appearance.

    The catalog is looked up under both its text columns. ``at_most`` is the number
    of templates, where it is known.
    """
    # A text found in both columns counts for its lowest id.
    entries = catalog.groupBy(F.coalesce("regex_rule", "manual_regex_rule").alias("template")).agg(
        F.min(F.struct(F.col("pattern_id").alias("template_id"), "label", "severity")).alias("entry")
    ).select("template", "entry.*")
    found = counted.join(entries, "template", "left")
    fresh = number_rows(found.where("template_id is null").drop("template_id"), "first_seq",
                        max_id(catalog, "pattern_id"), "template_id", at_most)
    return (
        found.where("template_id is not null").withColumn("is_new", F.lit(False))
        .unionByName(
            fresh.withColumn("label", F.lit("normal")).withColumn("is_new", F.lit(True))
        )
    )


def classify(known, label):
    """Base classification: an unknown line stays unknown; a known one follows its label."""
    return (
        F.when(~known, F.lit("unknown"))
        .when(label == "unknown", F.lit("normal"))
        .otherwise(label)
    )


def ingest_batch(
    lines: DataFrame,
    catalog: DataFrame,
    rules: DataFrame,
    *,
    as_of: dt.datetime,
    default_year: int,
    first_log_id: int = 1,
    policy: str = "first",
    honor_is_abnormal: bool = False,
) -> Batch:
    """Ingest lines (value, source_file, line_seq); ``line_seq`` is unique and in arrival order.

    The template counts are staged before the lines are read a second time: they
    are far fewer than the lines, and their measured size decides how they are
    joined back.
    """
    spark = lines.sparkSession
    patterns = manual_patterns(catalog)
    abstracted = abstract_lines(lines, patterns, as_of, default_year)
    counted = stage(count_templates(abstracted), "template-counts")
    rows, size = measure(counted)
    templates = stage(resolve_templates(counted, catalog, rows), "templates")

    mapping = templates.select(
        "template", "template_id", "label", "severity", "n",
        F.when(F.col("is_new"), F.col("first_seq")).alias("new_seq"),
    )
    manual_labels = local_table(
        spark, [(p.pattern_id, p.label, p.severity) for p in patterns],
        "manual_id bigint, manual_label string, manual_severity string",
    )
    # As many rows as there are hand-written patterns, which every task holds anyway.
    if len(patterns) <= BROADCAST_ROWS:
        manual_labels = F.broadcast(manual_labels)
    by_hand = F.col("manual_id").isNotNull()
    is_new = F.coalesce(F.col("new_seq") == F.col("line_seq"), F.lit(False))
    now = wall_time(as_of)
    known = (
        attach(abstracted, mapping, "template", F.col("line_seq"), uses="n",
               fits=rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES)
        .join(manual_labels, "manual_id", "left")
        .withColumn("pattern_id", F.coalesce("manual_id", "template_id"))
        .withColumn("is_known", F.col("pattern_id").isNotNull() & ~is_new)
        .withColumn("label", F.when(by_hand, F.col("manual_label")).otherwise(F.col("label")))
        .withColumn("severity", F.when(F.col("is_known"), F.when(
            by_hand, F.col("manual_severity")).otherwise(F.col("severity"))))
        .withColumn("classification", classify(F.col("is_known"), F.col("label")))
        .withColumn("params", params_of(F.col("message"), F.when(F.col("is_known"), F.col("pattern_id")), patterns))
    )
    judged = judge(known, rules, policy, honor_is_abnormal).withColumn(
        "verdict", F.when(F.col("is_known"), F.col("verdict"))
    )
    rows = apply_verdict(judged.withColumn("anomaly_reason", F.lit(None).cast("string"))).select(
        (F.lit(first_log_id) + F.col("line_seq")).cast("bigint").alias("log_id"),
        "ts", "host", "component", "raw_line", "message", "pattern_id", "is_known",
        F.lit(False).alias("is_manual_mapped"), "classification", "severity", "anomaly_reason",
        "source_file", "line_seq", now.alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"), "params",
    )
    return Batch(rows, templates, catalog, as_of)


def catalog_after(catalog: DataFrame, templates: DataFrame, rows: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The next catalog: counts of the templates found again, and the new templates.

    The sample of a new template is its first line, the only unknown line that has
    a pattern. A match by hand changes no count.
    """
    now = wall_time(as_of)
    again = templates.where("not is_new").select(F.col("template_id").alias("pattern_id"), "n")
    hit = F.col("n").isNotNull()
    kept = catalog.join(again, "pattern_id", "left").withColumns({
        "total_count": F.col("total_count") + F.coalesce("n", F.lit(0)),
        "last_seen_at": F.when(hit, now).otherwise(F.col("last_seen_at")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }).select(*CATALOG.fieldNames())
    samples = rows.where("not is_known and pattern_id is not null").select(
        "pattern_id", F.col("message").alias("sample_message"))
    none = F.lit(None)
    fresh = (
        templates.where("is_new")
        .select(F.col("template_id").alias("pattern_id"), F.col("template").alias("regex_rule"), F.col("n").alias("total_count"))
        .join(samples, "pattern_id")
        .withColumns({
            "manual_regex_rule": none.cast("string"), "label": F.lit("normal"), "severity": none.cast("string"),
            "note": none.cast("string"), "component": none.cast("string"), "has_params": F.lit(False),
            "first_seen_at": now, "last_seen_at": now, "updated_at": none.cast("timestamp_ntz"),
        })
        .select(*CATALOG.fieldNames())
    )
    return kept.unionByName(fresh)


def ingest_stats(rows: DataFrame) -> DataFrame:
    """One row: total, parsed, new and existing patterns, errors."""
    has_pattern = F.col("pattern_id").isNotNull()
    return rows.agg(
        F.count("*").alias("total_lines"),
        F.count("*").alias("parsed_lines"),
        F.count_if(has_pattern & ~F.col("is_known")).alias("new_patterns"),
        F.count_if(has_pattern & F.col("is_known")).alias("existing_patterns"),
        F.lit(0).cast("bigint").alias("errors"),
    )
