"""Curating the template catalog and the logs that follow it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.text import wall_time
from logloom.functions.regexes import has_named_groups, is_valid_regex
from logloom.functions.templates import template_of
from logloom.operators.changes import last_per_key
from logloom.operators.joins import max_id
from logloom.operators.numbering import number_rows
from logloom.schemas import CATALOG, LABELS


@dataclass(frozen=True)
class Additions:
    """Result of adding patterns: next catalog, id per request (``seq``), refused requests."""

    catalog: DataFrame
    assigned: DataFrame
    rejected: DataFrame


def add_patterns(
    catalog: DataFrame, new: DataFrame, as_of: dt.datetime, update_existing: bool = False
) -> Additions:
    """Add hand-written patterns (seq, regex, sample_message, label, severity, component, note).

    A pattern already in either text column keeps its id; with ``update_existing``
    it takes the label, severity and note of the last request for it. Requests act
    in ``seq`` order.
    """
    now = wall_time(as_of)
    reason = (
        F.when(F.col("seq").isNull(), F.lit("seq is required"))
        .when(F.col("regex").isNull() | ~F.coalesce(is_valid_regex("regex"), F.lit(False)), F.lit("invalid regex"))
        .when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), F.lit("invalid label"))
    )
    checked = new.withColumn("reject_reason", reason)
    valid = checked.where("reject_reason is null")
    fields = F.struct("label", "severity", "component", "note", "sample_message")
    keyed = valid.groupBy("regex").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("requests"),
        F.min_by(fields, "seq").alias("first"), F.max_by(fields, "seq").alias("last"),
    )
    # A text may stand in several rows; the lowest id has it.
    entries = catalog.groupBy(F.coalesce("regex_rule", "manual_regex_rule").alias("regex")).agg(F.min("pattern_id").alias("existing_id"))
    looked_up = keyed.join(entries, "regex", "left")
    created = number_rows(looked_up.where("existing_id is null"), "first_seq",
                          max_id(catalog, "pattern_id"), "pattern_id")
    known = looked_up.where("existing_id is not null").withColumn("pattern_id", F.col("existing_id"))
    ids = known.select("regex", "pattern_id").unionByName(created.select("regex", "pattern_id"))

    late = F.lit(update_existing) & (F.col("requests") > 1)
    shown = F.when(late, F.col("last")).otherwise(F.col("first"))
    none = F.lit(None)
    rows = created.select(
        "pattern_id", none.cast("string").alias("regex_rule"), F.col("regex").alias("manual_regex_rule"),
        F.col("first.sample_message").alias("sample_message"), shown["label"].alias("label"),
        shown["severity"].alias("severity"), shown["note"].alias("note"),
        F.col("first.component").alias("component"), has_named_groups(F.col("regex")).alias("has_params"),
        now.alias("first_seen_at"), now.alias("last_seen_at"), F.lit(0).cast("bigint").alias("total_count"),
        F.when(late, now).alias("updated_at"),
    )
    kept = catalog
    if update_existing:
        changes = known.select(
            "pattern_id", F.col("last.label").alias("_label"), F.col("last.severity").alias("_severity"),
            F.col("last.note").alias("_note"), has_named_groups(F.col("regex")).alias("_params"))
        hit = F.col("_label").isNotNull()
        kept = catalog.join(changes, "pattern_id", "left").withColumns({
            "label": F.coalesce("_label", "label"),
            "severity": F.when(hit, F.col("_severity")).otherwise(F.col("severity")),
            "note": F.when(hit, F.col("_note")).otherwise(F.col("note")),
            "has_params": F.coalesce("_params", "has_params"),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }).select(*CATALOG.fieldNames())
    assigned = valid.select("seq", "regex").join(ids, "regex").select("seq", "pattern_id")
    return Additions(kept.unionByName(rows), assigned, checked.where("reject_reason is not null"))


def patterns_from_logs(
    catalog: DataFrame, logs: DataFrame, requests: DataFrame, as_of: dt.datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Learn the template of given logs and map those logs to it.

    ``requests``: log_id, label, severity, note. The template usually is in the
    catalog already and keeps its label; the log takes the requested one, the last
    where it is named twice. Returns (catalog, logs, requests that name no log).
    """
    missing = requests.join(logs.select("log_id"), "log_id", "left_anti")
    requests = last_per_key(requests, "log_id")
    subject = requests.join(logs.select("log_id", "message", F.col("component")), "log_id")
    new = subject.select(
        F.col("log_id").alias("seq"), template_of(F.col("message")).alias("regex"),
        F.col("message").alias("sample_message"), "label", "severity", "component", "note")
    added = add_patterns(catalog, new, as_of)
    mapped = added.assigned.withColumnRenamed("seq", "log_id").join(
        requests.select("log_id", F.col("label").alias("_label"), F.col("severity").alias("_severity")), "log_id"
    ).withColumnRenamed("pattern_id", "_pattern")
    return added.catalog, _mapped(logs, mapped, as_of), missing


def _mapped(logs: DataFrame, mapped: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Logs with (log_id, _pattern, _label, _severity) applied as a mapping by hand."""
    hit = F.col("_pattern").isNotNull()
    return logs.join(mapped, "log_id", "left").withColumns({
        "pattern_id": F.coalesce("_pattern", "pattern_id"),
        "is_known": hit | F.col("is_known"),
        "is_manual_mapped": hit | F.col("is_manual_mapped"),
        "classification": F.when(hit, F.col("_label")).otherwise(F.col("classification")),
        "severity": F.when(hit, F.col("_severity")).otherwise(F.col("severity")),
        "updated_at": F.when(hit, wall_time(as_of)).otherwise(F.col("updated_at")),
    }).select(*logs.columns)


def map_logs(
    logs: DataFrame, catalog: DataFrame, mapping: DataFrame, as_of: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """Map logs to patterns by hand (log_id, pattern_id), the last accepted mapping of a log counts. Returns (logs, refused mappings)."""
    labels = catalog.select(F.col("pattern_id").alias("_pattern"), F.col("label").alias("_label"),
                            F.col("severity").alias("_severity"))
    order = ["seq"] if "seq" in mapping.columns else []
    wanted = mapping.select("log_id", *order, F.col("pattern_id").alias("_pattern")).join(labels, "_pattern", "left")
    logged = logs.select("log_id", F.lit(True).alias("_logged"))
    refused = (
        wanted.join(logged, "log_id", "left")
        .withColumn("reject_reason", F.when(F.col("_label").isNull(), F.lit("pattern not found"))
                    .when(F.col("_logged").isNull(), F.lit("log not found")))
        .where("reject_reason is not null")
        .select("log_id", F.col("_pattern").alias("pattern_id"), "reject_reason")
    )
    return _mapped(logs, last_per_key(wanted.where("_label is not null"), "log_id").drop("seq"), as_of), refused


def relabel(
    catalog: DataFrame, logs: DataFrame, changes: DataFrame, as_of: dt.datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relabel patterns (pattern_id, label, severity, note) and all their logs.

    A pattern keeps its severity or note where none is given; its logs then get a
    NULL severity. A pattern's last change counts. Labels outside the domain change
    nothing and come back as rejected. Returns (catalog, logs, rejected).
    """
    now = wall_time(as_of)
    fine = F.coalesce(F.col("label").isin(*LABELS), F.lit(False))
    good = last_per_key(changes.where(fine), "pattern_id").select(
        "pattern_id", F.col("label").alias("_label"), F.nullif(F.col("severity"), F.lit("")).alias("_given"),
        F.col("severity").alias("_severity"), F.nullif(F.col("note"), F.lit("")).alias("_note"))
    hit = F.col("_label").isNotNull()
    new_catalog = catalog.join(good, "pattern_id", "left").withColumns({
        "label": F.coalesce("_label", "label"),
        "severity": F.coalesce("_given", "severity"),
        "note": F.coalesce("_note", "note"),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }).select(*catalog.columns)
    new_logs = logs.join(good, "pattern_id", "left").withColumns({
        "classification": F.coalesce("_label", "classification"),
        "severity": F.when(hit, F.col("_severity")).otherwise(F.col("severity")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }).select(*logs.columns)
    return new_catalog, new_logs, changes.where(~fine)


def edit_logs(logs: DataFrame, edits: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Set classification and severity of single logs (log_id, classification, severity); a log's last edit counts."""
    new = last_per_key(edits, "log_id").select("log_id", F.col("classification").alias("_class"), F.col("severity").alias("_severity"))
    hit = F.col("_class").isNotNull()
    return logs.join(new, "log_id", "left").withColumns({
        "classification": F.coalesce("_class", "classification"),
        "severity": F.when(hit, F.coalesce("_severity", "severity")).otherwise(F.col("severity")),
        "updated_at": F.when(hit, wall_time(as_of)).otherwise(F.col("updated_at")),
    }).select(*logs.columns)


def backfill_has_params(catalog: DataFrame) -> DataFrame:
    """Recompute ``has_params`` from the pattern text."""
    text = F.coalesce("manual_regex_rule", "regex_rule")
    return catalog.withColumn("has_params", has_named_groups(text))


def integrity(catalog: DataFrame, logs: DataFrame, params: DataFrame, rules: DataFrame,
              alerts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Violations per check: exactly one pattern text, unique keys, no orphans.

    Every table is read once and gives (domain, key, tag); one grouping by domain and key
    counts each tag, so a key used by many rows costs one row a task. A key used without
    a row that owns it is an orphan, as often as it is used; a key owned twice is a duplicate.
    """
    def tagged(table: DataFrame, *tags: tuple[str, str, Column]) -> DataFrame:
        entries = [F.struct(F.lit(domain).alias("domain"), key.cast("string").alias("key"), F.lit(tag).alias("tag")) for domain, tag, key in tags]
        return table.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("key is not null")

    both_or_none = F.when(F.col("regex_rule").isNull() == F.col("manual_regex_rule").isNull(), F.lit(""))
    every = reduce(DataFrame.unionByName, [
        tagged(catalog, ("pattern", "owner", F.col("pattern_id")), ("row", "one_pattern_text", both_or_none),
               ("regex_rule", "owner", F.col("regex_rule")), ("manual_regex_rule", "owner", F.col("manual_regex_rule"))),
        tagged(logs, ("pattern", "log_pattern", F.col("pattern_id")), ("log", "owner", F.col("log_id"))),
        tagged(rules, ("pattern", "rule_pattern", F.col("pattern_id"))),
        tagged(params, ("log", "param_log", F.col("log_id"))),
        tagged(alerts, ("log", "alert_log", F.col("log_id"))),
        tagged(analyses, ("log", "analysis_log", F.col("log_id"))),
    ])
    orphans = ("log_pattern", "rule_pattern", "param_log", "alert_log", "analysis_log")
    counted = every.groupBy("domain", "key").agg(*[F.count_if(F.col("tag") == t).alias(t) for t in ("owner", "one_pattern_text", *orphans)])
    alone = F.col("owner") == 0
    totals = {
        "one_pattern_text": F.sum("one_pattern_text"),
        **{f"unique_{c}": F.count_if((F.col("domain") == c) & (F.col("owner") > 1)) for c in ("regex_rule", "manual_regex_rule")},
        **{t: F.sum(F.when(alone, F.col(t))) for t in orphans},
    }
    summed = counted.agg(*[F.coalesce(v, F.lit(0)).cast("bigint").alias(name) for name, v in totals.items()])
    return summed.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.col(name).alias("violations")) for name in totals])).alias("e")).select("e.*")
