"""Reports over the state tables.

Reports that relate patterns to logs first count the logs per pattern: that
aggregate combines before its shuffle, so a pattern with most of the logs weighs
no more than any other, and only one row per pattern is joined. Where a report only
counts, ``logs`` may be log rows or their summary (:mod:`logloom.operators.summaries`).
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.text import wall_time
from logloom.functions.regexes import java_spellings, python_group, python_search
from logloom.operators.params import explode_params
from logloom.operators.numbering import number_rows
from logloom.operators.summaries import is_summary, line_count, since
from logloom.operators.triage import NOTE_PREFIX

# Up to here a sorted head is found with a heap per task.
TOP_ROWS = 100_000



def _pattern_text() -> Column:
    return F.coalesce("regex_rule", "manual_regex_rule")


def _count(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(line_count(df).alias(name))


def logs_per_pattern(catalog: DataFrame, logs: DataFrame) -> DataFrame:
    """Catalog rows with ``log_count``, 0 for unused patterns."""
    used = _count(logs.where("pattern_id is not null"), "pattern_id", name="_n")
    return catalog.join(used, "pattern_id", "left").withColumn("log_count", F.coalesce("_n", F.lit(0))).drop("_n")


def with_pattern(logs: DataFrame, catalog: DataFrame, columns: list, how: str = "inner") -> DataFrame:
    """Logs joined with chosen catalog columns."""
    return logs.join(catalog.select("pattern_id", *columns), "pattern_id", how)


# --- totals and distributions -------------------------------------------------

def unknown_patterns(catalog: DataFrame, limit: int = 100) -> DataFrame:
    """Patterns labelled unknown, most frequent first, with short texts."""
    return (
        catalog.where("label = 'unknown'")
        .select("pattern_id", F.substring(_pattern_text(), 1, 70).alias("regex"),
                F.substring("sample_message", 1, 70).alias("sample"), "total_count", "first_seen_at", "last_seen_at")
        .orderBy(F.desc("total_count"), "pattern_id").limit(limit)
    )


def totals(logs: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: number of logs and of patterns."""
    both = logs.agg(line_count(logs).alias("log_total"), F.lit(0).cast("bigint").alias("pattern_total")).unionByName(
        catalog.agg(F.lit(0).cast("bigint").alias("log_total"), F.count("*").alias("pattern_total")))
    return both.agg(F.sum("log_total").alias("log_total"), F.sum("pattern_total").alias("pattern_total"))


def by_classification(logs: DataFrame) -> DataFrame:
    return _count(logs, "classification").orderBy(F.desc("count"), "classification")


def by_label(catalog: DataFrame) -> DataFrame:
    return _count(catalog, "label").orderBy(F.desc("count"), "label")


def by_alert_status(alerts: DataFrame) -> DataFrame:
    return _count(alerts, "status").orderBy("status")


def recent(logs: DataFrame, as_of: dt.datetime, hours: int = 24, cut_hour: DataFrame | None = None) -> DataFrame:
    """Abnormal and unknown lines of the hours before ``as_of``.

    A summary counts whole hours; ``cut_hour`` gives the logs for a start inside an hour.
    """
    start = as_of - dt.timedelta(hours=hours)
    subject = since(logs, start, cut_hour) if is_summary(logs) else logs.where(F.col("ts") >= wall_time(start))
    return subject.agg(
        line_count(subject, F.col("classification") == "abnormal").alias("abnormal"),
        line_count(subject, F.col("classification") == "unknown").alias("unknown"))


def log_overview(logs: DataFrame) -> DataFrame:
    return logs.agg(
        line_count(logs).alias("total_logs"), line_count(logs, F.col("is_known")).alias("known_logs"),
        line_count(logs, ~F.col("is_known")).alias("unknown_logs"), F.count_distinct("host").alias("unique_hosts"))


def pattern_overview(catalog: DataFrame) -> DataFrame:
    def labelled(name: str) -> Column:
        return F.count_if(F.col("label") == name).alias(f"{name}_patterns")

    return catalog.agg(
        F.count("*").alias("total_patterns"), labelled("normal"), labelled("abnormal"), labelled("unknown"),
        F.count("manual_regex_rule").alias("manual_patterns"), F.count("regex_rule").alias("auto_patterns"))


def known_share(logs: DataFrame) -> DataFrame:
    """Known and unknown lines with their share in percent."""
    counts = logs.agg(line_count(logs, F.col("is_known")).alias("k"), line_count(logs).alias("n"))
    sides = F.array(F.struct(F.lit(True).alias("is_known"), F.col("k").alias("count")),
                    F.struct(F.lit(False).alias("is_known"), (F.col("n") - F.col("k")).alias("count")))
    return (
        counts.select("n", F.explode(sides).alias("s")).where("s.count > 0")
        .select("s.is_known", "s.count", F.round(F.col("s.count") * 100.0 / F.col("n"), 2).alias("percentage"))
    )


def known_distribution(logs: DataFrame, known: str = "known", unknown: str = "unknown") -> DataFrame:
    status = F.when(F.col("is_known"), F.lit(known)).otherwise(F.lit(unknown))
    return logs.groupBy(status.alias("status")).agg(line_count(logs).alias("count"))


def by_severity(catalog: DataFrame) -> DataFrame:
    return _count(catalog.where("severity is not null"), "severity").orderBy(F.desc("count"), "severity")


def by_label_and_severity(catalog: DataFrame) -> DataFrame:
    return _count(catalog, "label", "severity").orderBy("label", "severity")


def by_host(logs: DataFrame, like: str | None = None, limit: int | None = None) -> DataFrame:
    """Logs per host, optionally of hosts like a pattern, or the busiest only."""
    subject = logs if like is None else logs.where(F.col("host").like(like))
    counted = _count(subject, "host").orderBy(F.desc("count"), "host")
    return counted if limit is None else counted.limit(limit)


# --- unknown lines --------------------------------------------------------------

def unknown_logs(logs: DataFrame, host: str | None = None, like: str | None = None,
                 since: dt.datetime | None = None, not_mapped: bool = False) -> DataFrame:
    """Unknown lines, newest first, with the optional filters the query guide lists."""
    found = logs.where(~F.col("is_known"))
    if host is not None:
        found = found.where(F.col("host") == host)
    if like is not None:
        found = found.where(F.col("message").like(like))
    if since is not None:
        found = found.where(F.col("ts") >= wall_time(since))
    if not_mapped:
        found = found.where(~F.col("is_manual_mapped"))
    return found.select(
        "log_id", "ts", "host", "component", "message", "raw_line", "is_known", "is_manual_mapped",
        "classification", "pattern_id").orderBy(F.desc("ts"), "log_id")


def unknown_preview(logs: DataFrame, host: str, limit: int = 10) -> DataFrame:
    return (
        logs.where(~F.col("is_known") & (F.col("host") == host))
        .select("log_id", "ts", "component", F.substring("message", 1, 100).alias("message_preview"),
                "is_known", "classification")
        .orderBy(F.desc("ts"), "log_id").limit(limit)
    )


def unknown_count(logs: DataFrame, host: str) -> DataFrame:
    return logs.where(~F.col("is_known") & (F.col("host") == host)).agg(line_count(logs).alias("unknown_count"))


def unknown_by_component(logs: DataFrame, host: str) -> DataFrame:
    return _count(logs.where(~F.col("is_known") & (F.col("host") == host)), "component").orderBy(
        F.desc("count"), "component")


def unknown_with_pattern(logs: DataFrame, catalog: DataFrame, host: str) -> DataFrame:
    subject = logs.where(~F.col("is_known") & (F.col("host") == host)).select(
        "log_id", "ts", "host", "component", "message", "is_known", "classification", "pattern_id")
    return with_pattern(subject, catalog, ["regex_rule", "sample_message", F.col("label").alias("pattern_label")],
                        "left").orderBy(F.desc("ts"), "log_id")


def unknown_share_by_host(logs: DataFrame) -> DataFrame:
    """Unknown lines per host and their share of the host's lines; one pass over the logs."""
    unknown = line_count(logs, ~F.col("is_known"))
    return (
        logs.groupBy("host").agg(unknown.alias("unknown_count"), line_count(logs).alias("_n"))
        .where("unknown_count > 0")
        .select("host", "unknown_count",
                F.when(F.col("host").isNotNull(), F.col("unknown_count") * 100.0 / F.col("_n")).alias("unknown_percentage"))
        .orderBy(F.desc("unknown_count"), "host")
    )


def unknown_patterns_of_host(logs: DataFrame, catalog: DataFrame, host: str) -> DataFrame:
    used = _count(logs.where(~F.col("is_known") & (F.col("host") == host)), "pattern_id", name="log_count")
    return used.join(catalog.select("pattern_id", "regex_rule", "sample_message"), "pattern_id").orderBy(
        F.desc("log_count"), "pattern_id")


def _first_logs(logs: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` logs by id; a long list is cut by rank, not gathered in one task."""
    if limit is None:
        return logs
    if limit <= TOP_ROWS:
        return logs.orderBy("log_id").limit(limit)
    return number_rows(logs, "log_id", 0, "_rank").where(F.col("_rank") <= limit).drop("_rank")


def search_unknown(logs: DataFrame, regex: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Unknown lines a regex is found in: id, its groups joined by tabs, start of the message.

    ``limit`` bounds the lines looked at, in log order, not those found. Returns
    (found, one row with matched and checked).
    """
    groups = re.compile(regex).groups
    java = java_spellings(logs.sparkSession, [regex])[0]
    looked_at = _first_logs(logs.where("classification = 'unknown'").select("log_id", "message"), limit)
    if java is None:
        tested = looked_at.withColumn("hit", python_search(regex)("message"))
        parts = [python_group(regex, i)("message") for i in range(1, groups + 1)]
    else:
        tested = looked_at.withColumn("hit", F.rlike("message", F.lit(java)))
        parts = [F.regexp_extract("message", java, i) for i in range(1, groups + 1)]
    found = tested.where("hit").select(
        "log_id", (F.concat_ws("\t", *parts) if parts else F.lit("")).alias("groups"),
        F.substring("message", 1, 160).alias("message_head"))
    counted = tested.agg(F.count_if("hit").alias("matched"), F.count("*").alias("checked"))
    return found, counted


# --- patterns and their logs ----------------------------------------------------

def pattern_counts(catalog: DataFrame, logs: DataFrame, pattern_id: int | None = None,
                   contains: str | None = None, limit: int | None = None) -> DataFrame:
    """Logs per pattern: of one id, of patterns containing a text, or the most used ones."""
    subject = catalog
    if pattern_id is not None:
        subject = subject.where(F.col("pattern_id") == pattern_id)
        logs = logs.where(F.col("pattern_id") == pattern_id)
    if contains is not None:
        subject = subject.where(F.contains(_pattern_text(), F.lit(contains)))
    counted = logs_per_pattern(subject, logs).select(
        "pattern_id", _pattern_text().alias("pattern"), "label", "sample_message", "log_count"
    ).orderBy(F.desc("log_count"), "pattern_id")
    return counted if limit is None else counted.limit(limit)


def label_usage(catalog: DataFrame, logs: DataFrame) -> DataFrame:
    return logs_per_pattern(catalog, logs).groupBy("label").agg(
        F.count("*").alias("pattern_count"), F.sum("log_count").alias("log_count")
    ).orderBy(F.desc("log_count"), "label")


def manual_and_auto(catalog: DataFrame, logs: DataFrame) -> DataFrame:
    kind = F.when(F.col("manual_regex_rule").isNotNull(), F.lit("manual")).otherwise(F.lit("auto"))
    return logs_per_pattern(catalog, logs).groupBy(kind.alias("pattern_type")).agg(
        F.count("*").alias("pattern_count"), F.sum("log_count").alias("log_count"))


def logs_of_pattern(logs: DataFrame, pattern_id: int, limit: int = 100) -> DataFrame:
    return (
        logs.where(F.col("pattern_id") == pattern_id)
        .select("log_id", "ts", "host", "component", "message", "classification", "is_known")
        .orderBy(F.desc("ts"), "log_id").limit(limit)
    )


def known_logs(logs: DataFrame, catalog: DataFrame, limit: int = 10) -> DataFrame:
    head = logs.where("is_known").select("log_id", "host", "component", "is_known", "classification", "pattern_id")
    # Known lines always have a pattern, so the page can be cut before the join.
    return with_pattern(head.orderBy("log_id").limit(limit), catalog,
                        ["regex_rule", "manual_regex_rule", F.col("label").alias("pattern_label")]).orderBy("log_id")


def labels_of_known(catalog: DataFrame, logs: DataFrame, limit: int = 20) -> DataFrame:
    """Patterns some known line has, most frequent first."""
    used = logs.where("is_known and pattern_id is not null").select("pattern_id").distinct()
    return catalog.join(used, "pattern_id", "left_semi").select(
        "pattern_id", "label", "severity", "sample_message", "total_count"
    ).orderBy(F.desc("total_count"), "pattern_id").limit(limit)


def labels_of_known_elsewhere(catalog: DataFrame, logs: DataFrame, host: str, limit: int = 20) -> DataFrame:
    """The same with the hosts that have the pattern, leaving out one host."""
    known = logs.where("is_known and pattern_id is not null").select("pattern_id").distinct()
    places = logs.where((F.col("host") != host) & F.col("pattern_id").isNotNull()).select("pattern_id", "host").distinct()
    return (
        catalog.join(known, "pattern_id", "left_semi")
        .select("pattern_id", "label", "severity", "sample_message", "total_count")
        .join(places, "pattern_id")
        .orderBy(F.desc("total_count"), "pattern_id", "host").limit(limit)
    )


def abnormal_in_normal(logs: DataFrame, catalog: DataFrame, limit: int = 20) -> DataFrame:
    """Lines a rule made abnormal although their pattern is normal."""
    subject = logs.where("classification = 'abnormal'").select(
        "log_id", "ts", "host", "component", "message", "classification", "severity", "anomaly_reason", "pattern_id")
    normal = catalog.where("label = 'normal'")
    return with_pattern(subject, normal, ["sample_message"]).orderBy(F.desc("ts"), "log_id").limit(limit)


def pattern_lookup(catalog: DataFrame, text: str, limit: int = 5) -> DataFrame:
    has = F.contains("sample_message", F.lit(text)) | F.contains("manual_regex_rule", F.lit(text))
    return catalog.where(has).select(
        "pattern_id", "manual_regex_rule", "sample_message", "label", "severity", "note", "total_count"
    ).orderBy(F.desc("pattern_id")).limit(limit)


def pattern_health(logs: DataFrame) -> DataFrame:
    """Total, known, unknown and abnormal lines of every pattern."""
    return logs.where("pattern_id is not null").groupBy("pattern_id").agg(
        line_count(logs).alias("total"), line_count(logs, F.col("is_known")).alias("known"),
        line_count(logs, ~F.col("is_known")).alias("unknown"),
        line_count(logs, F.col("classification") == "abnormal").alias("abnormal"))


def parameterised(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        "pattern_id", F.coalesce("manual_regex_rule", "regex_rule").alias("pattern"), "sample_message", "note",
        "has_params", F.when(F.col("has_params"), F.lit("Yes")).otherwise(F.lit("No")).alias("has_parameters"))


def logs_with_parameterised(logs: DataFrame, catalog: DataFrame, like: str) -> DataFrame:
    subject = logs.where(F.col("message").like(like)).select("log_id", "message", "pattern_id")
    return with_pattern(subject, catalog, ["has_params", "sample_message"], "left")


def pattern_of_log(logs: DataFrame, log_id: int) -> DataFrame:
    """Classification counts of the pattern that a given log has."""
    own = logs.where(F.col("log_id") == log_id).select("pattern_id")
    return _count(logs.join(own, "pattern_id", "left_semi"), "classification")


def latest_logs(logs: DataFrame, limit: int = 10) -> DataFrame:
    return logs.select("log_id", "host", "classification", "pattern_id", "message").orderBy(F.desc("log_id")).limit(limit)


# --- rules ------------------------------------------------------------------------

def rules_of_pattern(rules: DataFrame, pattern_id: int) -> DataFrame:
    return rules.where(F.col("pattern_id") == pattern_id).orderBy("rule_id")


def active_rule_list(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    return rules.where("is_active").join(catalog.select("pattern_id", "sample_message"), "pattern_id").select(
        "rule_id", "pattern_id", "sample_message", "rule_type", "field_name", "op", "threshold1",
        "severity_if_match", "message").orderBy(F.desc("rule_id"))


# --- parameters -------------------------------------------------------------------

def own_params(subject: DataFrame, params: DataFrame | None) -> DataFrame:
    """Long-form parameters of the given logs: from the map on their rows where they carry it, else from the table."""
    if "params" in subject.columns:
        return explode_params(subject)
    return params.join(subject.select("log_id"), "log_id", "left_semi")


def params_of_pattern(params: DataFrame | None, logs: DataFrame, pattern_id: int) -> DataFrame:
    return own_params(logs.where(F.col("pattern_id") == pattern_id), params).orderBy(F.desc("log_id"), "param_name")


def logs_with_param(logs: DataFrame, pattern_id: int, name: str, abnormal_only: bool = False, limit: int | None = 10) -> DataFrame:
    """Newest logs of a pattern with one parameter as a column, taken from the map the rows carry: no join."""
    subject = logs.where(F.col("pattern_id") == pattern_id)
    if abnormal_only:
        subject = subject.where("classification = 'abnormal'")
    held = F.coalesce(F.map_contains_key("params", F.lit(name)), F.lit(False))
    found = subject.select(
        "log_id", "ts", "host", "message", "classification", "severity", "anomaly_reason",
        F.when(held, F.lit(name)).alias("param_name"), F.col("params")[name]["num"].alias("param_value_num")).orderBy(F.desc("ts"), "log_id")
    return found if limit is None else found.limit(limit)


def abnormal_by_param(logs: DataFrame, params: DataFrame | None, name: str, below: float, limit: int = 20) -> DataFrame:
    subject = logs.where("classification = 'abnormal'")
    shown = ("log_id", "ts", "host", "component", "classification", "severity", "anomaly_reason", "message")
    if "params" in logs.columns:
        valued = subject.select(*shown, F.col("params")[name]["num"].alias("param_value_num")).where(F.col("param_value_num") < below)
    else:
        value = params.where((F.col("param_name") == name) & (F.col("param_value_num") < below)).select("log_id", "param_value_num")
        valued = subject.select(*shown).join(value, "log_id")
    return valued.orderBy(F.desc("log_id")).limit(limit)


def param_statistics(params: DataFrame | None, logs: DataFrame, pattern_id: int) -> DataFrame:
    return own_params(logs.where(F.col("pattern_id") == pattern_id), params).groupBy("param_name").agg(
        F.count("*").alias("count"), F.min("param_value_num").alias("min_value"),
        F.max("param_value_num").alias("max_value"), F.avg("param_value_num").alias("avg_value"),
    ).orderBy("param_name")


def latest_with_params(logs: DataFrame, pattern_id: int, limit: int = 5) -> DataFrame:
    """Newest logs of a pattern with their parameters as one text, ordered by name; NULL for a log without any."""
    page = logs.where(F.col("pattern_id") == pattern_id).select(
        "log_id", "ts", "host", "message", "classification", "is_known", "params").orderBy(F.desc("ts"), "log_id").limit(limit)
    pairs = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["num"].cast("string")))
    return page.withColumn("params", F.when(F.size("params") > 0, F.array_join(pairs, ", ")))



def params_for_message(logs: DataFrame, params: DataFrame | None, like: str) -> DataFrame:
    """Logs with a message like a pattern, one row per parameter, in log order."""
    shown = ("log_id", "message", "classification", "severity", "anomaly_reason")
    found = logs.where(F.col("message").like(like))
    if "params" in logs.columns:
        return found.select(*shown, F.explode_outer("params").alias("param_name", "value")).select(
            *shown, "param_name", F.col("value.num").alias("param_value_num")).orderBy("log_id", "param_name")
    subject = found.select(*shown)
    return subject.join(params.select("log_id", "param_name", "param_value_num"), "log_id", "left").orderBy(
        "log_id", "param_name")


# --- alerts and triage --------------------------------------------------------------

def abnormal_with_alerts(logs: DataFrame, alerts: DataFrame) -> DataFrame:
    subject = logs.where("classification = 'abnormal'").select(
        "log_id", "message", "classification", "severity", "anomaly_reason")
    return subject.join(alerts.select("log_id", "alert_id", "alert_type", "status"), "log_id", "left").orderBy(
        F.desc("log_id"), "alert_id")


def latest_alerts(alerts: DataFrame, logs: DataFrame, limit: int = 20) -> DataFrame:
    page = alerts.select("alert_id", "log_id", "alert_type", "status", "created_at").orderBy(
        F.desc("created_at"), F.desc("alert_id")).limit(limit)
    return page.join(logs.select("log_id", "classification", "severity", "message"), "log_id").orderBy(
        F.desc("created_at"), F.desc("alert_id"))


def alerts_by_type_and_status(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type", "status").agg(
        F.min("alert_id").alias("first_alert_id"), F.count("*").alias("count")
    ).orderBy(F.desc("count"), "alert_type", "status")


def triage_results(logs: DataFrame, analyses: DataFrame, limit: int = 10) -> DataFrame:
    page = analyses.orderBy(F.desc("created_at"), "log_id").limit(limit)
    return page.select("log_id", "response", "created_at").join(logs.select("log_id", "message"), "log_id").orderBy(
        F.desc("created_at"), "log_id")


def triage_abnormal(logs: DataFrame, analyses: DataFrame) -> DataFrame:
    subject = logs.where("classification = 'abnormal'").select("log_id", "host", "classification", "severity", "message")
    return subject.join(analyses.select("log_id"), "log_id")


def triage_patterns(catalog: DataFrame) -> DataFrame:
    """Number of patterns that triage added."""
    return catalog.where(F.col("note").startswith(NOTE_PREFIX)).agg(F.count("*").alias("added_patterns"))


def remaining_unknown(logs: DataFrame) -> DataFrame:
    return logs.where("classification = 'unknown'").agg(F.count("*").alias("remaining_unknown"))
