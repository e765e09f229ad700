"""Alerts: raising, rendering, delivery results, feed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.text import wall_time
from logloom.operators.changes import first_per_key
from logloom.operators.numbering import number_rows
from logloom.schemas import ALERT_CHANNEL, ALERTS

FEED_MAX = 200
RENDERED_CHARS = 500


def alert_rows(logs: DataFrame, alert_type: Column, as_of: dt.datetime) -> DataFrame:
    """A pending alert per row of ``logs``, not yet numbered."""
    none = F.lit(None)
    return logs.select(
        "log_id", alert_type.alias("alert_type"), F.lit(ALERT_CHANNEL).alias("channel"),
        F.lit("pending").alias("status"), none.cast("string").alias("message"),
        wall_time(as_of).alias("created_at"),
        none.cast("timestamp_ntz").alias("sent_at"), none.cast("timestamp_ntz").alias("resolved_at"),
    )


def new_alerts(logs: DataFrame, as_of: dt.datetime, last_alert_id: int = 0) -> DataFrame:
    """Alerts of the abnormal and unknown lines, numbered in log order."""
    raised = logs.where(F.col("classification").isin("abnormal", "unknown"))
    alerts = alert_rows(raised, F.col("classification"), as_of)
    return number_rows(alerts, "log_id", last_alert_id, "alert_id").select(*ALERTS.fieldNames())


def pending_alerts(alerts: DataFrame, logs: DataFrame) -> DataFrame:
    """Pending alerts with their log, oldest first."""
    waiting = alerts.where("status = 'pending'").select("alert_id", "log_id", "alert_type", F.col("created_at").alias("alerted_at"))
    subject = logs.select("log_id", "ts", "host", "component", "message", "raw_line",
                          "classification", "severity", "anomaly_reason")
    return waiting.join(subject, "log_id").orderBy("alerted_at", "alert_id")


def time_text(ts: Column) -> Column:
    """ISO-like text with microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def alert_text() -> Column:
    """Message text of a pending alert; severity and reason lines only where present."""
    def field(title: str, value: Column) -> Column:
        return F.concat(F.lit(f"*{title}:* "), value)

    def optional(title: str, name: str) -> Column:
        return F.when(F.col(name) != "", field(title, F.col(name)))

    def block(name: str) -> Column:
        return F.concat(F.lit("```"), F.substring(F.col(name), 1, RENDERED_CHARS), F.lit("```"))

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("None"))

    return F.concat_ws(
        "\n",
        field("Alert Type", F.col("alert_type")),
        field("Log ID", F.col("log_id").cast("string")),
        field("Timestamp", time_text(F.col("ts"))),
        field("Host", shown("host")),
        field("Component", shown("component")),
        field("Classification", F.col("classification")),
        optional("Severity", "severity"),
        optional("Reason", "anomaly_reason"),
        F.lit(""), F.lit("*Message:*"), block("message"),
        F.lit(""), F.lit("*Raw Line:*"), block("raw_line"),
    )


def alert_payload() -> Column:
    """Webhook body as JSON text."""
    section = F.struct(
        F.lit("section").alias("type"),
        F.struct(F.lit("mrkdwn").alias("type"), alert_text().alias("text")).alias("text"),
    )
    title = F.concat(F.lit("\U0001f6a8 Log Alert: "), F.upper("alert_type"))
    return F.to_json(F.struct(title.alias("text"), F.array(section).alias("blocks")))


def merge_deliveries(alerts: DataFrame, deliveries: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Apply delivery results (log_id, ok, text, error) to the pending alerts of those logs.

    A log's first result (by ``seq`` where there is one) settles all alerts of it that wait.
    """
    result = first_per_key(deliveries, "log_id").select("log_id", "ok", F.col("text").alias("_text"), F.col("error").alias("_error"))
    hit = (F.col("status") == "pending") & F.col("ok").isNotNull()
    sent = hit & F.col("ok")
    return (
        alerts.join(result, "log_id", "left")
        .withColumns({
            "message": F.when(sent, F.col("_text")).when(hit, F.col("_error")).otherwise(F.col("message")),
            "sent_at": F.when(sent, wall_time(as_of)).otherwise(F.col("sent_at")),
            "status": F.when(sent, F.lit("sent")).when(hit, F.lit("failed")).otherwise(F.col("status")),
        })
        .select(*ALERTS.fieldNames())
    )


def alert_feed(alerts: DataFrame, logs: DataFrame, since_id: int = 0, limit: int = 50) -> DataFrame:
    """Newest alerts after ``since_id`` with their log; at most 200.

    The page is cut from the alerts before the logs are joined, as each alert has
    exactly one log.
    """
    page = (
        alerts.where(F.col("alert_id") > since_id).orderBy(F.desc("alert_id"))
        .limit(max(1, min(limit, FEED_MAX)))
        .select("alert_id", "alert_type", "status", F.col("created_at"), "log_id")
    )
    subject = logs.select("log_id", "classification", "severity",
                          F.coalesce("anomaly_reason", F.lit("")).alias("anomaly_reason"), "message")
    return page.join(subject, "log_id").orderBy(F.desc("alert_id")).select(
        "alert_id", "alert_type", "status", "created_at", "log_id", "classification",
        "severity", "anomaly_reason", "message")


def feed_json(feed: DataFrame) -> DataFrame:
    """The feed as one JSON text per row."""
    return feed.select("alert_id", F.to_json(F.struct(*feed.columns), {"ignoreNullFields": "false"}).alias("body"))
