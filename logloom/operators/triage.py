"""Triage of unknown lines: candidates, prompts, verdicts and what follows from them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.text import wall_time
from logloom.functions.templates import template_of
from logloom.operators.changes import last_per_key
from logloom.operators.alerts import time_text, alert_rows
from logloom.operators.catalog import add_patterns
from logloom.operators.joins import max_id
from logloom.operators.numbering import number_rows
from logloom.schemas import ALERTS, ANALYSES
from logloom.session import stage

# The verdict's fields and the note put on patterns added by triage.
VERDICT = ("is_abnormal boolean, label string, severity string, reason string, pattern_suggestion string")
NOTE = "LLM自動追加: "
NOTE_AUTO = "LLM自動追加（自動生成パターン）: "
NOTE_PREFIX = "LLM自動追加"


def candidates(logs: DataFrame, analyses: DataFrame, limit: int | None = 10,
               host: str | None = None) -> DataFrame:
    """Newest unknown logs that have no analysis yet, optionally of one host; all with ``limit=None``."""
    unknown = logs.where(~F.col("is_known"))
    if host is not None:
        unknown = unknown.where(F.col("host") == host)
    waiting = unknown.join(analyses.select("log_id"), "log_id", "left_anti").select(
        "log_id", "ts", "host", "component", "message", "raw_line")
    return waiting if limit is None else waiting.orderBy(F.desc("ts"), "log_id").limit(limit)


PROMPT_HEAD = "You are given one system log entry. Decide whether it shows an abnormal condition.\n\n"
PROMPT_TAIL = (
    "\n\nAnswer with a JSON object with the fields is_abnormal (true or false), "
    "label (normal, abnormal or unknown), severity (info, warning, critical or unknown), "
    "reason (one short sentence) and, for a normal line worth remembering, "
    "pattern_suggestion (a regular expression).\n"
    "normal: routine operation such as start-up or status. abnormal: errors, or warnings that need attention. "
    "unknown: neither is clear.\n"
)


def prompt_text() -> Column:
    """Question put to the scorer for a candidate row."""
    fields = {"Timestamp": time_text(F.col("ts")), "Host": F.col("host"), "Component": F.col("component"), "Message": F.col("message")}
    lines = [F.concat(F.lit(f"{title}: "), F.coalesce(value, F.lit("None"))) for title, value in fields.items()]
    return F.concat(F.lit(PROMPT_HEAD), F.concat_ws("\n", *lines), F.lit(PROMPT_TAIL))


def parse_verdict(response: Column, error: Column) -> Column:
    """Verdict of a JSON answer, with defaults for what is missing.

    An answer that is no JSON object, or a failed call (``error``), is the
    ``unknown`` verdict with the failure as reason.
    """
    parsed = F.from_json(response, VERDICT)
    is_object = F.coalesce(F.rlike(F.trim(response), F.lit(r"^\{")) & F.try_parse_json(response).isNotNull(), F.lit(False))
    failed = error.isNotNull() | ~is_object
    unknown = F.lit("unknown")

    def field(name: str, default: Column) -> Column:
        return F.when(failed, default).otherwise(F.coalesce(parsed[name], default))

    failure = F.concat(F.lit("LLM analysis failed: "), F.coalesce(error, F.lit("not a JSON object")))
    return F.struct(
        field("is_abnormal", F.lit(False)).alias("is_abnormal"),
        field("label", unknown).alias("label"),
        field("severity", unknown).alias("severity"),
        F.when(failed, failure).otherwise(F.coalesce(parsed["reason"], F.lit(""))).alias("reason"),
        field("pattern_suggestion", F.lit("")).alias("pattern_suggestion"),
        F.when(failed, F.lit("")).otherwise(response).alias("response"),
    )


def score(subjects: DataFrame, answers: DataFrame) -> DataFrame:
    """Attach answers (log_id, response, error) to candidates; a missing answer is a failed call, of several the last counts."""
    joined = subjects.join(last_per_key(answers, "log_id"), "log_id", "left")
    lost = F.when(F.col("response").isNull() & F.col("error").isNull(), F.lit("no answer")).otherwise(F.col("error"))
    return joined.withColumn("error", lost).withColumn("prompt", prompt_text()).withColumn(
        "verdict", parse_verdict(F.col("response"), F.col("error")))


def score_with(subjects: DataFrame, scorer) -> DataFrame:
    """Attach answers of a user function over batches of candidates.

    ``scorer`` takes an iterator of pandas frames (log_id, prompt) and yields frames
    with log_id, response and error, as ``mapInPandas`` does.
    """
    asked = subjects.withColumn("prompt", prompt_text()).select("log_id", "prompt")
    answers = asked.mapInPandas(scorer, "log_id bigint, response string, error string")
    return score(subjects, answers)


def analyses_of(scored: DataFrame, model_name: str, as_of: dt.datetime) -> DataFrame:
    """Analysis rows (T6) to append; a failed call leaves one as well."""
    text = F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error"))).otherwise(F.col("response"))
    return scored.select(
        "log_id", "prompt", text.alias("response"), F.lit(model_name).alias("model_name"),
        wall_time(as_of).alias("created_at"),
    ).select(*ANALYSES.fieldNames())


@dataclass(frozen=True)
class Triaged:
    logs: DataFrame
    catalog: DataFrame
    alerts: DataFrame
    rejected: DataFrame
    stats: DataFrame


def apply_verdicts(
    scored: DataFrame,
    logs: DataFrame,
    catalog: DataFrame,
    alerts: DataFrame,
    as_of: dt.datetime,
    auto_add_pattern: bool = True,
) -> Triaged:
    """Act on verdicts (log_id, message, component, verdict).

    abnormal: alert and reclassify. normal, when patterns may be added: take the
    suggested pattern, else the template of the message, and map the log to it.
    Anything else: leave the log. A suggestion that is no valid regex leaves its log
    alone and comes back as rejected. New pattern ids follow the log ids.
    """
    v = F.col("verdict")
    action = (
        F.when(v["label"] == "abnormal", F.lit("abnormal"))
        .when((v["label"] == "normal") & F.lit(auto_add_pattern), F.lit("normal"))
        .otherwise(F.lit("unknown"))
    )
    acted = scored.withColumn("action", action)
    accepted = acted.where("action = 'normal'")
    suggested = v["pattern_suggestion"] != ""
    new = accepted.select(
        F.col("log_id").alias("seq"), F.when(suggested, v["pattern_suggestion"]).otherwise(template_of(F.col("message"))).alias("regex"),
        F.col("message").alias("sample_message"), F.lit("normal").alias("label"),
        F.when(v["severity"] == "unknown", F.lit("info")).otherwise(v["severity"]).alias("severity"),
        "component",
        F.concat(F.when(suggested, F.lit(NOTE)).otherwise(F.lit(NOTE_AUTO)), v["reason"]).alias("note"),
    )
    added = add_patterns(catalog, new, as_of)
    mapped = added.assigned.select(F.col("seq").alias("log_id"), F.col("pattern_id").alias("_pattern"))
    # Written once: logs and counts both follow from it, and the plan behind it adds the patterns.
    changes = stage(
        acted.select("log_id", "action", v["label"].alias("_label"), v["severity"].alias("_severity"),
                     v["reason"].alias("_reason"))
        .join(mapped, "log_id", "left"), "triage-changes")
    abnormal = F.coalesce(F.col("action") == "abnormal", F.lit(False))
    by_hand = F.col("_pattern").isNotNull()
    changed = abnormal | by_hand
    new_logs = logs.join(changes, "log_id", "left").withColumns({
        "pattern_id": F.coalesce("_pattern", "pattern_id"),
        "is_known": by_hand | F.col("is_known"),
        "is_manual_mapped": by_hand | F.col("is_manual_mapped"),
        "classification": F.when(changed, F.col("_label")).otherwise(F.col("classification")),
        "severity": F.when(changed, F.col("_severity")).otherwise(F.col("severity")),
        "anomaly_reason": F.when(abnormal, F.col("_reason")).otherwise(F.col("anomaly_reason")),
    }).select(*logs.columns)
    raised = alert_rows(acted.where("action = 'abnormal'"), F.lit("abnormal"), as_of)
    numbered = number_rows(raised, "log_id", max_id(alerts, "alert_id"), "alert_id").select(*ALERTS.fieldNames())
    stats = changes.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("action") == "abnormal").alias("abnormal"),
        F.count_if(F.col("action") == "normal").alias("normal"),
        F.count_if(F.col("action") == "unknown").alias("unknown"),
        F.count_if(by_hand).alias("patterns_added"),
        F.count_if(F.col("action") == "abnormal").alias("alerts_created"),
    )
    return Triaged(new_logs, added.catalog, numbered, added.rejected, stats)
