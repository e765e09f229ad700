"""Schemas of the seven state tables and the value domains of their enums."""

from __future__ import annotations

from pyspark.sql import types as T

# The accepted words of each enum column.
LABELS = ("normal", "abnormal", "unknown", "ignore")
SEVERITIES = ("info", "warning", "critical", "unknown")
RULE_SEVERITIES = ("info", "warning", "critical")
RULE_TYPES = ("threshold", "contains", "regex")
THRESHOLD_OPS = (">", "<", ">=", "<=", "==", "!=", "between", "not_between")
ALERT_TYPES = ("abnormal", "unknown")
ALERT_STATUSES = ("pending", "sent", "failed")
ALERT_CHANNEL = "slack"


_TYPES = {
    "bigint": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType()),
}


def schema_of(columns: str) -> T.StructType:
    """Schema of ``name type, ...``; needs no running session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LINES = schema_of("value string, source_file string, line_seq bigint")

CATALOG = schema_of(
    "pattern_id bigint, regex_rule string, manual_regex_rule string, sample_message string, "
    "label string, severity string, note string, component string, has_params boolean, "
    "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, total_count bigint, "
    "updated_at timestamp_ntz"
)

LOGS = schema_of(
    "log_id bigint, ts timestamp_ntz, host string, component string, raw_line string, "
    "message string, pattern_id bigint, is_known boolean, is_manual_mapped boolean, "
    "classification string, severity string, anomaly_reason string, source_file string, "
    "line_seq bigint, created_at timestamp_ntz, updated_at timestamp_ntz"
)

PARAMS = schema_of("log_id bigint, param_name string, param_value_num double, param_value_text string")

RULES = schema_of(
    "rule_id bigint, pattern_id bigint, rule_type string, field_name string, op string, "
    "threshold1 double, threshold2 double, search_text string, severity_if_match string, "
    "is_abnormal_if_match boolean, message string, is_active boolean"
)

ALERTS = schema_of(
    "alert_id bigint, log_id bigint, alert_type string, channel string, status string, "
    "message string, created_at timestamp_ntz, sent_at timestamp_ntz, resolved_at timestamp_ntz"
)

ANALYSES = schema_of(
    "log_id bigint, prompt string, response string, model_name string, created_at timestamp_ntz"
)

UNIQUE_LINES = schema_of(
    "raw_line string, count bigint, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, "
    "first_seen_file string, last_seen_file string"
)

TABLES = {
    "catalog": CATALOG,
    "logs": LOGS,
    "params": PARAMS,
    "rules": RULES,
    "alerts": ALERTS,
    "analyses": ANALYSES,
    "unique_lines": UNIQUE_LINES,
}
