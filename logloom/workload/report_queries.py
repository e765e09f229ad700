"""The reports, over the tables after the triage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from logloom.operators import reports as r
from logloom.workload import oracle_tables as o
from logloom.workload.registry import query, ts_sql, ts_text
from logloom.workload.state import triaged

HOST = "10.0.0.105"
AS_OF = dt.datetime(2024, 1, 30, 12, 0, 0)

# The reports' SQL reads the tables under their own names.
_BASE = o.triage_ctes()


# Reports that only count lines: registered over the logs, and over the summaries of the batches.
COUNTING = (
    "totals", "by_classification", "recent", "log_overview", "known_share", "known_distribution", "by_host", "by_host_like",
    "unknown_count", "unknown_by_component", "unknown_share_by_host", "unknown_patterns_of_host", "pattern_counts", "pattern_count_of_id",
    "pattern_counts_top", "label_usage", "manual_and_auto", "labels_of_known", "labels_of_known_elsewhere", "pattern_health",
)


def _sql(select: str) -> str:
    renamed = select
    for name in ("logs", "catalog", "alerts"):
        renamed = renamed.replace(f"<{name}>", f"t_{name}")
    return o.with_ctes(_BASE, renamed.replace("<params>", "params").replace("<rules>", "rules"))


def report(name: str, sql: str):
    """Register a report; ``sql`` names the tables as <logs>, <catalog>, <params>, <rules>, <alerts>."""
    def register(run):
        if name in COUNTING:
            query(f"summary_{name}", _sql(sql))(lambda spark, sf: run(_counted(triaged(spark, sf))))
        return query(f"report_{name}", _sql(sql))(lambda spark, sf: run(triaged(spark, sf)))

    return register


def _counted(t):
    """The tables with the merged summaries of both batches and the triage in place of the logs."""
    return {name: table for name, table in t.items() if name not in ("rows", "params")} | {"logs": t["summary"]}


def _times(df, *names):
    return df.withColumns({n: ts_text(n) for n in names})


# --- totals and distributions -------------------------------------------------

@report("unknown_patterns", f"""SELECT pattern_id, left(coalesce(regex_rule, manual_regex_rule), 70) AS regex, left(sample_message, 70) AS sample,
  total_count, {ts_sql('first_seen_at')}, {ts_sql('last_seen_at')} FROM <catalog> WHERE label = 'unknown' ORDER BY total_count DESC, pattern_id LIMIT 100""")
def _(t):
    return _times(r.unknown_patterns(t["catalog"]), "first_seen_at", "last_seen_at")


@report("totals", "SELECT (SELECT count(*) FROM <logs>) AS log_total, (SELECT count(*) FROM <catalog>) AS pattern_total")
def _(t):
    return r.totals(t["logs"], t["catalog"])


@report("by_classification", "SELECT classification, count(*) AS count FROM <logs> GROUP BY classification")
def _(t):
    return r.by_classification(t["logs"])


@report("by_label", "SELECT label, count(*) AS count FROM <catalog> GROUP BY label")
def _(t):
    return r.by_label(t["catalog"])


@report("by_alert_status", "SELECT status, count(*) AS count FROM <alerts> GROUP BY status")
def _(t):
    return r.by_alert_status(t["alerts"])


@report("recent", """SELECT count_if(classification = 'abnormal') AS abnormal, count_if(classification = 'unknown') AS unknown
  FROM <logs> WHERE ts >= TIMESTAMP '2024-01-29 12:00:00'""")
def _(t):
    return r.recent(t["logs"], AS_OF)


@report("log_overview", """SELECT count(*) AS total_logs, CAST(sum(CASE WHEN is_known THEN 1 ELSE 0 END) AS BIGINT) AS known_logs,
  CAST(sum(CASE WHEN NOT is_known THEN 1 ELSE 0 END) AS BIGINT) AS unknown_logs, count(DISTINCT host) AS unique_hosts FROM <logs>""")
def _(t):
    return r.log_overview(t["logs"])


@report("pattern_overview", """SELECT count(*) AS total_patterns, count_if(label = 'normal') AS normal_patterns, count_if(label = 'abnormal') AS abnormal_patterns,
  count_if(label = 'unknown') AS unknown_patterns, count_if(manual_regex_rule IS NOT NULL) AS manual_patterns,
  count_if(regex_rule IS NOT NULL) AS auto_patterns FROM <catalog>""")
def _(t):
    return r.pattern_overview(t["catalog"])


@report("known_share", "SELECT is_known, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM <logs>), 2) AS percentage FROM <logs> GROUP BY is_known")
def _(t):
    return r.known_share(t["logs"])


@report("known_distribution", "SELECT CASE WHEN is_known THEN 'known' ELSE 'unknown' END AS status, count(*) AS count FROM <logs> GROUP BY is_known")
def _(t):
    return r.known_distribution(t["logs"])


@report("by_severity", "SELECT severity, count(*) AS count FROM <catalog> WHERE severity IS NOT NULL GROUP BY severity")
def _(t):
    return r.by_severity(t["catalog"])


@report("by_label_and_severity", "SELECT label, severity, count(*) AS count FROM <catalog> GROUP BY label, severity")
def _(t):
    return r.by_label_and_severity(t["catalog"])


@report("by_host", "SELECT host, count(*) AS count FROM <logs> GROUP BY host")
def _(t):
    return r.by_host(t["logs"])


@report("by_host_like", "SELECT host, count(*) AS count FROM <logs> WHERE host LIKE '10.0.0.11%' GROUP BY host QUALIFY row_number() OVER (ORDER BY count(*) DESC, host) <= 5")
def _(t):
    return r.by_host(t["logs"], "10.0.0.11%", 5)


# --- unknown lines --------------------------------------------------------------

_UNKNOWN_COLUMNS = f"log_id, {ts_sql('ts')}, host, component, message, raw_line, is_known, is_manual_mapped, classification, coalesce(pattern_id, -1) AS pattern_id"


def _unknown(df):
    return _times(df, "ts").withColumn("pattern_id", F.coalesce("pattern_id", F.lit(-1)))


@report("unknown_logs", f"SELECT {_UNKNOWN_COLUMNS} FROM <logs> WHERE NOT is_known")
def _(t):
    return _unknown(r.unknown_logs(t["logs"]))


@report("unknown_logs_of_host", f"SELECT {_UNKNOWN_COLUMNS} FROM <logs> WHERE NOT is_known AND host = '{HOST}'")
def _(t):
    return _unknown(r.unknown_logs(t["logs"], HOST))


@report("unknown_logs_like", f"SELECT {_UNKNOWN_COLUMNS} FROM <logs> WHERE NOT is_known AND host = '{HOST}' AND message LIKE '%volume%'")
def _(t):
    return _unknown(r.unknown_logs(t["logs"], HOST, like="%volume%"))


@report("unknown_logs_recent", f"SELECT {_UNKNOWN_COLUMNS} FROM <logs> WHERE NOT is_known AND ts >= TIMESTAMP '2024-01-29 12:00:00'")
def _(t):
    return _unknown(r.unknown_logs(t["logs"], since=AS_OF - dt.timedelta(hours=24)))


@report("unknown_logs_not_mapped", f"SELECT {_UNKNOWN_COLUMNS} FROM <logs> WHERE NOT is_known AND NOT is_manual_mapped AND host = '{HOST}'")
def _(t):
    return _unknown(r.unknown_logs(t["logs"], HOST, not_mapped=True))


@report("unknown_preview", f"""SELECT log_id, {ts_sql('ts')}, component, substr(message, 1, 100) AS message_preview, is_known, classification FROM <logs>
  WHERE host = '{HOST}' AND NOT is_known ORDER BY <logs>.ts DESC, log_id LIMIT 10""")
def _(t):
    return _times(r.unknown_preview(t["logs"], HOST), "ts")


@report("unknown_count", f"SELECT count(*) AS unknown_count FROM <logs> WHERE host = '{HOST}' AND NOT is_known")
def _(t):
    return r.unknown_count(t["logs"], HOST)


@report("unknown_by_component", f"SELECT component, count(*) AS count FROM <logs> WHERE host = '{HOST}' AND NOT is_known GROUP BY component")
def _(t):
    return r.unknown_by_component(t["logs"], HOST)


@report("unknown_with_pattern", f"""SELECT l.log_id, l.host, l.component, l.message, l.is_known, l.classification, coalesce(l.pattern_id, -1) AS pattern_id,
  p.regex_rule, p.sample_message, p.label AS pattern_label FROM <logs> l LEFT JOIN <catalog> p ON l.pattern_id = p.pattern_id
  WHERE l.host = '{HOST}' AND NOT l.is_known""")
def _(t):
    return r.unknown_with_pattern(t["logs"], t["catalog"], HOST).withColumn("pattern_id", F.coalesce("pattern_id", F.lit(-1))).drop("ts")


@report("unknown_share_by_host", """SELECT host, unseen AS unknown_count, unseen * 100.0 / if(host IS NULL, NULL, lines) AS unknown_percentage
  FROM (SELECT host, count_if(is_known = false) AS unseen, count(*) AS lines FROM <logs> GROUP BY host) AS per_host WHERE unseen > 0""")
def _(t):
    return r.unknown_share_by_host(t["logs"])


@report("unknown_patterns_of_host", f"""SELECT pattern_id, regex_rule, sample_message, lines AS log_count
  FROM (SELECT pattern_id, count(*) AS lines FROM <logs> WHERE host = '{HOST}' AND is_known = false GROUP BY pattern_id) AS seen JOIN <catalog> USING (pattern_id)""")
def _(t):
    return r.unknown_patterns_of_host(t["logs"], t["catalog"], HOST)


_SEARCH = r"job (\w+) failed: code (0x[0-9a-f]+)"


@report("search_unknown", rf"""SELECT log_id, regexp_extract(message, '{_SEARCH}', 1) || chr(9) || regexp_extract(message, '{_SEARCH}', 2) AS groups,
  substr(message, 1, 160) AS message_head FROM <logs> WHERE classification = 'unknown' AND regexp_matches(message, '{_SEARCH}')""")
def _(t):
    return r.search_unknown(t["logs"], _SEARCH)[0]


@report("search_unknown_limited", rf"""SELECT count_if(regexp_matches(message, '{_SEARCH}')) AS matched, count(*) AS checked
  FROM (SELECT message FROM <logs> WHERE classification = 'unknown' ORDER BY log_id LIMIT 500)""")
def _(t):
    return r.search_unknown(t["logs"], _SEARCH, 500)[1]


# --- patterns and their logs ----------------------------------------------------

# Lines are counted per pattern once; patterns without lines come in afterwards.
_USED = "<catalog> LEFT JOIN (SELECT pattern_id, count(*) AS lines FROM <logs> GROUP BY pattern_id) AS used USING (pattern_id)"
_COUNTED = f"SELECT pattern_id, ifnull(regex_rule, manual_regex_rule) AS pattern, label, sample_message, ifnull(lines, 0) AS log_count FROM {_USED}"


@report("pattern_counts", _COUNTED)
def _(t):
    return r.pattern_counts(t["catalog"], t["logs"])


@report("pattern_count_of_id", _COUNTED + " WHERE pattern_id = 3")
def _(t):
    return r.pattern_counts(t["catalog"], t["logs"], pattern_id=3)


@report("pattern_counts_like", _COUNTED + " WHERE contains(concat_ws(chr(10), regex_rule, manual_regex_rule), 'volume')")
def _(t):
    return r.pattern_counts(t["catalog"], t["logs"], contains="volume")


@report("pattern_counts_top", _COUNTED + " QUALIFY row_number() OVER (ORDER BY ifnull(lines, 0) DESC, pattern_id) <= 20")
def _(t):
    return r.pattern_counts(t["catalog"], t["logs"], limit=20)


@report("label_usage", f"SELECT label, count(*) AS pattern_count, ifnull(sum(lines), 0)::BIGINT AS log_count FROM {_USED} GROUP BY label")
def _(t):
    return r.label_usage(t["catalog"], t["logs"])


@report("manual_and_auto", f"""SELECT if(by_hand, 'manual', 'auto') AS pattern_type, count(*) AS pattern_count, ifnull(sum(lines), 0)::BIGINT AS log_count
  FROM (SELECT manual_regex_rule IS NOT NULL AS by_hand, lines FROM {_USED}) AS counted GROUP BY by_hand""")
def _(t):
    return r.manual_and_auto(t["catalog"], t["logs"])


@report("logs_of_pattern", f"""SELECT log_id, {ts_sql('ts')}, host, component, message, classification, is_known FROM <logs> WHERE pattern_id = 3
  ORDER BY <logs>.ts DESC, log_id LIMIT 100""")
def _(t):
    return _times(r.logs_of_pattern(t["logs"], 3), "ts")


@report("known_logs", """SELECT l.log_id, l.host, l.component, l.is_known, l.classification, p.pattern_id, p.regex_rule, p.manual_regex_rule, p.label AS pattern_label
  FROM <logs> l JOIN <catalog> p ON l.pattern_id = p.pattern_id WHERE l.is_known ORDER BY l.log_id LIMIT 10""")
def _(t):
    return r.known_logs(t["logs"], t["catalog"])


@report("labels_of_known", """SELECT pattern_id, label, severity, sample_message, total_count FROM <catalog>
  WHERE pattern_id IN (SELECT DISTINCT pattern_id FROM <logs> WHERE is_known AND pattern_id IS NOT NULL) QUALIFY row_number() OVER (ORDER BY total_count DESC, pattern_id) <= 20""")
def _(t):
    return r.labels_of_known(t["catalog"], t["logs"])


@report("labels_of_known_elsewhere", f"""SELECT pattern_id, label, severity, sample_message, total_count, host
  FROM (SELECT pattern_id, host FROM <logs> GROUP BY pattern_id, host) AS places JOIN <catalog> USING (pattern_id)
  SEMI JOIN (SELECT pattern_id FROM <logs> GROUP BY pattern_id HAVING bool_or(is_known)) AS met USING (pattern_id)
  WHERE host <> '{HOST}' QUALIFY row_number() OVER (ORDER BY total_count DESC, pattern_id, host) <= 20""")
def _(t):
    return r.labels_of_known_elsewhere(t["catalog"], t["logs"], HOST)


@report("abnormal_in_normal", f"""SELECT log_id, {ts_sql('picked.ts')}, host, picked.component, message, classification, picked.severity, anomaly_reason, pattern_id, sample_message
  FROM (SELECT * FROM <logs> WHERE classification = 'abnormal' AND pattern_id IN (SELECT pattern_id FROM <catalog> WHERE label = 'normal')
        ORDER BY ts DESC, log_id LIMIT 20) AS picked JOIN <catalog> USING (pattern_id)""")
def _(t):
    return _times(r.abnormal_in_normal(t["logs"], t["catalog"]), "ts")


@report("pattern_lookup", """SELECT pattern_id, manual_regex_rule, sample_message, label, severity, note, total_count FROM <catalog>
  WHERE sample_message LIKE '%volume%' OR manual_regex_rule LIKE '%volume%' ORDER BY pattern_id DESC LIMIT 5""")
def _(t):
    return r.pattern_lookup(t["catalog"], "volume")


@report("pattern_health", """SELECT pattern_id, count(*) AS total, count_if(is_known) AS known, count_if(NOT is_known) AS unknown,
  count_if(classification = 'abnormal') AS abnormal FROM <logs> WHERE pattern_id IS NOT NULL GROUP BY pattern_id""")
def _(t):
    return r.pattern_health(t["logs"])


@report("parameterised", """SELECT pattern_id, ifnull(manual_regex_rule, regex_rule) AS pattern, sample_message, note, has_params, if(has_params, 'Yes', 'No') AS has_parameters
  FROM <catalog>""")
def _(t):
    return r.parameterised(t["catalog"])


# The lines are found first; a pattern without a catalog row leaves its columns empty.
@report("logs_with_parameterised", """SELECT found.*, has_params, sample_message
  FROM (SELECT log_id, message, pattern_id FROM <logs> WHERE contains(message, 'GPU temp')) AS found
  LEFT JOIN (SELECT pattern_id, any_value(has_params) AS has_params, any_value(sample_message) AS sample_message FROM <catalog> GROUP BY pattern_id) AS kinds
  USING (pattern_id)""")
def _(t):
    return r.logs_with_parameterised(t["logs"], t["catalog"], "%GPU temp%")


@report("pattern_of_log", """SELECT classification, count(*) AS count FROM <logs>
  WHERE pattern_id = (SELECT pattern_id FROM <logs> WHERE log_id = 1) GROUP BY classification""")
def _(t):
    return r.pattern_of_log(t["logs"], 1)


@report("latest_logs", "SELECT log_id, host, classification, pattern_id, message FROM <logs> ORDER BY log_id DESC LIMIT 10")
def _(t):
    return r.latest_logs(t["logs"])


# --- rules and parameters ---------------------------------------------------------

@report("rules_with_usage", """SELECT ru.rule_id, ru.op, ru.severity_if_match, ru.message, count(l.log_id) AS pattern_logs FROM <rules> ru
  LEFT JOIN <logs> l USING (pattern_id) WHERE ru.pattern_id = 2 GROUP BY ALL""")
def _(t):
    used = r.logs_per_pattern(t["catalog"], t["logs"]).select("pattern_id", F.col("log_count").alias("pattern_logs"))
    return r.rules_of_pattern(t["rules"], 2).join(used, "pattern_id").select(
        "rule_id", "op", "severity_if_match", "message", "pattern_logs")


@report("active_rules", """SELECT active.*, sample_message
  FROM (SELECT pattern_id, any_value(sample_message) AS sample_message FROM <catalog> GROUP BY pattern_id) AS samples
  JOIN (SELECT rule_id, pattern_id, rule_type, field_name, op, threshold1, severity_if_match, message FROM <rules> WHERE is_active) AS active USING (pattern_id)""")
def _(t):
    return r.active_rule_list(t["rules"], t["catalog"])


@report("params_of_pattern", """SELECT lp.log_id, lp.param_name, lp.param_value_num, lp.param_value_text FROM <params> lp JOIN <logs> le USING (log_id)
  WHERE le.pattern_id = 2""")
def _(t):
    return r.params_of_pattern(None, t["rows"], 2)


def _with_param(more: str) -> str:
    """The ten latest lines of the pattern, then the value of each."""
    return f"""SELECT log_id, {ts_sql('ts')}, host, message, classification, severity, anomaly_reason, param_name, param_value_num
  FROM (SELECT * FROM <logs> WHERE pattern_id = 2{more} ORDER BY <logs>.ts DESC, log_id LIMIT 10) AS picked
  LEFT JOIN (SELECT * FROM <params> WHERE param_name = 'bandwidth') AS bandwidth USING (log_id)"""


@report("logs_with_param", _with_param(""))
def _(t):
    return _times(r.logs_with_param(t["rows"], 2, "bandwidth"), "ts")


@report("abnormal_with_param", _with_param(" AND classification = 'abnormal'"))
def _(t):
    return _times(r.logs_with_param(t["rows"], 2, "bandwidth", abnormal_only=True), "ts")


# The values decide first; the twenty latest lines are then taken by rank.
@report("abnormal_by_param", f"""SELECT log_id, {ts_sql('ts')}, host, component, classification, severity, anomaly_reason, message, param_value_num
  FROM (SELECT log_id, param_value_num FROM <params> WHERE param_name = 'bandwidth' AND param_value_num < 30) AS low
  JOIN (SELECT * FROM <logs> WHERE classification = 'abnormal') AS bad USING (log_id) QUALIFY row_number() OVER (ORDER BY log_id DESC) <= 20""")
def _(t):
    return _times(r.abnormal_by_param(t["rows"], None, "bandwidth", 30.0), "ts")


@report("param_statistics", """SELECT lp.param_name, count(*) AS count, min(lp.param_value_num) AS min_value, max(lp.param_value_num) AS max_value,
  round(avg(lp.param_value_num), 6) AS avg_value FROM <params> lp JOIN <logs> le USING (log_id) WHERE le.pattern_id = 2 GROUP BY lp.param_name""")
def _(t):
    return r.param_statistics(None, t["rows"], 2).withColumn("avg_value", F.round("avg_value", 6))


# Five lines are picked before their values are listed.
@report("latest_with_params", f"""SELECT log_id, {ts_sql('any_value(ts)', 'ts')}, any_value(host) AS host, any_value(message) AS message,
    any_value(classification) AS classification, any_value(is_known) AS is_known,
    string_agg(param_name || '=' || param_value_num, ', ' ORDER BY param_name) AS params
  FROM (SELECT * FROM <logs> WHERE pattern_id = 2 QUALIFY row_number() OVER (ORDER BY <logs>.ts DESC, log_id) <= 5) AS five
  LEFT JOIN <params> USING (log_id) GROUP BY log_id""")
def _(t):
    return _times(r.latest_with_params(t["rows"], 2), "ts")


# Values are gathered per line; a line without any keeps one row.
@report("params_for_message", """SELECT * EXCLUDE (held, value), value.name AS param_name, value.num AS param_value_num
  FROM (SELECT found.*, unnest(coalesce(held, [NULL])) AS value, held
        FROM (SELECT log_id, message, classification, severity, anomaly_reason FROM <logs> WHERE contains(message, 'GPU temp')) AS found
        LEFT JOIN (SELECT log_id, list({'name': param_name, 'num': param_value_num}) AS held FROM <params> GROUP BY log_id) AS gathered USING (log_id))""")
def _(t):
    return r.params_for_message(t["rows"], None, "%GPU temp%")


# --- alerts and triage ----------------------------------------------------------------

@report("abnormal_with_alerts", """SELECT le.log_id, le.message, le.classification, le.severity, le.anomaly_reason, coalesce(a.alert_id, -1) AS alert_id, a.alert_type, a.status
  FROM <logs> le LEFT JOIN <alerts> a ON le.log_id = a.log_id WHERE le.classification = 'abnormal'""")
def _(t):
    return r.abnormal_with_alerts(t["logs"], t["alerts"]).withColumn("alert_id", F.coalesce("alert_id", F.lit(-1)))


@report("latest_alerts", f"""SELECT a.alert_id, a.alert_type, a.status, {ts_sql('a.created_at')}, le.log_id, le.classification, le.severity, le.message
  FROM <alerts> a JOIN <logs> le ON a.log_id = le.log_id ORDER BY a.created_at DESC, a.alert_id DESC LIMIT 20""")
def _(t):
    return _times(r.latest_alerts(t["alerts"], t["logs"]), "created_at")


@report("alerts_by_type_and_status", "SELECT alert_type, status, min(alert_id) AS first_alert_id, count(*) AS count FROM <alerts> GROUP BY alert_type, status")
def _(t):
    return r.alerts_by_type_and_status(t["alerts"])


@report("triage_results", """SELECT s.log_id, l.message FROM scored s JOIN <logs> l USING (log_id) ORDER BY s.log_id LIMIT 10""")
def _(t):
    return r.triage_results(t["logs"], t["analyses"]).select("log_id", "message")


@report("triage_abnormal", """SELECT le.log_id, le.host, le.classification, le.severity, le.message FROM <logs> le JOIN scored aa USING (log_id)
  WHERE le.classification = 'abnormal'""")
def _(t):
    return r.triage_abnormal(t["logs"], t["analyses"])


@report("triage_patterns", "SELECT count(*) AS added_patterns FROM <catalog> WHERE note LIKE 'LLM自動追加%'")
def _(t):
    return r.triage_patterns(t["catalog"])


@report("remaining_unknown", "SELECT count(*) AS remaining_unknown FROM <logs> WHERE classification = 'unknown'")
def _(t):
    return r.remaining_unknown(t["logs"])
