"""The state tables of the workload as plain SQL, written from the row-wise description.

The SQL goes its own way where it can: one regex with capture groups for the
header, sentinels for the template, a pattern-by-line test for the matching.
"""

from __future__ import annotations

from logloom.workload.state import PATTERNS, RULE_ROWS

# Timestamps of the three runs.
FIRST_AT, SECOND_AT, TRIAGE_AT = "2024-02-01 00:00:00", "2024-02-02 00:00:00", "2024-02-03 00:00:00"

_HEADER = (
    r"^([0-9A-Za-z_]{3}[ \t]+[0-9]{1,2}[ \t]+[0-9]{2}:[0-9]{2}:[0-9]{2})[ \t]+([^ \t]+)[ \t]+([^ \t]+?):[ \t]+(.*)$"
)


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def _word(number: str) -> str:
    return f"translate(CAST({number} AS VARCHAR), '0123456789', 'abcdefghij')"


def _message(kind: str, names: tuple, seq: str, user: str, value: str, k: str) -> str:
    link, job, session, temp = (quoted(n) for n in names)
    number, code = f"printf('%.2f', {value})", f"lower(to_hex({seq}))"
    return f"""CASE {kind}
      WHEN {link} THEN '[    ' || {seq} || '.' || {user} || '] pci 0000:' || lower(to_hex({user})) || ':00.0: ' || {number}
        || ' Gb/s available link bandwidth, limited by ' || {k} || ' GT/s link at 0x' || {code}
      WHEN {job} THEN 'job ' || {_word(k)} || ' failed: code 0x' || {code} || ' after ' || {number} || ' s'
      WHEN {session} THEN 'session ' || {seq} || ' opened for user u' || {user} || ' (uid=' || {user} || ')'
      WHEN {temp} THEN 'GPU temp: ' || {number} || '°C on card ' || {k}
      ELSE 'volume ' || {_word(user)} || ' state {{"k": ' || {k} || '}} ok' END"""


def _component(kind: str, names: tuple, user: str) -> str:
    link, job, session, temp = (quoted(n) for n in names)
    return (f"CASE WHEN {kind} IN ({link}, {temp}) THEN 'kernel' WHEN {kind} = {job} THEN 'node-runner' "
            f"WHEN {kind} = {session} THEN 'sshd[' || {user} || ']' ELSE 'multipath' END")


def _date(ts: str) -> str:
    return f"strftime({ts}, '%b') || ' ' || lpad(CAST(day({ts}) AS VARCHAR), 2, ' ') || ' ' || strftime({ts}, '%H:%M:%S')"


def _host(user: str) -> str:
    return f"'10.0.0.' || CAST({user} % 16 + 100 AS VARCHAR)"


_EVENT_KINDS = ("view", "error", "click", "signup")
_ORDER_KINDS = ("2-HIGH", "1-URGENT", "5-LOW", "3-MEDIUM")


def line_ctes() -> list[str]:
    """``ev_lines`` and ``or_lines``: value, source_file, line_seq."""
    return [
        f"""ev_parts AS (
  SELECT event_id AS line_seq, k, {_date('ts')} AS day,
    ' ' || {_host('user_id')} || ' ' || {_component('event_type', _EVENT_KINDS, 'user_id')} || ': ' || msg AS rest, msg
  FROM (SELECT *, {_message('event_type', _EVENT_KINDS, 'event_id', 'user_id', 'value', 'k')} AS msg
        FROM (SELECT *, regexp_extract(props, '[0-9]+') AS k FROM events)))""",
        """ev_lines AS (
  SELECT line_seq, 'events.log' AS source_file,
    CASE k WHEN '7' THEN 'free text ' || msg WHEN '13' THEN 'Feb 31 01:02:03' || rest
      WHEN '21' THEN chr(9) || day || rest || '  ' WHEN '29' THEN ''
      WHEN '33' THEN 'Xyz  1 01:02:03' || rest ELSE day || rest END AS value
  FROM ev_parts)""",
        f"""or_lines AS (
  SELECT o_orderkey AS line_seq, 'orders.log' AS source_file,
    {_date('o_orderdate')} || ' ' || {_host('o_custkey')} || ' '
    || {_component('o_orderpriority', _ORDER_KINDS, 'o_custkey')} || ': '
    || {_message('o_orderpriority', _ORDER_KINDS, 'o_orderkey', 'o_custkey', 'o_totalprice', 'CAST(o_custkey AS VARCHAR)')} AS value
  FROM orders)""",
    ]


def template_sql(message: str) -> str:
    """Template of a message: sentinels for hex, digits and blanks, escape, put the classes in."""
    hexed = f"regexp_replace({message}, '0[xX][0-9A-Fa-f]+', chr(57344), 'g')"
    blanks = f"regexp_replace({hexed}, '[ \\t\\n\\r\\f\\x0B]+', chr(57345), 'g')"
    digits = f"regexp_replace({blanks}, '[0-9]+', chr(57346), 'g')"
    escaped = f"regexp_replace({digits}, '([()\\[\\]{{}}?*+\\-|^$\\\\.&~#])', '\\\\\\1', 'g')"
    return (f"replace(replace(replace({escaped}, chr(57344), '0x[0-9A-Fa-f]+'), chr(57345), '\\s+'), chr(57346), '\\d+')")


def parse_cte(name: str, source: str, as_of: str) -> str:
    h = quoted(_HEADER)
    return f"""{name} AS (
  SELECT line_seq, source_file, raw_line, ok AS parse_ok,
    CASE WHEN ok THEN regexp_extract(raw_line, {h}, 2) END AS host,
    CASE WHEN ok THEN regexp_extract(raw_line, {h}, 3) END AS component,
    CASE WHEN ok THEN regexp_extract(raw_line, {h}, 4) ELSE raw_line END AS message,
    coalesce(CASE WHEN ok THEN try_cast('2024-' || lpad(CAST(nullif(list_position(
        ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], raw_line[1:3]), 0) AS VARCHAR), 2, '0')
        || '-' || lpad(trim(raw_line[5:6]), 2, '0') || ' ' || raw_line[8:15] AS TIMESTAMP) END, TIMESTAMP '{as_of}') AS ts
  FROM (SELECT *, regexp_full_match(raw_line, {h}) AS ok
        FROM (SELECT line_seq, source_file, trim(value, ' ' || chr(9)) AS raw_line FROM {source})))"""


def seed_ctes() -> list[str]:
    patterns = ",\n    ".join(
        f"({i}, NULL, {quoted(rx)}, {quoted(sample)}, {quoted(label)}, {quoted(sev)}, {quoted(comp)}, {quoted(has)}, 0)"
        for i, rx, sample, label, sev, comp, has in PATTERNS)
    rules = ",\n    ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in RULE_ROWS)
    valid = ",\n    ".join(f"({i}, {quoted(rx.replace('(?P<', '(?P<'))})" for i, rx, *_ in PATTERNS if i != 1)
    return [
        f"""c0 AS (
  SELECT CAST(a AS BIGINT) AS pattern_id, CAST(b AS VARCHAR) AS regex_rule, c AS manual_regex_rule, d AS sample_message,
    e AS label, f AS severity, CAST(NULL AS VARCHAR) AS note, g AS component, h AS has_params,
    TIMESTAMP '{FIRST_AT}' AS first_seen_at, TIMESTAMP '{FIRST_AT}' AS last_seen_at, CAST(i AS BIGINT) AS total_count
  FROM (VALUES
    {patterns}) AS v(a, b, c, d, e, f, g, h, i))""",
        f"""rules AS (
  SELECT CAST(a AS BIGINT) AS rule_id, CAST(b AS BIGINT) AS pattern_id, c AS rule_type, d AS field_name, e AS op,
    CAST(f AS DOUBLE) AS threshold1, CAST(g AS DOUBLE) AS threshold2, h AS search_text, i AS severity_if_match,
    j AS is_abnormal_if_match, k AS message, l AS is_active
  FROM (VALUES
    {rules}) AS v(a, b, c, d, e, f, g, h, i, j, k, l))""",
        f"""manual_regexes AS (SELECT CAST(a AS BIGINT) AS pattern_id, b AS regex FROM (VALUES
    {valid}) AS v(a, b))""",
    ]


def _number(text: str) -> str:
    return f"try_cast(nullif(regexp_extract({text}, '^([+-]?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE)"


def _groups() -> list[tuple[int, str, str, int]]:
    import re

    found = []
    for i, rx, *_ in PATTERNS[1:]:
        for name, index in re.compile(rx).groupindex.items():
            found.append((i, name, rx, index))
    return found


def params_sql(rows: str) -> str:
    """Long parameters of known rows (log_id, pattern_id, message)."""
    parts = [
        f"SELECT log_id, {quoted(name)} AS param_name, regexp_extract(message, {quoted(rx)}, {index}) AS param_value_text "
        f"FROM {rows} WHERE pattern_id = {i} AND is_known"
        for i, name, rx, index in _groups()
    ]
    body = "\n  UNION ALL ".join(parts)
    return (f"SELECT log_id, param_name, {_number('param_value_text')} AS param_value_num, param_value_text\n"
            f"  FROM ({body}) WHERE param_value_text <> ''")


def hits_sql(rows: str, params: str) -> str:
    """All (log_id, rule_id) pairs where an active rule holds, each rule spelled out."""
    def num(field: str) -> str:
        return f"(SELECT log_id, param_value_num AS v, param_value_text AS t FROM {params} WHERE param_name = '{field}')"

    def rule(rule_id: int, pattern: int, condition: str, field: str | None = None) -> str:
        join = f" LEFT JOIN {num(field)} p USING (log_id)" if field else ""
        return f"SELECT l.log_id, {rule_id} AS rule_id FROM {rows} l{join} WHERE l.pattern_id = {pattern} AND l.is_known AND ({condition})"

    return "\n  UNION ALL ".join([
        rule(1, 2, "p.v <= 50.0", "bandwidth"), rule(2, 2, "p.v <= 30.0", "bandwidth"),
        rule(3, 2, "p.v BETWEEN 100.0 AND 200.0", "bandwidth"), rule(4, 3, "p.v > 80.0", "temp"),
        rule(5, 3, "p.v < 5.0 OR p.v > 60.0", "temp"),
        rule(6, 4, "contains(coalesce(CASE WHEN p.v IS NOT NULL THEN CAST(p.v AS VARCHAR) END, p.t), '13')", "user"),
        rule(7, 4, r"regexp_matches(l.message, 'user u[0-9]*7 ')"),
        rule(8, 5, "contains(l.message, 'ab')"),
        rule(9, 6, "regexp_matches(l.message, 'code 0x[0-9a-f]*f ')"),
        rule(11, 4, "p.v >= 140.0", "uid"),
        rule(13, 4, "contains(CAST(p.v AS VARCHAR), '4.0')", "uid"),
    ])


def batch_ctes(p: str, lines: str, catalog: str, first_log_id: str, as_of: str) -> list[str]:
    """CTEs ``{p}_logs``, ``{p}_params``, ``{p}_catalog`` of a batch ingested into ``catalog``."""
    return [
        parse_cte(f"{p}_parsed", lines, as_of),
        f"""{p}_match AS (
  SELECT line_seq, min(pattern_id) AS manual_id FROM {p}_parsed, manual_regexes
  WHERE regexp_matches(message, regex) GROUP BY line_seq)""",
        f"""{p}_abs AS (
  SELECT a.*, manual_id, CASE WHEN manual_id IS NULL AND message <> '' THEN {template_sql('message')} END AS template
  FROM {p}_parsed a LEFT JOIN {p}_match USING (line_seq))""",
        f"""{p}_tpl AS (
  SELECT template, count(*) AS n, min(line_seq) AS first_seq, arg_min(message, line_seq) AS sample
  FROM {p}_abs WHERE template IS NOT NULL GROUP BY template)""",
        f"""{p}_new AS (
  SELECT template, n, first_seq, sample,
    (SELECT max(pattern_id) FROM {catalog}) + row_number() OVER (ORDER BY first_seq) AS new_id
  FROM {p}_tpl t WHERE NOT EXISTS (SELECT 1 FROM {catalog} c WHERE c.regex_rule = t.template OR c.manual_regex_rule = t.template))""",
        f"""{p}_base AS (
  SELECT {first_log_id} + a.line_seq AS log_id, a.*, coalesce(manual_id, c.pattern_id, w.new_id) AS pattern_id,
    coalesce(manual_id, c.pattern_id, w.new_id) IS NOT NULL AND NOT coalesce(w.first_seq = a.line_seq, FALSE) AS is_known,
    w.new_id
  FROM {p}_abs a
  LEFT JOIN {catalog} c ON coalesce(c.regex_rule, c.manual_regex_rule) = a.template
  LEFT JOIN {p}_new w ON w.template = a.template)""",
        f"""{p}_params AS ({params_sql(f'{p}_base')})""",
        f"""{p}_hits AS ({hits_sql(f'{p}_base', f'{p}_params')})""",
        f"""{p}_first AS (
  SELECT h.log_id, r.severity_if_match AS hit_severity, coalesce(nullif(r.message, ''), 'Rule ' || r.rule_id || ' matched') AS reason
  FROM (SELECT log_id, min(rule_id) AS rule_id FROM {p}_hits GROUP BY log_id) h JOIN rules r USING (rule_id))""",
        f"""{p}_logs AS (
  SELECT b.log_id, b.ts, b.host, b.component, b.raw_line, b.message, b.pattern_id, b.is_known, FALSE AS is_manual_mapped,
    CASE WHEN f.log_id IS NOT NULL THEN 'abnormal' WHEN NOT b.is_known THEN 'unknown' WHEN b.new_id IS NOT NULL THEN 'normal'
      WHEN c.label = 'unknown' THEN 'normal' ELSE c.label END AS classification,
    CASE WHEN f.log_id IS NOT NULL THEN f.hit_severity WHEN b.is_known THEN c.severity END AS severity,
    f.reason AS anomaly_reason, b.source_file, b.line_seq
  FROM {p}_base b LEFT JOIN {catalog} c ON c.pattern_id = b.pattern_id LEFT JOIN {p}_first f ON f.log_id = b.log_id)""",
        f"""{p}_catalog AS (
  SELECT c.pattern_id, c.regex_rule, c.manual_regex_rule, c.sample_message, c.label, c.severity, c.note, c.component, c.has_params,
    c.first_seen_at, CASE WHEN t.n IS NULL THEN c.last_seen_at ELSE TIMESTAMP '{as_of}' END AS last_seen_at,
    c.total_count + coalesce(t.n, 0) AS total_count
  FROM {catalog} c LEFT JOIN {p}_tpl t ON t.template = coalesce(c.regex_rule, c.manual_regex_rule)
  UNION ALL
  SELECT new_id, template, NULL, sample, 'normal', NULL, NULL, NULL, FALSE, TIMESTAMP '{as_of}', TIMESTAMP '{as_of}', n FROM {p}_new)""",
    ]


def alerts_cte(name: str, logs: str, last_id: str, as_of: str) -> str:
    return f"""{name} AS (
  SELECT {last_id} + row_number() OVER (ORDER BY log_id) AS alert_id, log_id, classification AS alert_type, 'slack' AS channel,
    'pending' AS status, CAST(NULL AS VARCHAR) AS message, TIMESTAMP '{as_of}' AS created_at
  FROM {logs} WHERE classification IN ('abnormal', 'unknown'))"""


def first_ctes() -> list[str]:
    return line_ctes() + seed_ctes() + batch_ctes("b1", "ev_lines", "c0", "1", FIRST_AT) + [
        alerts_cte("b1_alerts", "b1_logs", "0", FIRST_AT)]


def state_ctes() -> list[str]:
    """``logs``, ``params``, ``catalog``, ``alerts`` after both batches, with ``rules``."""
    start = "(SELECT max(log_id) + 1 FROM b1_logs)"
    return first_ctes() + batch_ctes("b2", "or_lines", "b1_catalog", start, SECOND_AT) + [
        alerts_cte("b2_alerts", "b2_logs", "(SELECT coalesce(max(alert_id), 0) FROM b1_alerts)", SECOND_AT),
        "logs AS (SELECT * FROM b1_logs UNION ALL SELECT * FROM b2_logs)",
        "params AS (SELECT * FROM b1_params UNION ALL SELECT * FROM b2_params)",
        "alerts AS (SELECT * FROM b1_alerts UNION ALL SELECT * FROM b2_alerts)",
        "catalog AS (SELECT * FROM b2_catalog)",
    ]


def triage_ctes() -> list[str]:
    """Tables after the triage: ``t_logs``, ``t_catalog``, ``t_alerts``, ``t_new_alerts``, ``scored``."""
    return state_ctes() + [
        """answers AS (
  SELECT doc_id AS log_id, CASE WHEN toxic = 1 THEN 'abnormal' WHEN quality = 1 THEN 'normal' ELSE 'unknown' END AS label,
    CASE WHEN toxic = 1 THEN 'critical' ELSE 'unknown' END AS severity,
    CASE WHEN toxic = 1 THEN 'toxic ' || doc_id WHEN quality = 1 THEN 'fine'
      ELSE 'LLM analysis failed: not a JSON object' END AS reason,
    CASE WHEN toxic = 1 OR quality <> 1 THEN '' WHEN contains(CAST(doc_id AS VARCHAR), '7') THEN '('
      WHEN contains(CAST(doc_id AS VARCHAR), '3') THEN 'suggested ' || doc_id || ' [0-9]+' ELSE '' END AS suggestion
  FROM labels)""",
        f"""scored AS (
  SELECT l.log_id, l.ts, l.host, l.component, l.message, coalesce(a.label, 'unknown') AS label,
    coalesce(a.severity, 'unknown') AS severity, coalesce(a.reason, 'LLM analysis failed: no answer') AS reason,
    coalesce(a.suggestion, '') AS suggestion, coalesce(a.label, '') = 'abnormal' AS is_abnormal
  FROM logs l LEFT JOIN answers a USING (log_id) WHERE NOT l.is_known)""",
        f"""wanted AS (
  SELECT *, CASE WHEN suggestion <> '' THEN suggestion ELSE {template_sql('message')} END AS regex
  FROM scored WHERE label = 'normal' AND suggestion <> '(')""",
        """added AS (
  SELECT *, (SELECT max(pattern_id) FROM catalog) + row_number() OVER (ORDER BY log_id) AS pattern_id
  FROM (SELECT regex, min(log_id) AS log_id FROM wanted w
        WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.regex_rule = w.regex OR c.manual_regex_rule = w.regex) GROUP BY regex))""",
        """mapped AS (
  SELECT w.log_id, w.label, w.severity, coalesce(c.pattern_id, a.pattern_id) AS pattern_id
  FROM wanted w LEFT JOIN catalog c ON coalesce(c.regex_rule, c.manual_regex_rule) = w.regex LEFT JOIN added a ON a.regex = w.regex)""",
        """t_logs AS (
  SELECT l.log_id, l.ts, l.host, l.component, l.raw_line, l.message, coalesce(m.pattern_id, l.pattern_id) AS pattern_id,
    l.is_known OR m.log_id IS NOT NULL AS is_known, m.log_id IS NOT NULL AS is_manual_mapped,
    CASE WHEN s.label = 'abnormal' THEN 'abnormal' WHEN m.log_id IS NOT NULL THEN 'normal' ELSE l.classification END AS classification,
    CASE WHEN s.label = 'abnormal' THEN s.severity WHEN m.log_id IS NOT NULL THEN m.severity ELSE l.severity END AS severity,
    CASE WHEN s.label = 'abnormal' THEN s.reason ELSE l.anomaly_reason END AS anomaly_reason
  FROM logs l LEFT JOIN scored s USING (log_id) LEFT JOIN mapped m USING (log_id))""",
        f"""t_catalog AS (
  SELECT * FROM catalog UNION ALL
  SELECT a.pattern_id, NULL, a.regex, w.message, 'normal', 'info',
    CASE WHEN w.suggestion <> '' THEN 'LLM自動追加: ' ELSE 'LLM自動追加（自動生成パターン）: ' END || w.reason,
    w.component, FALSE, TIMESTAMP '{TRIAGE_AT}', TIMESTAMP '{TRIAGE_AT}', 0
  FROM added a JOIN wanted w USING (log_id))""",
        f"""t_new_alerts AS (
  SELECT (SELECT max(alert_id) FROM alerts) + row_number() OVER (ORDER BY log_id) AS alert_id, log_id, 'abnormal' AS alert_type,
    'slack' AS channel, 'pending' AS status, CAST(NULL AS VARCHAR) AS message, TIMESTAMP '{TRIAGE_AT}' AS created_at
  FROM scored WHERE label = 'abnormal')""",
        "t_alerts AS (SELECT * FROM alerts UNION ALL SELECT * FROM t_new_alerts)",
    ]


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
