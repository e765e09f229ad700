"""Parsing, templates, matching, ingest, parameters, rules, deduplication."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from logloom.functions.text import wall_time
from logloom.functions.regexes import group_names, has_named_groups
from logloom.functions.syslog import parse_lines
from logloom.functions.templates import fits_own_template, pattern_fits, template_of
from logloom.operators import dedup, matching, params as params_ops, rules as rules_ops
from logloom.operators.numbering import number_rows
from logloom.plans.ingest import abstract_lines, count_templates, ingest_stats, resolve_templates
from logloom.session import stage, staging_path
from logloom.sources.lines import read_lines
from logloom.workload import oracle_tables as o
from logloom.workload.lines import FIRST_RUN, YEAR, event_lines, order_lines, shipment_lines, table, text_lines
from logloom.workload.registry import query, ts_sql, ts_text
from logloom.workload.state import (
    after_first, first_batch, second_batch, seed_catalog, seed_rules, state,
)

_EV = o.line_ctes()[:2]
_TEXT_LINES = """text_lines AS (
  SELECT 'documents' AS origin, doc_id AS id, unnest(string_split(text, chr(10))) AS message FROM documents
  UNION ALL
  SELECT 'conversations', conv_id, unnest(string_split(text, chr(10))) FROM conversations)"""


# --- parsing -------------------------------------------------------------------

@query("parse_lines", o.with_ctes(
    _EV + [o.parse_cte("parsed", "ev_lines", o.FIRST_AT)],
    f"SELECT line_seq, parse_ok, host, component, message, raw_line, {ts_sql('ts')} FROM parsed"))
def _(spark, sf):
    parsed = parse_lines(event_lines(spark, sf), YEAR, FIRST_RUN)
    return parsed.select("line_seq", "parse_ok", "host", "component", "message", "raw_line", ts_text("ts"))


@query("syslog_times", o.with_ctes(
    o.line_ctes() + ["every AS (SELECT * FROM ev_lines UNION ALL SELECT * FROM or_lines)",
                     o.parse_cte("parsed", "every", o.FIRST_AT)],
    f"SELECT {ts_sql('ts')}, count(*) AS n FROM parsed GROUP BY ts"))
def _(spark, sf):
    parsed = parse_lines(event_lines(spark, sf).unionByName(order_lines(spark, sf)), YEAR, FIRST_RUN)
    return parsed.groupBy("ts").agg(F.count("*").alias("n")).select(ts_text("ts"), "n")


@query("unparsed_lines", o.with_ctes(
    _EV + [o.parse_cte("parsed", "ev_lines", o.FIRST_AT)],
    "SELECT line_seq, message FROM parsed WHERE NOT parse_ok"))
def _(spark, sf):
    return parse_lines(event_lines(spark, sf), YEAR, FIRST_RUN).where(~F.col("parse_ok")).select("line_seq", "message")


# --- templates -------------------------------------------------------------------

@query("templates_of_text", o.with_ctes(
    [_TEXT_LINES], f"SELECT origin, {o.template_sql('message')} AS template, count(*) AS n FROM text_lines GROUP BY 1, 2"))
def _(spark, sf):
    lines = text_lines(spark, sf).withColumn("template", template_of(F.col("message")))
    return lines.groupBy("origin", "template").agg(F.count("*").alias("n"))


@query("templates_of_pages", f"SELECT page_id, {o.template_sql('html')} AS template FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", template_of(F.col("html")).alias("template"))


@query("template_fits", o.with_ctes(
    [_TEXT_LINES],
    f"""SELECT origin, count(*) AS lines, count_if(regexp_full_match(message, {o.template_sql('message')})) AS fitting
    FROM text_lines GROUP BY origin"""))
def _(spark, sf):
    message = F.col("message")
    return text_lines(spark, sf).groupBy("origin").agg(
        F.count("*").alias("lines"), F.count_if(fits_own_template(message)).alias("fitting"))


@query("template_misfits", o.with_ctes(
    _EV + [o.parse_cte("parsed", "ev_lines", o.FIRST_AT)],
    f"""SELECT line_seq, message FROM (SELECT line_seq, upper(message) AS message FROM parsed)
    WHERE NOT regexp_full_match(message, {o.template_sql('message')})"""))
def _(spark, sf):
    parsed = parse_lines(event_lines(spark, sf), YEAR, FIRST_RUN).select("line_seq", F.upper("message").alias("message"))
    return parsed.where(~fits_own_template(F.col("message")))


@query("catalog_fits", o.with_ctes(
    o.state_ctes(),
    """SELECT pattern_id, pattern_id <> 1 AND regexp_full_match(sample_message,
      CASE WHEN pattern_id = 1 THEN '' ELSE coalesce(regex_rule, manual_regex_rule) END) AS fits FROM catalog"""))
def _(spark, sf):
    text = F.coalesce("regex_rule", "manual_regex_rule")
    return state(spark, sf)["catalog"].select("pattern_id", pattern_fits(text, F.col("sample_message")).alias("fits"))


@query("template_counts", o.with_ctes(o.first_ctes(), "SELECT template, n, first_seq FROM b1_tpl"))
def _(spark, sf):
    patterns = matching.manual_patterns(seed_catalog(spark))
    return count_templates(abstract_lines(event_lines(spark, sf), patterns, FIRST_RUN, YEAR))


@query("template_lookup", o.with_ctes(
    o.state_ctes(),
    """SELECT t.template, t.n, t.first_seq, coalesce(c.pattern_id, w.new_id) AS template_id, w.new_id IS NOT NULL AS is_new
    FROM b2_tpl t LEFT JOIN b1_catalog c ON coalesce(c.regex_rule, c.manual_regex_rule) = t.template
    LEFT JOIN b2_new w ON w.template = t.template"""))
def _(spark, sf):
    catalog = after_first(spark, sf)["catalog"]
    lines = abstract_lines(order_lines(spark, sf), matching.manual_patterns(catalog), FIRST_RUN, YEAR)
    counted = stage(count_templates(lines), "lookup-counts")
    return resolve_templates(counted, catalog).select("template", "n", "first_seq", "template_id", "is_new")


# --- matching ----------------------------------------------------------------------

@query("manual_match", o.with_ctes(
    o.line_ctes() + o.seed_ctes() + [
        "every AS (SELECT * FROM ev_lines UNION ALL SELECT * FROM or_lines)", o.parse_cte("parsed", "every", o.FIRST_AT)],
    """SELECT source_file, line_seq, coalesce(min(pattern_id), -1) AS manual_id FROM parsed
    LEFT JOIN manual_regexes ON regexp_matches(message, regex) GROUP BY 1, 2"""))
def _(spark, sf):
    patterns = matching.manual_patterns(seed_catalog(spark))
    parsed = parse_lines(event_lines(spark, sf).unionByName(order_lines(spark, sf)), YEAR, FIRST_RUN)
    found = F.coalesce(matching.match_id(F.col("message"), patterns), F.lit(-1))
    return parsed.select("source_file", "line_seq", found.alias("manual_id"))


@query("component_match", o.with_ctes(
    o.state_ctes(),
    r"""SELECT l.log_id, m.pattern_id AS matched_id, c.severity AS matched_severity,
      CASE WHEN m.pattern_id = 3 THEN regexp_extract(l.message, 'temp:\s+([0-9]+\.?[0-9]*)', 1)
           WHEN m.pattern_id = 4 THEN regexp_extract(l.message, 'user (u[0-9]+)', 1) ELSE '' END AS shown
    FROM logs l JOIN (SELECT log_id, min(r.pattern_id) AS pattern_id FROM logs, manual_regexes r JOIN c0 USING (pattern_id)
      WHERE regexp_matches(logs.message, regex) AND (c0.component IS NULL OR c0.component = logs.component) GROUP BY 1) m USING (log_id)
    JOIN c0 c ON c.pattern_id = m.pattern_id"""))
def _(spark, sf):
    patterns = matching.manual_patterns(seed_catalog(spark))
    found = matching.match_by_component(state(spark, sf)["logs"], patterns).where("matched_id is not null")
    group = lambda name: F.try_element_at("matched_groups", F.lit(name))
    return found.select("log_id", "matched_id", "matched_severity",
                        F.coalesce(group("temp"), group("user"), F.lit("")).alias("shown"))


@query("update_logs", o.with_ctes(
    o.state_ctes(),
    """SELECT l.log_id, CASE WHEN b.doc_id IS NOT NULL AND b.quality = 1 THEN 2 ELSE coalesce(l.pattern_id, -1) END AS pattern_id,
      CASE WHEN b.doc_id IS NOT NULL THEN b.quality = 1 ELSE l.is_known END AS is_known,
      CASE WHEN b.doc_id IS NOT NULL THEN 'abnormal' ELSE l.classification END AS classification,
      CASE WHEN b.doc_id IS NOT NULL THEN 'warning' ELSE l.severity END AS severity
    FROM logs l LEFT JOIN labels b ON b.doc_id = l.log_id"""))
def _(spark, sf):
    updates = table(spark, sf, "labels").select(
        F.col("doc_id").alias("log_id"), F.when(F.col("quality") == 1, F.lit(2).cast("bigint")).alias("pattern_id"),
        (F.col("quality") == 1).alias("is_known"), F.lit("abnormal").alias("classification"), F.lit("warning").alias("severity"))
    return matching.update_logs(state(spark, sf)["logs"], updates).select(
        "log_id", F.coalesce("pattern_id", F.lit(-1)).alias("pattern_id"), "is_known", "classification", "severity")


# --- some hundred patterns and rules -------------------------------------------------

# One pattern for each pair of brand and size class (of twelve) in ``part``, and a rule for each.

def _pair_catalog(spark, sf):
    pairs = table(spark, sf, "part").select("p_brand", (F.col("p_size") % 12).alias("p_size")).distinct()
    numbered = number_rows(pairs.withColumn("place", F.expr("bigint(substr(p_brand, 7))") * 1000 + F.col("p_size")), "place", 0, "pattern_id")
    regex = F.concat(F.lit(r"\bbrand\s"), F.col("p_brand"), F.lit(r"\b\ssize\s"), F.col("p_size"), F.lit(r"\s+costs (?P<price>\d+\.\d+)"))
    return numbered.select("pattern_id", regex.alias("manual_regex_rule"), F.lit("normal").alias("label"),
                           F.when(F.col("pattern_id") % 2 == 0, "info").otherwise("warning").alias("severity"), F.lit(None).cast("string").alias("component"))


def _part_lines(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat(
        F.lit("part "), F.col("p_partkey"), F.lit(" brand "), F.col("p_brand"), F.lit("\u00a0size "), F.col("p_size") % 12,
        F.lit("  costs "), F.format_string("%.2f", "p_retailprice"), F.lit(" each")).alias("message"))


_PAIR_IDS = """ids AS (SELECT p_brand, p_size, row_number() OVER (ORDER BY CAST(substr(p_brand, 7) AS BIGINT) * 1000 + p_size) AS pattern_id
  FROM (SELECT DISTINCT p_brand, p_size % 12 AS p_size FROM part)),
parts AS (SELECT p_partkey, p_brand, p_size % 12 AS p_size, p_retailprice FROM part)"""


@query("manual_match_many", f"WITH {_PAIR_IDS} SELECT p_partkey, pattern_id FROM parts JOIN ids USING (p_brand, p_size)")
def _(spark, sf):
    patterns = matching.manual_patterns(_pair_catalog(spark, sf))
    return _part_lines(spark, sf).select("p_partkey", matching.match_id(F.col("message"), patterns).alias("pattern_id"))


@query("rules_many", f"""WITH {_PAIR_IDS} SELECT p_partkey, CASE WHEN pattern_id % 3 = 0 THEN 'critical' ELSE 'warning' END AS severity,
  'price over ' || pattern_id AS reason FROM parts JOIN ids USING (p_brand, p_size) WHERE round(p_retailprice, 2) > 900 + pattern_id % 100""")
def _(spark, sf):
    catalog = stage(_pair_catalog(spark, sf), "catalog-many")
    patterns = matching.manual_patterns(catalog)
    none = F.lit(None)
    rules = catalog.select(
        F.col("pattern_id").alias("rule_id"), "pattern_id", F.lit("threshold").alias("rule_type"), F.lit("price").alias("field_name"), F.lit(">").alias("op"),
        (F.lit(900.0) + F.col("pattern_id") % 100).alias("threshold1"), none.cast("double").alias("threshold2"), none.cast("string").alias("search_text"),
        F.when(F.col("pattern_id") % 3 == 0, "critical").otherwise("warning").alias("severity_if_match"), F.lit(True).alias("is_abnormal_if_match"),
        F.concat(F.lit("price over "), F.col("pattern_id")).alias("message"), F.lit(True).alias("is_active"))
    lines = _part_lines(spark, sf).withColumn("pattern_id", matching.match_id(F.col("message"), patterns))
    # Rows and rules are stored before they are judged, as ingest does.
    with_params = stage(lines.withColumn("params", params_ops.params_of(F.col("message"), F.col("pattern_id"), patterns)), "rows-many")
    judged = rules_ops.judge(with_params, stage(rules, "rules-many")).where("verdict is not null")
    return judged.select("p_partkey", "verdict.severity", "verdict.reason")


# Some thousand patterns: one for each brand, size and class of key in ``part``; lines of ``lineitem``.

_KIND = "concat_ws('/', p_brand, CAST(p_size AS STRING), CAST(p_partkey % 3 AS STRING))"
_KIND_SQL = _KIND.replace("STRING", "VARCHAR")


def _kind_catalog(spark, sf):
    kinds = table(spark, sf, "part").groupBy(F.expr(_KIND).alias("kind")).agg(F.min("p_partkey").alias("place"))
    regex = F.concat(F.lit(r"\bof kind "), F.col("kind"), F.lit(r";\s+qty (?P<qty>\d+)\s(?:left|gone)"))
    return number_rows(kinds, "place", 0, "pattern_id").select(
        "pattern_id", regex.alias("manual_regex_rule"), F.lit("normal").alias("label"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("component"))


def _kind_lines(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(_KIND).alias("kind"))
    lines = table(spark, sf, "lineitem").join(parts, "l_partkey")
    return lines.select("l_orderkey", "l_linenumber", F.concat(
        F.lit("line "), F.col("l_linenumber"), F.lit(" of kind "), F.col("kind"), F.lit(";  qty "), F.col("l_quantity").cast("bigint"),
        F.when(F.col("l_returnflag") == "R", " back").otherwise(" gone")).alias("message"))


@query("manual_match_thousands", f"""WITH kinds AS (SELECT {_KIND_SQL} AS kind, p_partkey FROM part),
ids AS (SELECT kind, row_number() OVER (ORDER BY min(p_partkey)) AS pattern_id FROM kinds GROUP BY kind)
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN pattern_id END AS pattern_id, CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty
FROM lineitem JOIN kinds ON p_partkey = l_partkey JOIN ids USING (kind)""")
def _(spark, sf):
    patterns = matching.manual_patterns(_kind_catalog(spark, sf))
    lines = _kind_lines(spark, sf).withColumn("pattern_id", matching.match_id(F.col("message"), patterns))
    return lines.select("l_orderkey", "l_linenumber", "pattern_id", params_ops.group_texts(F.col("message"), F.col("pattern_id"), patterns)["qty"].alias("qty"))


# --- text files -------------------------------------------------------------------------

@query("read_lines", """SELECT row_number() OVER (ORDER BY event_id) - 1 AS line_seq, event_id || ' ' || event_type || ' ' || user_id AS value FROM events""")
def _(spark, sf):
    """The event table written as text files in order, and read back with dense line numbers."""
    events = table(spark, sf, "events")
    path = staging_path(spark, "event-text")
    lines = events.select("event_id", F.concat_ws(" ", "event_id", "event_type", "user_id").alias("value"))
    lines.repartitionByRange(16, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return read_lines(spark, [path]).select("line_seq", "value")


# --- ingest --------------------------------------------------------------------------

_LOG_COLUMNS = ("log_id", "host", "component", "raw_line", "message", "is_known", "is_manual_mapped", "classification",
                "severity", "anomaly_reason", "source_file", "line_seq")


def _logs(logs):
    return logs.select(*_LOG_COLUMNS, F.coalesce("pattern_id", F.lit(-1)).alias("pattern_id"), ts_text("ts"))


_LOGS_SQL = ", ".join(_LOG_COLUMNS) + f", coalesce(pattern_id, -1) AS pattern_id, {ts_sql('ts')}"


@query("ingest_logs", o.with_ctes(o.first_ctes(), f"SELECT {_LOGS_SQL} FROM b1_logs"))
def _(spark, sf):
    return _logs(first_batch(spark, sf).logs)


@query("ingest_next_logs", o.with_ctes(o.state_ctes(), f"SELECT {_LOGS_SQL} FROM b2_logs"))
def _(spark, sf):
    return _logs(second_batch(spark, sf).logs)


@query("ingest_params", o.with_ctes(o.first_ctes(), "SELECT log_id, param_name, param_value_num, param_value_text FROM b1_params"))
def _(spark, sf):
    return after_first(spark, sf)["params"]


_CATALOG_COLUMNS = ("pattern_id", "regex_rule", "manual_regex_rule", "sample_message", "label", "severity", "note",
                    "component", "has_params", "total_count")


def _catalog(catalog):
    return catalog.select(*_CATALOG_COLUMNS, ts_text("first_seen_at"), ts_text("last_seen_at"))


_CATALOG_SQL = ", ".join(_CATALOG_COLUMNS) + f", {ts_sql('first_seen_at')}, {ts_sql('last_seen_at')}"


@query("ingest_catalog", o.with_ctes(o.first_ctes(), f"SELECT {_CATALOG_SQL} FROM b1_catalog"))
def _(spark, sf):
    return _catalog(after_first(spark, sf)["catalog"])


@query("ingest_next_catalog", o.with_ctes(o.state_ctes(), f"SELECT {_CATALOG_SQL} FROM b2_catalog"))
def _(spark, sf):
    return _catalog(state(spark, sf)["catalog"])


@query("ingest_alerts", o.with_ctes(
    o.state_ctes(), f"SELECT alert_id, log_id, alert_type, channel, status, {ts_sql('created_at')} FROM alerts"))
def _(spark, sf):
    return state(spark, sf)["alerts"].select("alert_id", "log_id", "alert_type", "channel", "status", ts_text("created_at"))


@query("ingest_stats", o.with_ctes(
    o.first_ctes(),
    """SELECT count(*) AS total_lines, count(*) AS parsed_lines, count_if(pattern_id IS NOT NULL AND NOT is_known) AS new_patterns,
    count_if(pattern_id IS NOT NULL AND is_known) AS existing_patterns, CAST(0 AS BIGINT) AS errors FROM b1_logs"""))
def _(spark, sf):
    return ingest_stats(after_first(spark, sf)["rows"])


@query("known_flags", o.with_ctes(
    o.state_ctes(), "SELECT pattern_id, count_if(is_known) AS known, count_if(NOT is_known) AS unknown, min(log_id) AS first_log "
    "FROM logs WHERE pattern_id IS NOT NULL GROUP BY pattern_id"))
def _(spark, sf):
    return state(spark, sf)["logs"].where("pattern_id is not null").groupBy("pattern_id").agg(
        F.count_if("is_known").alias("known"), F.count_if(~F.col("is_known")).alias("unknown"),
        F.min("log_id").alias("first_log"))


@query("named_groups", o.with_ctes(
    o.state_ctes(),
    r"""SELECT pattern_id, regexp_matches(t, '\(\?P<[^>]+>') AS has_groups,
    array_to_string(regexp_extract_all(t, '\(\?P<([^>]+)>', 1), ',') AS names
    FROM (SELECT pattern_id, coalesce(manual_regex_rule, regex_rule) AS t FROM catalog)"""))
def _(spark, sf):
    text = F.coalesce("manual_regex_rule", "regex_rule")
    return state(spark, sf)["catalog"].select(
        "pattern_id", has_named_groups(text).alias("has_groups"), F.array_join(group_names(text), ",").alias("names"))


# --- rules -----------------------------------------------------------------------------

_OPS = {
    "gt": (">", "v > 50000.0"), "ge": (">=", "v >= 50000.0"), "lt": ("<", "v < 50000.0"), "le": ("<=", "v <= 50000.0"),
    "eq": ("==", "abs(v - 50000.0) < 1e-4"), "ne": ("!=", "abs(v - 50000.0) >= 1e-4"),
    "between": ("between", "v BETWEEN 50000.0 AND 60000.0"), "not_between": ("not_between", "v NOT BETWEEN 50000.0 AND 60000.0"),
}


def _threshold_query(name: str, op: str, condition: str):
    sql = f"""SELECT l_returnflag, count(*) AS n, count_if({condition}) AS hits
    FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem) GROUP BY l_returnflag"""

    @query(f"rule_{name}", sql)
    def _(spark, sf):
        holds = rules_ops.threshold_holds(F.lit(op), F.col("l_extendedprice"), F.lit(50000.0), F.lit(60000.0))
        return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
            F.count("*").alias("n"), F.count_if(holds).alias("hits"))


for _name, (_op, _condition) in _OPS.items():
    _threshold_query(_name, _op, _condition)


def _text_rule(kind: str, text: str):
    rule = {"rule_type": F.lit(kind), "field_name": F.lit(None).cast("string"), "op": F.lit(None).cast("string"),
            "threshold1": F.lit(None).cast("double"), "threshold2": F.lit(None).cast("double"), "search_text": F.lit(text)}
    none = F.create_map().cast("map<string,struct<num:double,text:string>>")
    return rules_ops.rule_holds(rule, F.col("message"), none)


@query("rule_contains", o.with_ctes(
    [_TEXT_LINES], "SELECT origin, id, count(*) AS n FROM text_lines WHERE contains(message, 'ing') GROUP BY 1, 2"))
def _(spark, sf):
    return text_lines(spark, sf).where(_text_rule("contains", "ing")).groupBy("origin", "id").agg(F.count("*").alias("n"))


@query("rule_regex", o.with_ctes(
    [_TEXT_LINES], "SELECT origin, id, count(*) AS n FROM text_lines WHERE regexp_matches(message, '[0-9]{3,}[^0-9]') GROUP BY 1, 2"))
def _(spark, sf):
    return text_lines(spark, sf).where(_text_rule("regex", "[0-9]{3,}[^0-9]")).groupBy("origin", "id").agg(F.count("*").alias("n"))


_JUDGED = """SELECT h.log_id, r.rule_id, r.severity_if_match AS severity,
    coalesce(r.message, 'Rule ' || r.rule_id || ' matched') AS reason
    FROM (SELECT log_id, {pick} AS rule_id FROM (SELECT * FROM b1_hits UNION ALL SELECT * FROM b2_hits) JOIN rules USING (rule_id)
          GROUP BY log_id) h JOIN rules r USING (rule_id)"""
_RANK = "CASE severity_if_match WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END"


def _judged(spark, sf, policy):
    judged = rules_ops.judge(state(spark, sf)["rows"].where("is_known"), seed_rules(spark), policy)
    return judged.where("verdict is not null").select("log_id", "verdict.severity", "verdict.reason")


@query("rules_first", o.with_ctes(
    o.state_ctes(), f"SELECT log_id, severity, reason FROM ({_JUDGED.format(pick='min(rule_id)')})"))
def _(spark, sf):
    return _judged(spark, sf, "first")


@query("rules_most_severe", o.with_ctes(
    o.state_ctes(),
    f"SELECT log_id, severity, reason FROM ({_JUDGED.format(pick=f'arg_min(rule_id, rule_id - 1000 * {_RANK})')})"))
def _(spark, sf):
    return _judged(spark, sf, "most_severe")


@query("check_logs", o.with_ctes(
    o.state_ctes(), f"SELECT log_id, severity, reason AS anomaly_reason FROM ({_JUDGED.format(pick='min(rule_id)')})"))
def _(spark, sf):
    now = state(spark, sf)
    return rules_ops.check_logs(now["rows"].where("is_known"), None, now["rules"]).select(
        "log_id", "severity", "anomaly_reason")


@query("param_pivot", o.with_ctes(
    o.state_ctes(), "SELECT log_id, count(*) AS n, sum(param_value_num) AS total FROM params GROUP BY log_id"))
def _(spark, sf):
    packed = params_ops.pack_params(state(spark, sf)["params"])
    number = F.aggregate(
        F.map_values("params"), F.lit(None).cast("double"),
        lambda acc, v: F.when(v["num"].isNull(), acc).otherwise(F.coalesce(acc, F.lit(0.0)) + v["num"]))
    return packed.select("log_id", F.size("params").cast("bigint").alias("n"), number.alias("total"))


# --- deduplication ------------------------------------------------------------------------

_SHIP = """ship AS (
  SELECT 'ship ' || l_returnflag || ' ' || l_linestatus || ' qty ' || CAST(l_quantity AS BIGINT) || ' line ' || l_linenumber AS raw_line,
    'ship-' || year(l_shipdate) AS source_file, l_shipdate AS seen_at FROM lineitem)"""
_UNIQUE = """SELECT raw_line, count(*) AS count, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at,
  min(source_file) AS first_seen_file, max(source_file) AS last_seen_file FROM ship GROUP BY raw_line"""


def _unique(df):
    return df.select("raw_line", "count", "first_seen_file", "last_seen_file", ts_text("first_seen_at"), ts_text("last_seen_at"))


@query("dedup_lines", o.with_ctes(
    [_SHIP], f"SELECT raw_line, count, first_seen_file, last_seen_file, {ts_sql('first_seen_at')}, {ts_sql('last_seen_at')} FROM ({_UNIQUE})"))
def _(spark, sf):
    return _unique(dedup.unique_lines(shipment_lines(spark, sf)))


@query("dedup_totals", o.with_ctes(
    [_SHIP], "SELECT count(DISTINCT raw_line) AS total, count(*) AS total_count FROM ship"))
def _(spark, sf):
    return dedup.unique_totals(dedup.unique_lines(shipment_lines(spark, sf)))


@query("dedup_merge", o.with_ctes(
    [_SHIP], f"""SELECT raw_line, 2 * count AS count, first_seen_file, last_seen_file, {ts_sql('first_seen_at')},
    strftime(last_seen_at + INTERVAL 365 DAY, '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM ({_UNIQUE})"""))
def _(spark, sf):
    once = dedup.unique_lines(shipment_lines(spark, sf))
    later = shipment_lines(spark, sf).withColumn("seen_at", F.col("seen_at") + F.expr("INTERVAL 365 DAY"))
    return _unique(dedup.merge_unique(once, dedup.unique_lines(later)))


@query("dedup_text", o.with_ctes(
    [_TEXT_LINES], """SELECT message AS raw_line, count(*) AS count, arg_min(origin, k) AS first_seen_file, arg_max(origin, k) AS last_seen_file
    FROM (SELECT origin, regexp_replace(message, '[\\r\\n]+$', '') AS message,
            CASE origin WHEN 'documents' THEN id ELSE id + 1000000000 END AS k FROM text_lines)
    WHERE trim(message, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '' GROUP BY message"""))
def _(spark, sf):
    place = F.when(F.col("origin") == "documents", F.col("id")).otherwise(F.col("id") + 1000000000)
    lines = text_lines(spark, sf).select(
        F.col("message").alias("value"), F.col("origin").alias("source_file"), place.alias("line_seq"),
        wall_time(dt.datetime(2024, 1, 1)).alias("seen_at"))
    return dedup.unique_lines(lines).select("raw_line", "count", "first_seen_file", "last_seen_file")
