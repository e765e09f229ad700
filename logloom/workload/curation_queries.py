"""Catalog curation, reprocessing, packs, triage and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import alerts as alert_ops, catalog as catalog_ops, reports, rules as rules_ops, triage
from logloom.plans.packs import BANDWIDTH_LIMITS, BANDWIDTH_NOTE, BANDWIDTH_REGEX, BANDWIDTH_SAMPLE, bandwidth_pack
from logloom.plans.reprocess import Reprocessed, reprocess_pattern
from logloom.session import local_table, stage, staging_path
from logloom.sources.log_ranges import LogRanges
from logloom.workload import oracle_tables as o
from logloom.workload.lines import TRIAGE_RUN, table
from logloom.workload.registry import query, ts_sql, ts_text
from logloom.workload.state import after_first, answers, once, state, triaged

_STATE = o.state_ctes()
_TRIAGE = o.triage_ctes()


# --- adding patterns --------------------------------------------------------------

_NEW_PATTERNS = """asked AS (
  SELECT p_partkey AS seq, CASE WHEN p_size > 45 THEN '(' || p_name WHEN p_size < 5 THEN p_name || '\\s+(?P<qty>[0-9]+)' ELSE p_name END AS regex,
    CASE p_type WHEN 'ECONOMY' THEN 'abnormal' WHEN 'SMALL' THEN 'bogus' ELSE 'normal' END AS label,
    CASE WHEN p_size > 20 THEN 'warning' END AS severity, p_brand AS note, p_name AS sample FROM part),
checked AS (SELECT *, CASE WHEN regex LIKE '(%' THEN 'invalid regex' WHEN label = 'bogus' THEN 'invalid label' END AS reject_reason FROM asked),
keyed AS (SELECT regex, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM checked WHERE reject_reason IS NULL GROUP BY regex),
fresh AS (SELECT *, (SELECT max(pattern_id) FROM catalog) + row_number() OVER (ORDER BY first_seq) AS pattern_id FROM keyed k
  WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.regex_rule = k.regex OR c.manual_regex_rule = k.regex))"""


def _new_patterns(spark, sf):
    name, size = F.col("p_name"), F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"),
        F.when(size > 45, F.concat(F.lit("("), name)).when(size < 5, F.concat(name, F.lit(r"\s+(?P<qty>[0-9]+)"))).otherwise(name).alias("regex"),
        name.alias("sample_message"),
        F.when(F.col("p_type") == "ECONOMY", "abnormal").when(F.col("p_type") == "SMALL", "bogus").otherwise("normal").alias("label"),
        F.when(size > 20, "warning").alias("severity"), F.lit(None).cast("string").alias("component"), F.col("p_brand").alias("note"))


_ADDED_SQL = """SELECT pattern_id, regex_rule, manual_regex_rule, sample_message, label, severity, note, has_params, total_count FROM catalog
  UNION ALL SELECT f.pattern_id, NULL, f.regex, a.sample, {w}.label, {w}.severity, {w}.note, contains(f.regex, '(?P<'), 0
  FROM fresh f JOIN checked a ON a.seq = f.first_seq JOIN checked z ON z.seq = f.last_seq"""


def _added(additions):
    return additions.catalog.select("pattern_id", "regex_rule", "manual_regex_rule", "sample_message", "label", "severity",
                                    "note", "has_params", "total_count")


@query("add_patterns", o.with_ctes(_STATE + [_NEW_PATTERNS], _ADDED_SQL.format(w="a")))
def _(spark, sf):
    return _added(catalog_ops.add_patterns(state(spark, sf)["catalog"], _new_patterns(spark, sf), TRIAGE_RUN))


@query("add_patterns_updating", o.with_ctes(_STATE + [_NEW_PATTERNS], _ADDED_SQL.format(w="z")))
def _(spark, sf):
    return _added(catalog_ops.add_patterns(state(spark, sf)["catalog"], _new_patterns(spark, sf), TRIAGE_RUN, True))


@query("add_patterns_assigned", o.with_ctes(
    _STATE + [_NEW_PATTERNS], "SELECT c.seq, f.pattern_id FROM checked c JOIN fresh f ON f.regex = c.regex WHERE reject_reason IS NULL"))
def _(spark, sf):
    return catalog_ops.add_patterns(state(spark, sf)["catalog"], _new_patterns(spark, sf), TRIAGE_RUN).assigned


@query("add_patterns_rejected", o.with_ctes(_STATE + [_NEW_PATTERNS], "SELECT seq, reject_reason FROM checked WHERE reject_reason IS NOT NULL"))
def _(spark, sf):
    return catalog_ops.add_patterns(state(spark, sf)["catalog"], _new_patterns(spark, sf), TRIAGE_RUN).rejected.select("seq", "reject_reason")


def _requests(spark, sf):
    labels = table(spark, sf, "labels")
    return labels.select(F.col("doc_id").alias("log_id"),
                         F.when(F.col("toxic") == 1, "abnormal").otherwise("normal").alias("label"),
                         F.when(F.col("quality") == 1, "info").alias("severity"), F.lit("from log").alias("note"))


_REQUESTED = f"""wanted_logs AS (
  SELECT l.log_id, {o.template_sql('l.message')} AS regex, CASE WHEN toxic = 1 THEN 'abnormal' ELSE 'normal' END AS label,
    CASE WHEN quality = 1 THEN 'info' END AS severity, l.message FROM labels b JOIN logs l ON l.log_id = b.doc_id),
learned AS (
  SELECT regex, log_id, (SELECT max(pattern_id) FROM catalog) + row_number() OVER (ORDER BY log_id) AS pattern_id
  FROM (SELECT regex, min(log_id) AS log_id FROM wanted_logs w
        WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.regex_rule = w.regex OR c.manual_regex_rule = w.regex) GROUP BY regex))"""


@query("patterns_from_logs", o.with_ctes(
    _STATE + [_REQUESTED],
    """SELECT pattern_id, coalesce(regex_rule, manual_regex_rule) AS regex, sample_message, label FROM catalog
    UNION ALL SELECT n.pattern_id, n.regex, w.message, w.label FROM learned n JOIN wanted_logs w USING (log_id)"""))
def _(spark, sf):
    now = state(spark, sf)
    catalog, _, _ = catalog_ops.patterns_from_logs(now["catalog"], now["logs"], _requests(spark, sf), TRIAGE_RUN)
    return catalog.select("pattern_id", F.coalesce("regex_rule", "manual_regex_rule").alias("regex"), "sample_message", "label")


@query("patterns_from_logs_mapped", o.with_ctes(
    _STATE + [_REQUESTED],
    """SELECT l.log_id, coalesce(c.pattern_id, n.pattern_id, l.pattern_id, -1) AS pattern_id, w.log_id IS NOT NULL OR l.is_known AS is_known,
      w.log_id IS NOT NULL AS is_manual_mapped, coalesce(w.label, l.classification) AS classification,
      CASE WHEN w.log_id IS NOT NULL THEN w.severity ELSE l.severity END AS severity
    FROM logs l LEFT JOIN wanted_logs w USING (log_id) LEFT JOIN catalog c ON coalesce(c.regex_rule, c.manual_regex_rule) = w.regex
    LEFT JOIN learned n ON n.regex = w.regex"""))
def _(spark, sf):
    now = state(spark, sf)
    _, logs, _ = catalog_ops.patterns_from_logs(now["catalog"], now["logs"], _requests(spark, sf), TRIAGE_RUN)
    return logs.select(
        "log_id", F.coalesce("pattern_id", F.lit(-1)).alias("pattern_id"), "is_known", "is_manual_mapped", "classification", "severity")


# --- relabel, map, edit --------------------------------------------------------------

def _relabellings(spark, sf):
    """New labels for the templates of two kinds of messages, and a bad one for the link pattern."""
    text = F.coalesce("regex_rule", "manual_regex_rule")
    return state(spark, sf)["catalog"].where(text.like("volume%") | text.like("job%") | (F.col("pattern_id") == 2)).select(
        "pattern_id",
        F.when(F.col("pattern_id") == 2, "bogus").when(text.like("job%"), "abnormal").otherwise("ignore").alias("label"),
        F.when(text.like("job%"), "critical").alias("severity"), F.when(text.like("job%"), "by hand").alias("note"))


def _relabelled(spark, sf):
    now = state(spark, sf)
    return catalog_ops.relabel(now["catalog"], now["logs"], _relabellings(spark, sf), TRIAGE_RUN)


_JOB = "coalesce({c}regex_rule, {c}manual_regex_rule) LIKE 'job%'"
_VOL = "coalesce({c}regex_rule, {c}manual_regex_rule) LIKE 'volume%'"


@query("relabel_catalog", o.with_ctes(
    _STATE,
    f"""SELECT pattern_id, CASE WHEN {_JOB.format(c='')} THEN 'abnormal' WHEN {_VOL.format(c='')} THEN 'ignore' ELSE label END AS label,
      CASE WHEN {_JOB.format(c='')} THEN 'critical' ELSE severity END AS severity,
      CASE WHEN {_JOB.format(c='')} THEN 'by hand' ELSE note END AS note FROM catalog"""))
def _(spark, sf):
    return _relabelled(spark, sf)[0].select("pattern_id", "label", "severity", "note")


@query("relabel_logs", o.with_ctes(
    _STATE,
    f"""SELECT log_id, CASE WHEN {_JOB.format(c='c.')} THEN 'abnormal' WHEN {_VOL.format(c='c.')} THEN 'ignore' ELSE classification END AS classification,
      CASE WHEN {_JOB.format(c='c.')} THEN 'critical' WHEN {_VOL.format(c='c.')} THEN NULL ELSE l.severity END AS severity, anomaly_reason
    FROM logs l LEFT JOIN catalog c USING (pattern_id)"""))
def _(spark, sf):
    return _relabelled(spark, sf)[1].select("log_id", "classification", "severity", "anomaly_reason")


_MAPPING = "mapping AS (SELECT doc_id AS log_id, CASE WHEN toxic = 1 THEN 1000000000 ELSE 2 + quality END AS pattern_id FROM labels)"


def _mapped(spark, sf):
    now = state(spark, sf)
    mapping = table(spark, sf, "labels").select(
        F.col("doc_id").alias("log_id"),
        F.when(F.col("toxic") == 1, 1000000000).otherwise(F.col("quality") + 2).cast("bigint").alias("pattern_id"))
    return catalog_ops.map_logs(now["logs"], now["catalog"], mapping, TRIAGE_RUN)


@query("map_logs", o.with_ctes(
    _STATE + [_MAPPING],
    """SELECT l.log_id, coalesce(c.pattern_id, l.pattern_id, -1) AS pattern_id, c.pattern_id IS NOT NULL OR is_known AS is_known,
      c.pattern_id IS NOT NULL AS is_manual_mapped, coalesce(c.label, classification) AS classification,
      CASE WHEN c.pattern_id IS NOT NULL THEN c.severity ELSE l.severity END AS severity
    FROM logs l LEFT JOIN mapping m USING (log_id) LEFT JOIN catalog c ON c.pattern_id = m.pattern_id"""))
def _(spark, sf):
    return _mapped(spark, sf)[0].select(
        "log_id", F.coalesce("pattern_id", F.lit(-1)).alias("pattern_id"), "is_known", "is_manual_mapped", "classification", "severity")


@query("map_logs_refused", o.with_ctes(
    _STATE + [_MAPPING],
    """SELECT m.log_id, CAST(m.pattern_id AS BIGINT) AS pattern_id,
      CASE WHEN c.pattern_id IS NULL THEN 'pattern not found' ELSE 'log not found' END AS reject_reason
    FROM mapping m LEFT JOIN catalog c USING (pattern_id) LEFT JOIN logs l ON l.log_id = m.log_id
    WHERE c.pattern_id IS NULL OR l.log_id IS NULL"""))
def _(spark, sf):
    return _mapped(spark, sf)[1]


@query("edit_logs", o.with_ctes(
    _STATE,
    """SELECT log_id, CASE WHEN doc_id IS NOT NULL THEN 'abnormal' ELSE classification END AS classification,
      CASE WHEN quality = 1 THEN 'warning' ELSE severity END AS severity FROM logs l LEFT JOIN labels b ON b.doc_id = l.log_id"""))
def _(spark, sf):
    edits = table(spark, sf, "labels").select(F.col("doc_id").alias("log_id"), F.lit("abnormal").alias("classification"),
                                              F.when(F.col("quality") == 1, "warning").alias("severity"), F.lit(2).cast("bigint").alias("seq"))
    # Earlier edits of the same logs, which these replace.
    edits = edits.unionByName(edits.withColumns({"classification": F.lit("ignore"), "severity": F.lit("info"), "seq": F.lit(1).cast("bigint")}))
    return catalog_ops.edit_logs(state(spark, sf)["logs"], edits, TRIAGE_RUN).select("log_id", "classification", "severity")


_LABEL_EDITS = """edited AS (SELECT l.* REPLACE (CASE WHEN doc_id IS NOT NULL THEN 'abnormal' ELSE classification END AS classification,
    CASE WHEN quality = 1 THEN 'warning' ELSE severity END AS severity) FROM logs l LEFT JOIN labels b ON b.doc_id = l.log_id)"""


def _in_ranges(spark, sf):
    """The stored rows in ranges of 1024 ids, edited by ``labels``: one folder after the other is named, the rest stays."""
    rows = state(spark, sf)["rows"]
    store = LogRanges(spark, staging_path(spark, "log-ranges"), rows.schema, 1024)
    store.append(rows)
    edits = table(spark, sf, "labels").select(F.col("doc_id").alias("log_id"), F.lit("abnormal").alias("classification"),
                                              F.when(F.col("quality") == 1, "warning").alias("severity"))
    store.rewrite(store.ranges_of_logs(edits), lambda part: catalog_ops.edit_logs(part, edits, TRIAGE_RUN))
    return store


@query("edit_ranges", o.with_ctes(_STATE + [_LABEL_EDITS], "SELECT log_id, classification, severity, coalesce(pattern_id, -1) AS pattern_id FROM edited"))
def _(spark, sf):
    return _in_ranges(spark, sf).rows().select("log_id", "classification", "severity", F.coalesce("pattern_id", F.lit(-1)).alias("pattern_id"))


@query("relabel_ranges", o.with_ctes(
    _STATE + [_LABEL_EDITS],
    f"""SELECT log_id, CASE WHEN {_JOB.format(c='c.')} THEN 'abnormal' WHEN {_VOL.format(c='c.')} THEN 'ignore' ELSE classification END AS classification,
      CASE WHEN {_JOB.format(c='c.')} THEN 'critical' WHEN {_VOL.format(c='c.')} THEN NULL ELSE l.severity END AS severity
    FROM edited l LEFT JOIN catalog c USING (pattern_id)"""))
def _(spark, sf):
    store, changes = _in_ranges(spark, sf), _relabellings(spark, sf)
    catalog = state(spark, sf)["catalog"]
    store.rewrite(store.ranges_of_patterns(changes), lambda part: catalog_ops.relabel(catalog, part, changes, TRIAGE_RUN)[1])
    return store.rows().select("log_id", "classification", "severity")


@query("ranges_with_param", o.with_ctes(
    _STATE + [_LABEL_EDITS],
    f"""SELECT log_id, {ts_sql('ts')}, host, message, classification, severity, param_name, param_value_num
    FROM (SELECT log_id, ts, host, message FROM logs WHERE pattern_id = 2) AS own JOIN (SELECT log_id, classification, severity FROM edited) AS now USING (log_id)
    LEFT JOIN (SELECT * FROM params WHERE param_name = 'bandwidth') AS bandwidth USING (log_id)"""))
def _(spark, sf):
    return reports.logs_with_param(_in_ranges(spark, sf).of_pattern(2), 2, "bandwidth", limit=None).drop("anomaly_reason").withColumn("ts", ts_text("ts"))


@query("backfill_has_params", o.with_ctes(
    _STATE, "SELECT pattern_id, contains(coalesce(manual_regex_rule, regex_rule), '(?P<') AS has_params FROM catalog"))
def _(spark, sf):
    return catalog_ops.backfill_has_params(state(spark, sf)["catalog"]).select("pattern_id", "has_params")


@query("integrity", o.with_ctes(
    _STATE + ["old AS (SELECT pattern_id FROM b1_catalog)"],
    """SELECT * FROM (
    SELECT 'one_pattern_text' AS check_name, count(*) AS violations FROM b1_catalog WHERE (regex_rule IS NULL) = (manual_regex_rule IS NULL)
    UNION ALL SELECT 'unique_regex_rule', count(*) FROM (SELECT 1 FROM b1_catalog WHERE regex_rule IS NOT NULL GROUP BY regex_rule HAVING count(*) > 1)
    UNION ALL SELECT 'unique_manual_regex_rule', count(*) FROM (SELECT 1 FROM b1_catalog WHERE manual_regex_rule IS NOT NULL GROUP BY manual_regex_rule HAVING count(*) > 1)
    UNION ALL SELECT 'log_pattern', count(*) FROM logs WHERE pattern_id IS NOT NULL AND pattern_id NOT IN (SELECT pattern_id FROM old)
    UNION ALL SELECT 'rule_pattern', count(*) FROM rules WHERE pattern_id NOT IN (SELECT pattern_id FROM old)
    UNION ALL SELECT 'param_log', count(*) FROM params WHERE log_id NOT IN (SELECT log_id FROM logs)
    UNION ALL SELECT 'alert_log', count(*) FROM alerts WHERE log_id NOT IN (SELECT log_id FROM logs)
    UNION ALL SELECT 'analysis_log', count(*) FROM labels WHERE doc_id NOT IN (SELECT log_id FROM logs))"""))
def _(spark, sf):
    # The catalog of the first batch lacks the patterns of the second, so there are orphans to find.
    now = state(spark, sf)
    analyses = table(spark, sf, "labels").select(F.col("doc_id").alias("log_id"))
    return catalog_ops.integrity(after_first(spark, sf)["catalog"], now["logs"], now["params"], now["rules"], now["alerts"], analyses)


# --- rules and packs -----------------------------------------------------------------

_NEW_RULES = """asked AS (
  SELECT pattern_id AS seq, CASE WHEN label = 'ignore' THEN -1 ELSE pattern_id END AS pattern_id,
    CASE WHEN has_params THEN 'threshold' WHEN total_count > 1 THEN 'contains' WHEN total_count = 1 THEN 'regex' ELSE 'odd' END AS rule_type,
    CASE WHEN has_params THEN 'v' END AS field_name,
    CASE WHEN has_params THEN CASE WHEN pattern_id = 2 THEN 'between' ELSE '>' END END AS op,
    CASE WHEN has_params THEN pattern_id + 0.5 END AS t1, CASE WHEN pattern_id = 2 THEN 9.0 END AS t2,
    CASE WHEN NOT has_params THEN label || total_count END AS search_text, 'warning' AS severity FROM catalog),
judged AS (SELECT *, CASE WHEN pattern_id = -1 THEN 'pattern not found' WHEN rule_type = 'odd' THEN 'unknown rule type' END AS reject_reason FROM asked)"""


def _added_rules(spark, sf):
    now = state(spark, sf)
    catalog, has = now["catalog"], F.col("has_params")
    new = catalog.select(
        F.col("pattern_id").alias("seq"),
        F.when(F.col("label") == "ignore", F.lit(-1)).otherwise(F.col("pattern_id")).cast("bigint").alias("pattern_id"),
        F.when(has, "threshold").when(F.col("total_count") > 1, "contains").when(F.col("total_count") == 1, "regex").otherwise("odd").alias("rule_type"),
        F.when(has, "v").alias("field_name"),
        F.when(has, F.when(F.col("pattern_id") == 2, "between").otherwise(">")).alias("op"),
        F.when(has, F.col("pattern_id") + 0.5).alias("threshold1"), F.when(F.col("pattern_id") == 2, 9.0).alias("threshold2"),
        F.when(~has, F.concat("label", F.col("total_count").cast("string"))).alias("search_text"),
        F.lit("warning").alias("severity_if_match"), F.lit(True).alias("is_abnormal_if_match"),
        F.lit(None).cast("string").alias("message"), F.lit(True).alias("is_active"))
    return rules_ops.add_rules(now["rules"], new, catalog)


@query("add_rules", o.with_ctes(
    _STATE + [_NEW_RULES],
    """SELECT rule_id, pattern_id, rule_type, op, message FROM rules
    UNION ALL SELECT (SELECT max(rule_id) FROM rules) + row_number() OVER (ORDER BY seq), pattern_id, rule_type,
      CASE rule_type WHEN 'contains' THEN 'contains' WHEN 'regex' THEN 'matches' ELSE op END,
      CASE WHEN rule_type = 'contains' THEN 'Message contains ''' || search_text || ''''
        WHEN rule_type = 'regex' THEN 'Message matches pattern ''' || search_text || ''''
        WHEN op = 'between' THEN field_name || ' between ' || CAST(CAST(t1 AS DOUBLE) AS VARCHAR) || ' and ' || CAST(CAST(t2 AS DOUBLE) AS VARCHAR)
        ELSE field_name || ' ' || op || ' ' || CAST(CAST(t1 AS DOUBLE) AS VARCHAR) END
    FROM judged WHERE reject_reason IS NULL"""))
def _(spark, sf):
    return _added_rules(spark, sf)[0].select("rule_id", "pattern_id", "rule_type", "op", "message")


@query("add_rules_rejected", o.with_ctes(_STATE + [_NEW_RULES], "SELECT seq, reject_reason FROM judged WHERE reject_reason IS NOT NULL"))
def _(spark, sf):
    return _added_rules(spark, sf)[1].select("seq", "reject_reason")


@query("threshold_pack", o.with_ctes(
    _STATE,
    f"""SELECT pattern_id, coalesce(regex_rule, manual_regex_rule) AS regex, sample_message, note, CAST(0 AS BIGINT) AS rules FROM catalog
    WHERE pattern_id NOT IN (SELECT pattern_id FROM rules)
    UNION ALL SELECT c.pattern_id, manual_regex_rule, sample_message, note, n FROM catalog c JOIN (SELECT pattern_id, count(*) AS n FROM rules GROUP BY 1) USING (pattern_id)
    UNION ALL SELECT (SELECT max(pattern_id) + 1 FROM catalog), {o.quoted(BANDWIDTH_REGEX)}, {o.quoted(BANDWIDTH_SAMPLE)}, {o.quoted(BANDWIDTH_NOTE)}, {len(BANDWIDTH_LIMITS)}"""))
def _(spark, sf):
    now = state(spark, sf)
    catalog, rules = bandwidth_pack(now["catalog"], now["rules"], TRIAGE_RUN)
    per_pattern = rules.groupBy("pattern_id").agg(F.count("*").alias("n"))
    return catalog.join(per_pattern, "pattern_id", "left").select(
        "pattern_id", F.coalesce("regex_rule", "manual_regex_rule").alias("regex"), "sample_message", "note",
        F.coalesce("n", F.lit(0)).alias("rules"))


# --- reprocessing -----------------------------------------------------------------------

# Fixed value: a pattern added after the lines were stored.
_JOB_REGEX = r"failed: code 0x(?P<code>[0-9a-f]+) after (?P<secs>\d+\.\d+) s"


def reprocessed(spark, sf):
    """The pattern run over the stored logs; its rows are written once, and logs, parameters and counts read from them."""
    now = state(spark, sf)

    def build():
        new = local_table(spark, [(1, _JOB_REGEX, "sample", "unknown", "info", None, None)],
                          "seq bigint, regex string, sample_message string, label string, severity string, component string, note string")
        # A change of the catalog is written before it is used, as the store does.
        catalog = stage(catalog_ops.add_patterns(now["catalog"], new, TRIAGE_RUN).catalog, "reprocess-catalog")
        pattern_id = now["catalog"].agg(F.max("pattern_id")).first()[0] + 1
        own = local_table(spark, [(1, pattern_id, "threshold", "secs", ">", 100.0, None, None, "critical", True, None, True),
                                  (2, pattern_id, "contains", "code", None, None, None, "f", "warning", True, "code has f", True)],
                          "seq bigint, pattern_id bigint, rule_type string, field_name string, op string, threshold1 double, threshold2 double, "
                          "search_text string, severity_if_match string, is_abnormal_if_match boolean, message string, is_active boolean")
        rules, _ = rules_ops.add_rules(now["rules"], own, catalog)
        done = reprocess_pattern(now["rows"], None, catalog, stage(rules, "reprocess-rules"), pattern_id, TRIAGE_RUN)
        return {"rows": stage(done.rows, "reprocessed")}

    return Reprocessed(once(spark, sf, "reprocessed", build)["rows"], tuple(now["logs"].columns))


_REPROCESS = [rf"""again AS (
  SELECT log_id, regexp_extract(message, {o.quoted(_JOB_REGEX)}, 1) AS code, regexp_extract(message, {o.quoted(_JOB_REGEX)}, 2) AS secs
  FROM logs WHERE regexp_matches(message, {o.quoted(_JOB_REGEX)}))""",
    f"""again_params AS (SELECT log_id, 'code' AS param_name, {o._number('code')} AS param_value_num, code AS param_value_text FROM again
  UNION ALL SELECT log_id, 'secs', {o._number('secs')}, secs FROM again)""",
    """again_hits AS (SELECT a.log_id, CASE WHEN p.param_value_num > 100.0 THEN 'critical'
    WHEN contains(coalesce(CAST(c.param_value_num AS VARCHAR), c.param_value_text), 'f') THEN 'warning' END AS severity
  FROM again a JOIN again_params p ON p.log_id = a.log_id AND p.param_name = 'secs' JOIN again_params c ON c.log_id = a.log_id AND c.param_name = 'code')"""]


@query("reprocess_logs", o.with_ctes(
    _STATE + _REPROCESS,
    """SELECT l.log_id, CASE WHEN h.log_id IS NOT NULL THEN (SELECT max(pattern_id) + 1 FROM catalog) ELSE coalesce(l.pattern_id, -1) END AS pattern_id,
      h.log_id IS NOT NULL OR l.is_known AS is_known,
      CASE WHEN h.severity IS NOT NULL THEN 'abnormal' WHEN h.log_id IS NOT NULL THEN 'normal' ELSE l.classification END AS classification,
      CASE WHEN h.log_id IS NOT NULL THEN coalesce(h.severity, 'info') ELSE l.severity END AS severity,
      CASE h.severity WHEN 'critical' THEN 'secs > 100.0' WHEN 'warning' THEN 'code has f' ELSE l.anomaly_reason END AS anomaly_reason
    FROM logs l LEFT JOIN again_hits h USING (log_id)"""))
def _(spark, sf):
    return reprocessed(spark, sf).logs.select(
        "log_id", F.coalesce("pattern_id", F.lit(-1)).alias("pattern_id"), "is_known", "classification", "severity", "anomaly_reason")


@query("reprocess_params", o.with_ctes(
    _STATE + _REPROCESS,
    "SELECT log_id, param_name, param_value_num, param_value_text FROM params ANTI JOIN again USING (log_id) UNION ALL SELECT * FROM again_params"))
def _(spark, sf):
    return reprocessed(spark, sf).params


@query("reprocess_stats", o.with_ctes(
    _STATE + _REPROCESS, "SELECT count(*) AS matched_logs, count(*) AS logs_with_params, count(severity) AS abnormal_logs FROM again_hits"))
def _(spark, sf):
    return reprocessed(spark, sf).stats


# --- triage --------------------------------------------------------------------------------

@query("triage_candidates", o.with_ctes(
    _STATE, f"SELECT log_id, host, component, message, {ts_sql('ts')} FROM logs WHERE NOT is_known AND log_id NOT IN (SELECT doc_id FROM labels)"))
def _(spark, sf):
    seen = table(spark, sf, "labels").select(F.col("doc_id").alias("log_id"))
    return triage.candidates(state(spark, sf)["logs"], seen, limit=None).select("log_id", "host", "component", "message", ts_text("ts"))


@query("triage_candidates_of_host", o.with_ctes(
    _STATE, f"SELECT log_id, {ts_sql('ts')} FROM logs WHERE NOT is_known AND host = '10.0.0.105' ORDER BY logs.ts DESC, log_id LIMIT 10"))
def _(spark, sf):
    now = state(spark, sf)
    return triage.candidates(now["logs"], now["analyses"], host="10.0.0.105").select("log_id", ts_text("ts"))


@query("triage_prompts", o.with_ctes(
    _TRIAGE,
    f"""SELECT log_id, {o.quoted(triage.PROMPT_HEAD)} || 'Timestamp: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Host: ' || coalesce(host, 'None')
      || chr(10) || 'Component: ' || coalesce(component, 'None') || chr(10) || 'Message: ' || message || {o.quoted(triage.PROMPT_TAIL)} AS prompt
    FROM scored"""))
def _(spark, sf):
    return triaged(spark, sf)["scored"].select("log_id", "prompt")


@query("triage_verdicts", o.with_ctes(
    _TRIAGE, "SELECT log_id, is_abnormal, label, severity, reason, suggestion AS pattern_suggestion FROM scored"))
def _(spark, sf):
    return triaged(spark, sf)["scored"].select("log_id", "verdict.is_abnormal", "verdict.label", "verdict.severity",
                                               "verdict.reason", "verdict.pattern_suggestion")


@query("triage_parse", """SELECT doc_id AS log_id, CASE WHEN toxic = 1 THEN 'abnormal' WHEN quality = 1 THEN 'normal' ELSE 'unknown' END AS label,
    toxic = 1 AS is_abnormal FROM labels""")
def _(spark, sf):
    verdict = triage.parse_verdict(F.col("response"), F.col("error"))
    return answers(spark, sf).select("log_id", verdict["label"].alias("label"), verdict["is_abnormal"].alias("is_abnormal"))


@query("triage_logs", o.with_ctes(
    _TRIAGE, "SELECT log_id, coalesce(pattern_id, -1) AS pattern_id, is_known, is_manual_mapped, classification, severity, anomaly_reason FROM t_logs"))
def _(spark, sf):
    return triaged(spark, sf)["logs"].select("log_id", F.coalesce("pattern_id", F.lit(-1)).alias("pattern_id"), "is_known",
                                             "is_manual_mapped", "classification", "severity", "anomaly_reason")


@query("triage_catalog", o.with_ctes(
    _TRIAGE, "SELECT pattern_id, regex_rule, manual_regex_rule, sample_message, label, severity, note, component FROM t_catalog"))
def _(spark, sf):
    return triaged(spark, sf)["catalog"].select(
        "pattern_id", "regex_rule", "manual_regex_rule", "sample_message", "label", "severity", "note", "component")


@query("triage_alerts", o.with_ctes(_TRIAGE, "SELECT alert_id, log_id, alert_type, status FROM t_new_alerts"))
def _(spark, sf):
    return triaged(spark, sf)["new_alerts"].select("alert_id", "log_id", "alert_type", "status")


@query("triage_rejected", o.with_ctes(_TRIAGE, "SELECT log_id AS seq, suggestion AS regex FROM scored WHERE suggestion = '('"))
def _(spark, sf):
    return triaged(spark, sf)["rejected"].select("seq", "regex")


@query("triage_stats", o.with_ctes(
    _TRIAGE,
    """SELECT count(*) AS processed, count_if(label = 'abnormal') AS abnormal, count_if(label = 'normal') AS normal,
      count_if(label = 'unknown') AS unknown, count_if(label = 'normal' AND suggestion <> '(') AS patterns_added,
      count_if(label = 'abnormal') AS alerts_created FROM scored"""))
def _(spark, sf):
    return triaged(spark, sf)["stats"]


@query("triage_analyses", o.with_ctes(
    _TRIAGE, f"SELECT log_id, CASE WHEN a.log_id IS NULL THEN 'Error: no answer' END AS failure, 'table' AS model_name, '{o.TRIAGE_AT}' AS created_at "
    "FROM scored LEFT JOIN answers a USING (log_id)"))
def _(spark, sf):
    return triaged(spark, sf)["analyses"].select(
        "log_id", F.when(F.col("response").startswith("Error: "), F.col("response")).alias("failure"), "model_name", ts_text("created_at"))


@query("triage_with_scorer", o.with_ctes(
    _STATE, """SELECT log_id, if(bad, 'abnormal', 'normal') AS label, if(bad, 'critical', 'info') AS severity
    FROM (SELECT log_id, contains(concat_ws(' ', host, component, message), 'failed') AS bad FROM logs WHERE NOT is_known)"""))
def _(spark, sf):
    """Answers of a function over Arrow batches, here a test for one word."""
    now = state(spark, sf)
    scored = triage.score_with(triage.candidates(now["logs"], now["analyses"], limit=None), _keyword_scorer)
    return scored.select("log_id", "verdict.label", "verdict.severity")


def _keyword_scorer(batches):
    for batch in batches:
        bad = batch["prompt"].str.contains("failed")
        batch["response"] = bad.map({True: '{"label": "abnormal", "severity": "critical"}', False: '{"label": "normal", "severity": "info"}'})
        batch["error"] = None
        yield batch[["log_id", "response", "error"]]


# --- alerts -----------------------------------------------------------------------------------

@query("pending_alerts", o.with_ctes(
    _TRIAGE, f"""SELECT alert_id, log_id, alert_type, l.host, l.component, l.message, l.raw_line, l.classification, l.severity, l.anomaly_reason, {ts_sql('l.ts')},
      {ts_sql('t_alerts.created_at', 'alerted_at')} FROM t_alerts JOIN t_logs l USING (log_id) WHERE status = 'pending'"""))
def _(spark, sf):
    now = triaged(spark, sf)
    return alert_ops.pending_alerts(now["alerts"], now["logs"]).select(
        "alert_id", "log_id", "alert_type", "host", "component", "message", "raw_line", "classification", "severity", "anomaly_reason",
        ts_text("ts"), ts_text("alerted_at"))


_TEXT_SQL = """'*Alert Type:* ' || alert_type || chr(10) || '*Log ID:* ' || log_id || chr(10) || '*Timestamp:* ' || strftime(l.ts, '%Y-%m-%d %H:%M:%S')
  || chr(10) || '*Host:* ' || coalesce(l.host, 'None') || chr(10) || '*Component:* ' || coalesce(l.component, 'None') || chr(10)
  || '*Classification:* ' || l.classification || coalesce(chr(10) || '*Severity:* ' || l.severity, '')
  || coalesce(chr(10) || '*Reason:* ' || l.anomaly_reason, '') || chr(10) || chr(10) || '*Message:*' || chr(10) || '```' || left(l.message, 500) || '```'
  || chr(10) || chr(10) || '*Raw Line:*' || chr(10) || '```' || left(l.raw_line, 500) || '```'"""


@query("alert_texts", o.with_ctes(_TRIAGE, f"SELECT alert_id, {_TEXT_SQL} AS text FROM t_alerts JOIN t_logs l USING (log_id)"))
def _(spark, sf):
    now = triaged(spark, sf)
    return alert_ops.pending_alerts(now["alerts"], now["logs"]).select("alert_id", alert_ops.alert_text().alias("text"))


@query("alert_payloads", o.with_ctes(
    _TRIAGE,
    f"""SELECT alert_id, CAST(to_json({{'text': '🚨 Log Alert: ' || upper(alert_type),
      'blocks': [{{'type': 'section', 'text': {{'type': 'mrkdwn', 'text': {_TEXT_SQL}}}}}]}}) AS VARCHAR) AS payload
    FROM t_alerts JOIN t_logs l USING (log_id)"""))
def _(spark, sf):
    now = triaged(spark, sf)
    return alert_ops.pending_alerts(now["alerts"], now["logs"]).select("alert_id", alert_ops.alert_payload().alias("payload"))


@query("alert_deliveries", o.with_ctes(
    _TRIAGE,
    f"""SELECT alert_id, CASE WHEN b.doc_id IS NULL THEN a.status WHEN quality = 1 THEN 'sent' ELSE 'failed' END AS status,
      CASE WHEN quality = 1 THEN 'text ' || doc_id WHEN b.doc_id IS NOT NULL THEN 'timeout' ELSE a.message END AS message,
      CASE WHEN quality = 1 THEN '{o.TRIAGE_AT}' END AS sent_at FROM t_alerts a LEFT JOIN labels b ON b.doc_id = a.log_id"""))
def _(spark, sf):
    labels = table(spark, sf, "labels")
    deliveries = labels.select(F.col("doc_id").alias("log_id"), (F.col("quality") == 1).alias("ok"),
                               F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("text"), F.lit("timeout").alias("error"), F.lit(1).cast("bigint").alias("seq"))
    # A second result of the same log comes too late.
    deliveries = deliveries.unionByName(deliveries.withColumns({"ok": ~F.col("ok"), "text": F.lit("late"), "error": F.lit("late"), "seq": F.lit(2).cast("bigint")}))
    return alert_ops.merge_deliveries(triaged(spark, sf)["alerts"], deliveries, TRIAGE_RUN).select(
        "alert_id", "status", "message", ts_text("sent_at"))


@query("alert_feed", o.with_ctes(
    _TRIAGE, f"""SELECT alert_id, alert_type, status, {ts_sql('created_at')}, log_id, l.classification, l.severity,
      coalesce(l.anomaly_reason, '') AS anomaly_reason, l.message FROM t_alerts a JOIN t_logs l USING (log_id)
    WHERE alert_id > 100 ORDER BY alert_id DESC LIMIT 200"""))
def _(spark, sf):
    now = triaged(spark, sf)
    return alert_ops.alert_feed(now["alerts"], now["logs"], 100, 500).withColumn("created_at", ts_text("created_at"))


@query("alert_feed_json", o.with_ctes(
    _TRIAGE, """SELECT alert_id, CAST(to_json({'alert_id': alert_id, 'alert_type': alert_type, 'log_id': log_id, 'classification': l.classification,
      'severity': l.severity, 'message': l.message}) AS VARCHAR) AS body FROM t_alerts a JOIN t_logs l USING (log_id) ORDER BY alert_id DESC LIMIT 50"""))
def _(spark, sf):
    now = triaged(spark, sf)
    feed = alert_ops.alert_feed(now["alerts"], now["logs"])
    return alert_ops.feed_json(feed.select("alert_id", "alert_type", "log_id", "classification", "severity", "message"))
