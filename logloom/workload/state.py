"""Hand-written patterns and rules of the workload, and its state tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.operators.summaries import change, merged
from logloom.operators.triage import analyses_of, apply_verdicts, candidates, score
from logloom.plans.ingest import Batch, ingest_batch
from logloom.schemas import ANALYSES, CATALOG, RULES
from logloom.session import empty_table, local_table, stage
from logloom.workload.lines import FIRST_RUN, SECOND_RUN, TRIAGE_RUN, YEAR, event_lines, order_lines, table

# Id, regex, sample, label, severity, component, named groups.
PATTERNS = (
    (1, "(", "broken", "normal", "info", None, False),
    (2, r"\[\s+\d+\.\d+\]\s+pci\s+[0-9a-f:.]+:\s+(?P<bandwidth>\d+\.?\d*)\s+Gb/s\s+available\s+link.*by\s+(?P<speed>\d+)\s+GT/s",
     "[    1.2] pci 0000:1:00.0: 3.50 Gb/s available link bandwidth, limited by 8 GT/s link at 0x1", "normal", "info", "kernel", True),
    (3, r"GPU\s+temp:\s+(?P<temp>\d+\.?\d*)°C", "GPU temp: 75.00°C on card 1", "normal", "info", "kernel", True),
    (4, r"session (\d+) opened for user (?P<user>u\d+) \(uid=(?P<uid>\d+)\)", "session 1 opened for user u1 (uid=1)",
     "ignore", None, None, True),
    (5, r"volume (?P<vol>[a-c]+) state(?P<extra> x)?", "volume a state ok", "abnormal", "warning", "multipath", True),
    (6, r"job [a-d]+ failed", "job a failed", "unknown", "critical", "node-runner", False),
)

# rule_id, pattern_id, type, field, op, threshold1, threshold2, text, severity, abnormal, message, active.
RULE_ROWS = (
    (1, 2, "threshold", "bandwidth", "<=", 50.0, None, None, "warning", True, "bandwidth <= 50", True),
    (2, 2, "threshold", "bandwidth", "<=", 30.0, None, None, "critical", True, "bandwidth <= 30", True),
    (3, 2, "threshold", "bandwidth", "between", 100.0, 200.0, None, "info", True, "bandwidth between 100 and 200", True),
    (4, 3, "threshold", "temp", ">", 80.0, None, None, "critical", True, "GPU temp > 80°C", True),
    (5, 3, "threshold", "temp", "not_between", 5.0, 60.0, None, "info", False, "temp out of range", True),
    (6, 4, "contains", "user", "contains", None, None, "13", "warning", True, "user has 13", True),
    (7, 4, "regex", "absent", "matches", None, None, r"user u\d*7 ", "critical", True, "user ends in 7", True),
    (8, 5, "contains", None, "contains", None, None, "ab", "critical", True, "volume has ab", True),
    (9, 6, "regex", None, "matches", None, None, "code 0x[0-9a-f]*f ", "warning", True, "code ends in f", True),
    (10, 2, "threshold", "bandwidth", ">=", 0.0, None, None, "info", True, "switched off", False),
    (11, 4, "threshold", "uid", ">=", 140.0, None, None, "info", True, None, True),
    (12, 5, "threshold", "absent", "<", 1.0, None, None, "info", True, "never", True),
    (13, 4, "contains", "uid", "contains", None, None, "4.0", "info", True, "uid text has 4.0", True),
)


def seed_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, None, regex, sample, label, severity, None, component, has, FIRST_RUN, FIRST_RUN, 0, None)
            for i, regex, sample, label, severity, component, has in PATTERNS]
    return local_table(spark, rows, CATALOG)


def seed_rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(RULE_ROWS), RULES)


def first_batch(spark: SparkSession, sf_dir: str) -> Batch:
    """``events`` into a catalog of hand-written patterns only."""
    return ingest_batch(event_lines(spark, sf_dir), seed_catalog(spark), seed_rules(spark),
                        as_of=FIRST_RUN, default_year=YEAR)


_STAGED: dict[tuple, tuple[dict[str, DataFrame], set[str]]] = {}


def _still_there(spark: SparkSession, folders: set[str]) -> bool:
    try:
        for folder in folders:
            spark.read.schema("probe string").parquet(folder)
        return True
    except AnalysisException:
        return False


def once(spark: SparkSession, sf_dir: str, name: str, build) -> dict[str, DataFrame]:
    """State tables written once per application and data folder, as a running system has them.

    They are built again when someone has emptied the shared folder in between.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _STAGED and _still_there(spark, _STAGED[key][1]):
        return _STAGED[key][0]
    tables = build()
    folders = {f.rsplit("/", 1)[0] for table in tables.values() for f in table.inputFiles()}
    _STAGED[key] = (tables, {f for f in folders if not f.endswith(sf_dir)})
    return tables


def after_first(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def build():
        batch = first_batch(spark, sf_dir)
        done = batch.over(stage(batch.rows, "first-rows"))
        return {"rows": done.rows, "logs": done.logs, "params": done.params, "templates": done.templates,
                "summary": stage(done.summary, "first-summary"),
                "catalog": stage(done.catalog, "first-catalog"), "alerts": stage(done.alerts(), "first-alerts")}

    return once(spark, sf_dir, "first", build)


def second_batch(spark: SparkSession, sf_dir: str) -> Batch:
    """``orders`` into the state the events have left."""
    first = after_first(spark, sf_dir)
    start = first["logs"].agg(F.max("log_id")).first()[0] + 1
    return ingest_batch(order_lines(spark, sf_dir), first["catalog"], seed_rules(spark),
                        as_of=SECOND_RUN, default_year=YEAR, first_log_id=start)


def state(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables after both batches."""
    def build():
        first = after_first(spark, sf_dir)
        batch = second_batch(spark, sf_dir)
        done = batch.over(stage(batch.rows, "second-rows"))
        last_alert = first["alerts"].agg(F.coalesce(F.max("alert_id"), F.lit(0))).first()[0]
        rows = first["rows"].unionByName(done.rows)
        return {
            "logs": first["logs"].unionByName(done.logs), "params": first["params"].unionByName(done.params),
            "rows": rows, "second_rows": done.rows, "summary": stage(merged(first["summary"], done.summary), "second-summary"),
            "catalog": stage(done.catalog, "second-catalog"),
            "alerts": stage(first["alerts"].unionByName(done.alerts(last_alert)), "second-alerts"),
            "rules": seed_rules(spark), "analyses": empty_table(spark, ANALYSES),
        }

    return once(spark, sf_dir, "both", build)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage answers from ``labels``: toxic is abnormal, good quality is normal, the rest is no JSON."""
    labels = table(spark, sf_dir, "labels")
    doc = F.col("doc_id").cast("string")
    suggestion = (
        F.when(F.contains(doc, F.lit("7")), F.lit("("))
        .when(F.contains(doc, F.lit("3")), F.concat(F.lit("suggested "), doc, F.lit(" [0-9]+")))
        .otherwise(F.lit(""))
    )
    response = (
        F.when(F.col("toxic") == 1, F.concat(F.lit('{"is_abnormal": true, "label": "abnormal", "severity": "critical", "reason": "toxic '), doc, F.lit('"}')))
        .when(F.col("quality") == 1, F.concat(F.lit('{"label": "normal", "reason": "fine", "pattern_suggestion": "'), suggestion, F.lit('"}')))
        .otherwise(F.concat(F.lit("no answer for "), doc))
    )
    return labels.select(F.col("doc_id").alias("log_id"), response.alias("response"), F.lit(None).cast("string").alias("error"))


def triaged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables after a triage of every unknown log."""
    def build():
        now = state(spark, sf_dir)
        scored = stage(score(candidates(now["logs"], now["analyses"], limit=None), answers(spark, sf_dir)), "scored")
        result = apply_verdicts(scored, now["rows"], now["catalog"], now["alerts"], TRIAGE_RUN)
        rows = stage(result.logs, "triage-rows")
        touched = scored.select("log_id")
        moved = change(*(table.join(touched, "log_id", "left_semi") for table in (now["rows"], rows)))
        return {
            **now, "scored": scored, "rows": rows, "logs": rows.drop("params"),
            "summary": stage(merged(now["summary"], moved), "triage-summary"),
            "catalog": stage(result.catalog, "triage-catalog"), "rejected": result.rejected, "stats": result.stats,
            "new_alerts": result.alerts, "alerts": stage(now["alerts"].unionByName(result.alerts), "triage-alerts"),
            "analyses": stage(analyses_of(scored, "table", TRIAGE_RUN), "triage-analyses"),
        }

    return once(spark, sf_dir, "triage", build)
