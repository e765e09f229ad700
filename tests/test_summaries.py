"""Summaries of log rows add up, follow edits, and give the reports what the logs give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logloom.operators import reports
from logloom.operators.summaries import SUMMARY, change, merged, since, summarize
from logloom.session import empty_table, local_table

COLUMNS = ("log_id bigint, ts timestamp_ntz, host string, component string, pattern_id bigint, is_known boolean, "
           "classification string")
START = dt.datetime(2024, 3, 30, 22, 0)  # the hours after cross a change of clocks in many zones


def random_logs(n, seed):
    draw = random.Random(seed)
    return [(i, None if draw.random() < 0.05 else START + dt.timedelta(seconds=draw.randrange(5 * 3600)),
             draw.choice(["h1", "h1", "h1", "h2", None]), draw.choice(["kernel", None]),
             draw.choice([1, 1, 2, None]), draw.random() < 0.5, draw.choice(["normal", "abnormal", "unknown"])) for i in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_parts_add_up_to_the_whole(spark):
    rows = random_logs(400, 1)
    logs = local_table(spark, rows, COLUMNS)
    whole = summarize(logs)
    assert whole.dtypes == [(f.name, f.dataType.simpleString()) for f in SUMMARY.fields]
    parts = [summarize(local_table(spark, rows[a:b], COLUMNS)) for a, b in ((0, 13), (13, 14), (14, 400))]
    assert rows_of(merged(*parts)) == rows_of(merged(merged(parts[2], parts[0]), parts[1])) == rows_of(whole)
    assert whole.agg(F.sum("lines")).first()[0] == 400
    assert rows_of(merged(whole, empty_table(spark, SUMMARY))) == rows_of(whole)


def test_edits_move_counts(spark):
    rows = random_logs(300, 2)
    edited = {i: (*rows[i][:4], 7, True, "normal") for i in range(0, 300, 9)}
    logs, after = local_table(spark, rows, COLUMNS), local_table(spark, [edited.get(r[0], r) for r in rows], COLUMNS)
    touched = F.col("log_id").isin(list(edited))
    moved = change(logs.where(touched), after.where(touched))
    assert rows_of(merged(summarize(logs), moved)) == rows_of(summarize(after))
    # Rows taken out leave nothing behind.
    assert merged(summarize(logs), change(logs, logs.limit(0))).count() == 0


def test_reports_over_a_summary_are_those_over_the_logs(spark):
    logs = local_table(spark, random_logs(500, 3), COLUMNS)
    summary = summarize(logs)
    for run in (reports.by_classification, reports.log_overview, reports.known_share, reports.known_distribution, reports.by_host,
                reports.unknown_share_by_host, reports.pattern_health, lambda t: reports.unknown_count(t, "h1"),
                lambda t: reports.unknown_by_component(t, "h1")):
        assert rows_of(run(summary)) == rows_of(run(logs))
        assert rows_of(run(summary.limit(0))) == rows_of(run(logs.limit(0)))
        assert run(summary).dtypes == run(logs).dtypes


def test_a_start_inside_an_hour_needs_its_logs(spark):
    logs = local_table(spark, random_logs(500, 4), COLUMNS)
    summary = summarize(logs)
    for minutes in (0, 60, 90, 299):
        as_of = START + dt.timedelta(hours=24, minutes=minutes, seconds=minutes % 7)
        want = rows_of(reports.recent(logs, as_of))
        assert rows_of(reports.recent(summary, as_of, cut_hour=logs)) == want
    with pytest.raises(ValueError, match="inside an hour"):
        since(summary, START + dt.timedelta(minutes=1))


def test_counting_queries_read_no_logs(spark):
    run = entry.queries()["summary_by_host"](spark, "/root/testdata/sf0.001")
    assert run.inputFiles() and all("summary" in f for f in run.inputFiles())
