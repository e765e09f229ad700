import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from logloom.operators import alerts as alert_ops, catalog as catalog_ops, dedup, joins, matching, reports, triage
from logloom.operators.numbering import number_rows
from logloom.plans.reprocess import reprocess_pattern
from logloom.schemas import ALERTS, ANALYSES, CATALOG, LOGS, PARAMS, RULES
from logloom.session import empty_table, local_table
from tests.test_ingest import rule

NOW, LATER = dt.datetime(2025, 8, 1), dt.datetime(2025, 8, 2)
NEW = "seq bigint, regex string, sample_message string, label string, severity string, component string, note string"


def catalog_rows(*rows):
    return [(i, auto, manual, "s", label, severity, None, None, False, NOW, NOW, 3, None) for i, auto, manual, label, severity in rows]


def log_row(i, message, pattern=None, known=False, kind="unknown", severity=None, reason=None, component=None):
    return (i, NOW, "h", component, message, message, pattern, known, False, kind, severity, reason, "f", i, NOW, None)


@pytest.fixture
def tables(spark):
    catalog = local_table(spark, catalog_rows((1, r"job\s+\d+", None, "normal", None), (2, None, "disk", "abnormal", "critical"),
                                              (3, None, "fan", "unknown", "info")), CATALOG)
    logs = local_table(spark, [log_row(1, "job 1", 1), log_row(2, "job 2", 1, True, "abnormal", "warning", "rule"),
                               log_row(3, "disk 9 full", 2, True, "abnormal", "critical"), log_row(4, "fan slow", 3, True, "normal", "info"),
                               log_row(5, "new 7 thing"), log_row(6, "")], LOGS)
    return catalog, logs


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("log_id", *columns).collect()}


def test_numbering_is_dense_and_ordered(spark):
    rnd = random.Random(1)
    keys = sorted(rnd.sample(range(5_000_000), 500) + [2**40 + i for i in range(300)] + [2**62, 2**41, 7 << 40])
    df = local_table(spark, [(k,) for k in keys], "k bigint").repartition(7)
    got = [(r["k"], r["n"]) for r in number_rows(df, "k", 10, "n").orderBy("k").collect()]
    assert got == [(k, 11 + i) for i, k in enumerate(keys)]
    assert [(r["k"], r["n"]) for r in number_rows(df, "k", 10, "n", len(keys)).orderBy("k").collect()] == got
    assert number_rows(df.where("k < 0"), "k", 0, "n").count() == 0


@pytest.mark.parametrize("uses", [None, "n"])
def test_attach_is_the_same_join_however_it_runs(spark, uses):
    big = local_table(spark, [("hot" if i % 3 else f"k{i % 50}" if i % 2 else None, i) for i in range(900)], "key string, id bigint")
    small = local_table(spark, [("hot", 600, 1), ("k3", 6, 2), ("k5", 6, 3), ("other", 1, 4)], "key string, n bigint, v bigint")
    plain = sorted(map(tuple, joins.attach(big, small, "key", F.col("id"), fits=True).select("id", "v").fillna(-1).collect()))
    limit, joins.ROWS_PER_SALT = joins.ROWS_PER_SALT, 50
    try:
        other = joins.attach(big, small, "key", F.col("id"), uses=uses, fits=False).select("id", "v").fillna(-1)
        assert sorted(map(tuple, other.collect())) == plain
    finally:
        joins.ROWS_PER_SALT = limit


def test_fits_broadcast_measures(spark):
    df = local_table(spark, [("x" * 100, i) for i in range(50)], "a string, b bigint")
    assert joins.fits_broadcast(df)
    assert not joins.fits_broadcast(df, rows=49)
    assert not joins.fits_broadcast(df, size=5000)


def test_add_patterns(spark, tables):
    catalog, _ = tables
    new = local_table(spark, [
        (1, "disk", "d", "ignore", None, None, "n1"), (2, r"cpu (?P<p>\d+)", "cpu 1", "normal", "info", "kernel", "n2"), (3, "(", "b", "normal", None, None, None),
        (4, "x", "b", "odd", None, None, None), (5, r"cpu (?P<p>\d+)", "cpu 2", "abnormal", "critical", None, "n5"), (6, "net", "net", "normal", None, None, None),
        (7, r"job\s+\d+", "j", "abnormal", "warning", None, None)], NEW)
    added = catalog_ops.add_patterns(catalog, new, LATER)
    assert {r["seq"]: r["pattern_id"] for r in added.assigned.collect()} == {1: 2, 2: 4, 5: 4, 6: 5, 7: 1}
    assert {r["seq"]: r["reject_reason"] for r in added.rejected.collect()} == {3: "invalid regex", 4: "invalid label"}
    rows = {r["pattern_id"]: r for r in added.catalog.collect()}
    assert len(rows) == 5 and rows[2]["label"] == "abnormal"
    assert (rows[4]["label"], rows[4]["sample_message"], rows[4]["has_params"], rows[4]["component"], rows[4]["total_count"]) == ("normal", "cpu 1", True, "kernel", 0)
    updated = {r["pattern_id"]: r for r in catalog_ops.add_patterns(catalog, new, LATER, True).catalog.collect()}
    assert (updated[2]["label"], updated[2]["severity"], updated[2]["note"], updated[2]["updated_at"]) == ("ignore", None, "n1", LATER)
    assert (updated[4]["label"], updated[4]["severity"], updated[4]["sample_message"]) == ("abnormal", "critical", "cpu 1")
    assert (updated[1]["label"], updated[1]["severity"]) == ("abnormal", "warning")
    assert updated[3]["updated_at"] is None


def test_patterns_from_logs(spark, tables):
    catalog, logs = tables
    requests = local_table(spark, [(5, "normal", "info", None), (1, "abnormal", None, None), (99, "normal", None, None)],
                           "log_id bigint, label string, severity string, note string")
    new_catalog, new_logs, missing = catalog_ops.patterns_from_logs(catalog, logs, requests, LATER)
    assert [r["log_id"] for r in missing.collect()] == [99]
    rows = {r["pattern_id"]: r for r in new_catalog.collect()}
    assert rows[4]["manual_regex_rule"] == r"new\s+\d+\s+thing" and rows[1]["label"] == "normal"
    got = by_id(new_logs, "pattern_id", "is_known", "is_manual_mapped", "classification", "severity")
    assert got[5] == (4, True, True, "normal", "info")
    assert got[1] == (1, True, True, "abnormal", None)
    assert got[2] == (1, True, False, "abnormal", "warning")


def test_relabel(spark, tables):
    catalog, logs = tables
    changes = local_table(spark, [(1, "unknown", None, None), (2, "normal", "info", "fine"), (3, "odd", None, None)],
                          "pattern_id bigint, label string, severity string, note string")
    new_catalog, new_logs, rejected = catalog_ops.relabel(catalog, logs, changes, LATER)
    rows = {r["pattern_id"]: (r["label"], r["severity"], r["note"]) for r in new_catalog.collect()}
    assert rows == {1: ("unknown", None, None), 2: ("normal", "info", "fine"), 3: ("unknown", "info", None)}
    got = by_id(new_logs, "classification", "severity", "anomaly_reason")
    assert got[2] == ("unknown", None, "rule") and got[3] == ("normal", "info", None) and got[4] == ("normal", "info", None)
    assert rejected.count() == 1


def test_map_and_edit_and_update_logs(spark, tables):
    catalog, logs = tables
    mapping = local_table(spark, [(5, 3), (6, 77), (88, 1)], "log_id bigint, pattern_id bigint")
    mapped, refused = catalog_ops.map_logs(logs, catalog, mapping, LATER)
    assert by_id(mapped, "pattern_id", "is_known", "is_manual_mapped", "classification", "severity")[5] == (3, True, True, "unknown", "info")
    assert {r["log_id"]: r["reject_reason"] for r in refused.collect()} == {6: "pattern not found", 88: "log not found"}
    edited = catalog_ops.edit_logs(logs, local_table(spark, [(4, "abnormal", None)], "log_id bigint, classification string, severity string"), LATER)
    assert by_id(edited, "classification", "severity")[4] == ("abnormal", "info")
    updates = local_table(spark, [(1, None, True, "normal", None), (2, 3, False, "unknown", "info")],
                          "log_id bigint, pattern_id bigint, is_known boolean, classification string, severity string")
    got = by_id(matching.update_logs(logs, updates), "pattern_id", "is_known", "classification", "severity")
    assert got[1] == (1, True, "normal", None) and got[2] == (3, False, "unknown", "info") and got[3] == (2, True, "abnormal", "critical")


@pytest.mark.parametrize("regex", [r"job\s+(?P<n>\d+)|thing(?P<w>x?)", r"(?P<n>(job )+)\d+"])
def test_reprocess(spark, tables, regex):
    import re

    catalog, logs = tables
    catalog = catalog.unionByName(local_table(spark, catalog_rows((9, None, regex, "unknown", "info")), CATALOG))
    params = local_table(spark, [(1, "old", 1.0, "1"), (3, "kept", None, "k")], PARAMS)
    rules = local_table(spark, [rule(1, 9, "threshold", "n", ">", 1.0, message="big"), rule(2, 1, "contains", text="job")], RULES)
    done = reprocess_pattern(logs, params, catalog, rules, 9, LATER)
    texts = {r["log_id"]: r["message"] for r in logs.collect()}
    hits = {i: re.search(regex, m) for i, m in texts.items() if re.search(regex, m)}
    got = by_id(done.logs, "pattern_id", "is_known", "classification", "severity", "anomaly_reason")
    assert len(got) == 6 and got[3] == (2, True, "abnormal", "critical", None)
    judged = {i for i, m in hits.items() if (m.groupdict().get("n") or "").isdigit() and float(m["n"]) > 1} if "|" in regex else set()
    for i in hits:
        reason = "big" if i in judged else ("rule" if i == 2 else None)
        assert got[i] == (9, True, "abnormal" if i in judged else "normal", "warning" if i in judged else "info", reason)
    left = {(r["log_id"], r["param_name"]) for r in done.params.collect()}
    assert left == {(3, "kept")} | {(i, k) for i, m in hits.items() for k, v in m.groupdict().items() if v}
    stats = done.stats.first()
    assert (stats["matched_logs"], stats["abnormal_logs"]) == (len(hits), len(judged))
    with pytest.raises(LookupError):
        reprocess_pattern(logs, params, catalog, rules, 1000, LATER)


def test_triage(spark, tables):
    catalog, logs = tables
    logs = logs.unionByName(local_table(spark, [log_row(i, m) for i, m in ((7, "alpha 1"), (8, "beta 2"), (9, "gamma 3"), (10, "delta"))], LOGS))
    seen = local_table(spark, [(9, "p", "r", "m", NOW), (9, "p", "r", "m", NOW)], ANALYSES)
    subjects = triage.candidates(logs, seen, limit=None)
    assert {r["log_id"] for r in subjects.collect()} == {1, 5, 6, 7, 8, 10}
    assert [r["log_id"] for r in triage.candidates(logs, seen, limit=2).collect()] == [1, 5]
    answers = local_table(spark, [
        (1, '{"label":"normal","severity":"unknown","reason":"ok"}', None), (5, '{"label":"abnormal","severity":"critical","reason":"bad","is_abnormal":true}', None),
        (6, "[1, 2]", None), (7, '{"label":"normal","severity":"info","pattern_suggestion":"alpha \\\\d+"}', None),
        (8, '{"label":"normal","pattern_suggestion":"("}', None), (10, None, "timeout")], "log_id bigint, response string, error string")
    scored = triage.score(subjects, answers)
    verdicts = {r["log_id"]: r["verdict"] for r in scored.collect()}
    assert (verdicts[6]["label"], verdicts[10]["label"], verdicts[10]["reason"]) == ("unknown", "unknown", "LLM analysis failed: timeout")
    assert (verdicts[7]["severity"], verdicts[8]["severity"], verdicts[8]["reason"]) == ("info", "unknown", "")
    prompt = scored.where("log_id = 5").first()["prompt"]
    assert "Timestamp: 2025-08-01 00:00:00\n" in prompt and "Component: None\n" in prompt and "Message: new 7 thing\n" in prompt
    analyses = {r["log_id"]: r["response"] for r in triage.analyses_of(scored, "m", LATER).collect()}
    assert len(analyses) == 6 and analyses[10] == "Error: timeout"
    done = triage.apply_verdicts(scored, logs, catalog, empty_table(spark, ALERTS), LATER)
    got = by_id(done.logs, "pattern_id", "is_known", "is_manual_mapped", "classification", "severity", "anomaly_reason")
    assert got[1] == (1, True, True, "normal", "unknown", None)
    assert got[5] == (None, False, False, "abnormal", "critical", "bad")
    assert got[7] == (4, True, True, "normal", "info", None)
    assert got[8] == (None, False, False, "unknown", None, None) == got[10]
    rows = {r["pattern_id"]: r for r in done.catalog.collect()}
    assert (rows[4]["manual_regex_rule"], rows[4]["severity"], rows[4]["note"]) == (r"alpha \d+", "info", "LLM自動追加: ")
    assert [(r["alert_id"], r["log_id"]) for r in done.alerts.collect()] == [(1, 5)]
    assert [r["seq"] for r in done.rejected.collect()] == [8]
    assert tuple(done.stats.first()) == (6, 1, 3, 2, 2, 1)
    quiet = triage.apply_verdicts(scored, logs, catalog, empty_table(spark, ALERTS), LATER, auto_add_pattern=False)
    assert tuple(quiet.stats.first()) == (6, 1, 0, 5, 0, 1)


def test_alert_delivery(spark, tables):
    _, logs = tables
    raised = alert_ops.new_alerts(logs, NOW)
    assert [(r["alert_id"], r["log_id"]) for r in raised.orderBy("alert_id").collect()] == [(1, 1), (2, 2), (3, 3), (4, 5), (5, 6)]
    pending = alert_ops.pending_alerts(raised, logs)
    texts = {r["log_id"]: r["t"] for r in pending.select("log_id", alert_ops.alert_text().alias("t")).collect()}
    assert texts[2] == ("*Alert Type:* abnormal\n*Log ID:* 2\n*Timestamp:* 2025-08-01 00:00:00\n*Host:* h\n*Component:* None\n*Classification:* abnormal\n"
                        "*Severity:* warning\n*Reason:* rule\n\n*Message:*\n```job 2```\n\n*Raw Line:*\n```job 2```")
    assert "Severity" not in texts[5]
    results = local_table(spark, [(2, True, "sent text", None), (3, False, None, "boom")], "log_id bigint, ok boolean, text string, error string")
    merged = alert_ops.merge_deliveries(raised, results, LATER)
    got = {r["log_id"]: (r["status"], r["message"], r["sent_at"]) for r in merged.collect()}
    assert got == {1: ("pending", None, None), 2: ("sent", "sent text", LATER), 3: ("failed", "boom", None), 5: ("pending", None, None), 6: ("pending", None, None)}
    again = alert_ops.merge_deliveries(merged, local_table(spark, [(3, True, "x", None)], "log_id bigint, ok boolean, text string, error string"), LATER)
    assert {r["log_id"]: r["status"] for r in again.collect()}[3] == "failed"
    feed = alert_ops.alert_feed(merged, logs, since_id=1, limit=0).collect()
    assert [(r["alert_id"], r["anomaly_reason"]) for r in feed] == [(5, "")]


def test_component_match(spark, tables):
    from logloom.functions.regexes import load_patterns

    rows = local_table(spark, [(1, r"(?P<what>disk) (?P<n>\d+)", "kernel", "critical"), (2, "disk", None, "info"), (3, "fan", "kernel", None)],
                       "pattern_id bigint, regex string, component string, severity string").collect()
    logs = local_table(spark, [(1, "kernel", "disk 5"), (2, "sshd", "disk 6"), (3, None, "fan"), (4, "kernel", "fan"), (5, None, "disk 7")],
                       "log_id bigint, component string, message string")
    patterns = load_patterns(spark, rows)
    for chosen in (patterns, [replace(p, java=None) for p in patterns]):
        got = by_id(matching.match_by_component(logs, chosen), "matched_id", "matched_severity", "matched_groups")
        assert got == {1: (1, "critical", {"what": "disk", "n": "5"}), 2: (2, "info", {}), 3: (None, None, {}), 4: (3, None, {}), 5: (2, "info", {})}


def test_dedup(spark):
    rows = [("a  ", "f1", 0, NOW), ("b\r", "f1", 1, NOW), ("   ", "f1", 2, NOW), ("a  ", "f2", 3, LATER), ("a", "f2", 4, LATER), ("", "f2", 5, LATER), ("b", "f3", 6, LATER)]
    lines = local_table(spark, rows, "value string, source_file string, line_seq bigint, seen_at timestamp_ntz")
    unique = dedup.unique_lines(lines)
    got = {r["raw_line"]: tuple(r)[1:] for r in unique.collect()}
    assert got == {"a  ": (2, NOW, LATER, "f1", "f2"), "b": (2, NOW, LATER, "f1", "f3"), "a": (1, LATER, LATER, "f2", "f2")}
    assert tuple(dedup.unique_totals(unique).first()) == (3, 5)
    merged = {r["raw_line"]: tuple(r)[1:] for r in dedup.merge_unique(unique, dedup.unique_lines(lines.where("value = 'b'"))).collect()}
    assert merged["b"] == (3, NOW, LATER, "f1", "f3") and merged["a"][0] == 1


def test_search_unknown_limits_lines_not_matches(spark, tables, monkeypatch):
    _, logs = tables
    for top in (100_000, 0):
        monkeypatch.setattr(reports, "TOP_ROWS", top)
        found, counted = reports.search_unknown(logs, r"(new) (\d)", 2)
        assert [tuple(r) for r in found.collect()] == [(5, "new\t7", "new 7 thing")]
        assert tuple(counted.first()) == (1, 2)
    found, counted = reports.search_unknown(logs, r"((new )+)")
    assert [tuple(r) for r in found.collect()] == [(5, "new \tnew ", "new 7 thing")]
    assert tuple(counted.first()) == (1, 3)


def test_repeated_keys_leave_one_row_a_log(spark, tables):
    catalog, logs = tables
    n = logs.count()
    edits = local_table(spark, [(1, "ignore", "info", 1), (1, "abnormal", "critical", 2), (None, "ignore", None, 3)],
                        "log_id bigint, classification string, severity string, seq bigint")
    done = by_id(catalog_ops.edit_logs(logs, edits, NOW), "classification", "severity")
    assert len(done) == n and done[1] == ("abnormal", "critical")
    updates = local_table(spark, [(1, 2, True, "normal", None, 2), (1, None, False, "ignore", "info", 1)],
                          "log_id bigint, pattern_id bigint, is_known boolean, classification string, severity string, seq bigint")
    done = by_id(matching.update_logs(logs, updates), "classification", "is_known")
    assert len(done) == n and done[1] == ("normal", True)
    ids = sorted(r[0] for r in catalog.select("pattern_id").collect())
    mapping = local_table(spark, [(1, ids[0], 1), (1, ids[1], 2), (1, -9, 3)], "log_id bigint, pattern_id bigint, seq bigint")
    mapped, refused = catalog_ops.map_logs(logs, catalog, mapping, NOW)
    assert mapped.count() == n and refused.count() == 1 and by_id(mapped, "pattern_id")[1] == (ids[1],)
    changes = local_table(spark, [(ids[0], "ignore", None, None, 1), (ids[0], "normal", "info", None, 2)],
                          "pattern_id bigint, label string, severity string, note string, seq bigint")
    new_catalog, new_logs, _ = catalog_ops.relabel(catalog, logs, changes, NOW)
    assert new_catalog.count() == len(ids) and new_logs.count() == n
    assert {r["label"] for r in new_catalog.where(F.col("pattern_id") == ids[0]).collect()} == {"normal"}
    requests = local_table(spark, [(1, "normal", "info", None, 1), (1, "ignore", None, None, 2)], "log_id bigint, label string, severity string, note string, seq bigint")
    learnt, moved, _ = catalog_ops.patterns_from_logs(catalog, logs, requests, NOW)
    assert moved.count() == n and by_id(moved, "classification")[1] == ("ignore",) and learnt.select("pattern_id").distinct().count() == learnt.count()


def test_deliveries_settle_every_waiting_alert_once(spark):
    waiting = local_table(spark, [(i, 7, t, "slack", "pending", None, NOW, None, None) for i, t in ((1, "unknown"), (2, "abnormal"))], ALERTS)
    results = local_table(spark, [(7, False, None, "boom", 2), (7, True, "text", None, 1)], "log_id bigint, ok boolean, text string, error string, seq bigint")
    got = alert_ops.merge_deliveries(waiting, results, LATER).collect()
    assert sorted((r["alert_id"], r["status"], r["message"]) for r in got) == [(1, "sent", "text"), (2, "sent", "text")]


def test_requests_without_seq_come_back(spark, tables):
    catalog, _ = tables
    added = catalog_ops.add_patterns(catalog, local_table(spark, [(None, "new one", "s", "normal", None, None, None)], NEW), NOW)
    assert [r["reject_reason"] for r in added.rejected.collect()] == ["seq is required"] and added.assigned.count() == 0
