import datetime as dt
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from logloom.functions.regexes import load_patterns
from logloom.operators import joins
from logloom.operators.matching import match_id
from logloom.operators.reports import by_classification
from logloom.plans.ingest import ingest_batch
from logloom.plans.packs import bandwidth_pack
from logloom.schemas import CATALOG, LINES, RULES
from logloom.session import empty_table, local_table
from tests.sequential import Model

NOW = dt.datetime(2025, 8, 1)

# id, regex, label, severity
PATTERNS = [
    (1, "(", "normal", None), (2, r"GPU\s+temp:\s+(?P<temp>\d+\.?\d*)°C", "normal", "info"),
    (3, r"user (?P<name>\w+)( from (?P<host>\S+))?", "ignore", None), (4, r"disk \d+ full", "abnormal", "critical"),
    (5, r"fan", "unknown", "warning"), (6, r"temp", "normal", None), (7, r"(?P<rest>(\w+ )*)zzz", "normal", "info"),
    (8, r"at\s+0x[0-9A-Fa-f]+", "abnormal", "info"),
]


def rule(rule_id, pattern_id, kind, field=None, op=None, t1=None, t2=None, text=None, severity="warning", message=None, active=True):
    return (rule_id, pattern_id, kind, field, op, t1, t2, text, severity, True, message, active)


RULE_ROWS = [
    rule(1, 2, "threshold", "temp", "<=", 50.0), rule(2, 2, "threshold", "temp", "<=", 30.0, severity="critical"),
    rule(3, 2, "threshold", "temp", "between", 80.0, 90.0, message="hot"), rule(4, 3, "contains", "name", None, text="oo"),
    rule(5, 3, "regex", "host", text=r"^h\d$", message=""), rule(6, 3, "regex", "gone", text="user b"),
    rule(7, 4, "contains", None, text="9"), rule(8, 5, "regex", None, text=r"(x|fan )+slow"), rule(9, 5, "regex", None, text="("),
    rule(10, 2, "threshold", "temp", ">", 0.0, active=False), rule(11, 7, "contains", "rest", text="a b"),
    rule(12, 3, "threshold", "name", ">", 1.0), rule(13, 2, "contains", "temp", text="5.0", message="five"),
]


def catalog_of(spark, patterns=PATTERNS):
    return local_table(spark, [(i, None, r, "s", l, s, None, None, "(?P<" in r, NOW, NOW, 0, None) for i, r, l, s in patterns], CATALOG)


def model_of(patterns=PATTERNS, rules=RULE_ROWS, first=1):
    names = RULES.fieldNames()
    return Model([{"id": i, "regex": None, "manual": r, "label": l, "severity": s, "count": 0, "sample": "s"} for i, r, l, s in patterns],
                 [dict(zip(names, row)) for row in rules], first)


def random_lines(seed, n):
    rnd = random.Random(seed)
    shapes = [
        lambda: f"GPU temp: {rnd.choice([25, 31.5, 50, 55.05, 85, 95])}°C", lambda: "user " + rnd.choice(["foo", "bar", "b1"]) + rnd.choice(["", " from h1", " from far"]),
        lambda: f"disk {rnd.randint(1, 20)} full", lambda: rnd.choice(["fan slow", "fan ok"]), lambda: f"job {rnd.choice('abcdef')} took {rnd.randint(1, 99)} s",
        lambda: f"at 0x{rnd.randint(0, 255):x}", lambda: f"at 0X{rnd.randint(0, 255):x}", lambda: "a b c zzz", lambda: "word " + rnd.choice("pqrs"), lambda: "",
    ]
    heads = ["Jul 14 11:20:17 h1 kernel: ", "Aug  5 01:02:03 h2 sshd[7]: ", "Feb 31 01:02:03 h3 k: ", "", "\t"]
    lines = [rnd.choices(heads, [6, 6, 1, 1, 1])[0] + rnd.choice(shapes)() for _ in range(n)]
    return [line if rnd.random() > 0.03 else "   " for line in lines]


def lines_of(spark, lines, start=0):
    df = local_table(spark, [(v, "f", start + i) for i, v in enumerate(lines)], LINES)
    return df.repartition(5, "value")


LOG_COLUMNS = ("log_id", "ts", "host", "component", "raw_line", "message", "pattern_id", "is_known", "classification", "severity", "anomaly_reason")


def logs_of(batch):
    return sorted(tuple(r) for r in batch.logs.select(*LOG_COLUMNS).collect())


def catalog_rows(df):
    return sorted((r["pattern_id"], r["regex_rule"], r["manual_regex_rule"], r["label"], r["severity"], r["total_count"], r["sample_message"]) for r in df.collect())


def model_catalog(model):
    return sorted((p["id"], p["regex"], p["manual"], p["label"], p["severity"], p["count"], p["sample"]) for p in model.patterns)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_one_line_after_the_other(spark, seed):
    lines = random_lines(seed, 400)
    model = model_of()
    for line in lines:
        model.ingest(line, 2025, NOW)
    batch = ingest_batch(lines_of(spark, lines), catalog_of(spark), local_table(spark, RULE_ROWS, RULES), as_of=NOW, default_year=2025)
    assert logs_of(batch) == sorted(model.logs)
    assert sorted(map(tuple, batch.params.collect())) == sorted(model.params)
    assert sorted((a["alert_id"], a["log_id"], a["alert_type"]) for a in batch.alerts().collect()) == model.alerts
    assert catalog_rows(batch.catalog) == model_catalog(model)
    stats = batch.stats.first()
    unknown = sum(1 for log in model.logs if log[6] is not None and not log[7])
    assert (stats["total_lines"], stats["new_patterns"]) == (400, unknown)


def test_batches_give_what_one_batch_gives(spark):
    lines, rules = random_lines(9, 300), local_table(spark, RULE_ROWS, RULES)
    whole = ingest_batch(lines_of(spark, lines), catalog_of(spark), rules, as_of=NOW, default_year=2025)
    catalog, logs, start = catalog_of(spark), [], 0
    for size in (1, 120, 179):
        part = ingest_batch(lines_of(spark, lines[start:start + size]), catalog, rules, as_of=NOW, default_year=2025, first_log_id=1 + start)
        logs += logs_of(part)
        catalog = local_table(spark, [tuple(r) for r in part.catalog.collect()], CATALOG)
        start += size
    assert sorted(logs) == logs_of(whole)
    assert catalog_rows(catalog) == catalog_rows(whole.catalog)


def test_large_template_table_is_joined_with_salt(spark, monkeypatch):
    lines = ["Jul 14 11:20:17 h k: hot"] * 200 + random_lines(4, 100) + [""] * 20
    args = dict(as_of=NOW, default_year=2025)
    plain = logs_of(ingest_batch(lines_of(spark, lines), catalog_of(spark), local_table(spark, RULE_ROWS, RULES), **args))
    monkeypatch.setattr(joins, "ROWS_PER_SALT", 10)
    monkeypatch.setattr("logloom.plans.ingest.BROADCAST_ROWS", 3)
    salted = ingest_batch(lines_of(spark, lines), catalog_of(spark), local_table(spark, RULE_ROWS, RULES), **args)
    assert logs_of(salted) == plain


def test_more_patterns_change_no_answer(spark, monkeypatch):
    lines = random_lines(5, 200)
    args = dict(as_of=NOW, default_year=2025)
    rules = local_table(spark, RULE_ROWS, RULES)
    plain = logs_of(ingest_batch(lines_of(spark, lines), catalog_of(spark), rules, **args))
    monkeypatch.setattr("logloom.functions.regexes.java_spellings", lambda spark, regexes: [None] * len(regexes))
    assert logs_of(ingest_batch(lines_of(spark, lines), catalog_of(spark), rules, **args)) == plain


def test_meaning_does_not_depend_on_the_number_of_patterns(spark):
    """Texts on which the engines' own classes differ, with 2 and with 600 patterns, in either engine."""
    texts = ["a\x1cb", "pre \u0915\u0947 post", "pre \u0915 post", "x\u00b2y", "na\u00efve cafe\u0301", "\u0663", "a_b", "tab\there", "\u00a0"]
    regexes = [r"a\s+b", r"pre \w+ post", r"x\wy", r"\bcafe\b", r"^\d$", r"[\w]_[^\W]", r"[\s]here", r"^\S$", r"\Bcafe"]
    want = [next((i for i, p in enumerate(regexes) if re.search(p, t)), None) for t in texts]
    lines = local_table(spark, list(enumerate(texts)), "log_id bigint, message string")
    for extra in (0, 600):
        rows = local_table(spark, [(i, p) for i, p in enumerate(regexes + [f"never {k}" for k in range(extra)])], "pattern_id bigint, regex string").collect()
        patterns = load_patterns(spark, rows)
        assert all(p.java is not None for p in patterns if p.regex != regexes[5])
        for chosen in (patterns, [replace(p, java=None) for p in patterns[:len(regexes)]]):
            found = lines.select("log_id", match_id(F.col("message"), chosen).alias("m")).collect()
            assert [r.m for r in sorted(found)] == want


def test_gpu_exercise(spark):
    lines = [f"Jul 14 11:20:{17 + i} 172.20.224.102 kernel: [    0.00584{i}] GPU temp: {t}°C" for i, t in enumerate((75, 85, 90))]
    catalog = catalog_of(spark, [(1898, r"\[\s+\d+\.\d+\]\s+GPU\s+temp:\s+(?P<temp>\d+)°C", "normal", "info")])
    rules = local_table(spark, [rule(1, 1898, "threshold", "temp", ">", 80.0, severity="critical", message="GPU temp > 80°C")], RULES)
    batch = ingest_batch(lines_of(spark, lines), catalog, rules, as_of=NOW, default_year=2025, first_log_id=39342)
    got = [(l[0], l[6], l[7], l[8], l[9], l[10]) for l in logs_of(batch)]
    assert got == [(39342, 1898, True, "normal", "info", None), (39343, 1898, True, "abnormal", "critical", "GPU temp > 80°C"),
                   (39344, 1898, True, "abnormal", "critical", "GPU temp > 80°C")]
    assert [(a["log_id"], a["alert_type"], a["status"]) for a in batch.alerts().orderBy("log_id").collect()] == [
        (39343, "abnormal", "pending"), (39344, "abnormal", "pending")]
    untaught = ingest_batch(lines_of(spark, lines), empty_table(spark, CATALOG), empty_table(spark, RULES), as_of=NOW, default_year=2025)
    assert [(l[7], l[8]) for l in logs_of(untaught)] == [(False, "unknown"), (True, "normal"), (True, "normal")]


def test_bandwidth_pack_first_rule_wins(spark):
    catalog, rules = bandwidth_pack(empty_table(spark, CATALOG), empty_table(spark, RULES), NOW)
    lines = [f"Jul 14 11:20:17 h kernel: [   19.033705] pci 0000:0{i}:00.0: {v} Gb/s available PCIe bandwidth, limited by 8.0 GT/s PCIe x4 link "
             f"at 0000:00:08.0 (capable of 63.012 Gb/s with 16.0 GT/s PCIe x4 link)" for i, v in enumerate(("15.752", "31.504", "64.000", "126.024"))]
    batch = ingest_batch(lines_of(spark, lines), catalog, rules, as_of=NOW, default_year=2025)
    assert [(l[8], l[9]) for l in logs_of(batch)] == [("abnormal", "warning"), ("abnormal", "warning"), ("normal", "info"), ("normal", "info")]
    assert batch.params.count() == 16
    severe = ingest_batch(lines_of(spark, lines), catalog, rules, as_of=NOW, default_year=2025, policy="most_severe")
    assert [l[9] for l in logs_of(severe)] == ["critical", "warning", "info", "info"]
    # Installing again updates the pattern and adds the rules once more.
    again_catalog, again_rules = bandwidth_pack(catalog, rules, NOW)
    assert (again_catalog.count(), again_rules.count()) == (1, 4)


def test_invariants(spark):
    lines = random_lines(11, 500)
    batch = ingest_batch(lines_of(spark, lines), catalog_of(spark), local_table(spark, RULE_ROWS, RULES), as_of=NOW, default_year=2025)
    counts = {r["classification"]: r["count"] for r in by_classification(batch.logs).collect()}
    assert batch.alerts().count() == counts.get("abnormal", 0) + counts.get("unknown", 0)
    auto = batch.catalog.agg(F.sum("total_count")).first()[0]
    by_hand = batch.templates.agg(F.sum("n")).first()[0]
    assert auto == by_hand
