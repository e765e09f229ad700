import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.functions.regexes import load_patterns
from logloom.operators import rules as ops
from logloom.operators.matching import Literals, match_id
from logloom.operators.params import group_texts, pack_params
from logloom.schemas import CATALOG, PARAMS, RULES
from logloom.session import local_table
from tests.sequential import holds
from tests.test_ingest import rule

NOW = dt.datetime(2025, 8, 1)
OPS = (">", ">=", "<", "<=", "==", "!=", "between", "not_between")

# (message, {name: text})
CASES = [
    ("ERROR disk 5", {"v": "50", "w": "16M"}), ("fine", {"v": "50.00005", "w": "abc"}), ("user b", {"v": "49.9", "w": "x7"}),
    ("plain", {}), ("12345678 big", {"v": "12345678", "w": "-3.5e"}), ("", {"w": "60"}),
]


def rule_rows():
    rows, n = [], 0
    for op in OPS:
        for low, high in ((50.0, 60.0), (50.0, None), (None, None)):
            n += 1
            rows.append(rule(n, n, "threshold", "v", op, low, high))
    for field, text in ((None, "ERROR"), ("v", "50.0"), ("v", "12345678.0"), ("w", "16.0"), ("w", "a"), ("gone", "x"), (None, None), ("", "ERR")):
        n += 1
        rows.append(rule(n, n, "contains", field, text=text))
    for field, text in ((None, ".*ERROR.*"), ("w", "^abc$"), ("gone", "user"), (None, "("), (None, None), ("v", r"\.0$"), (None, r"(\w+ )+b")):
        n += 1
        rows.append(rule(n, n, "regex", field, text=text))
    n += 1
    rows.append(rule(n, n, "threshold", None, ">", 1.0))
    rows.append(rule(n + 1, n + 1, "threshold", "w", ">", 1.0))
    return rows


def judged(spark, rows, cases, policy="first"):
    from tests.sequential import numeric

    table = local_table(spark, rows, RULES)
    logs, params = [], []
    for i, (message, found) in enumerate(cases):
        for j, row in enumerate(rows):
            log_id = i * 1000 + j
            logs.append((log_id, row[1], message))
            params += [(log_id, k, numeric(v), v) for k, v in found.items()]
    frame = local_table(spark, logs, "log_id bigint, pattern_id bigint, message string")
    packed = pack_params(local_table(spark, params, PARAMS))
    none = F.create_map().cast("map<string,struct<num:double,text:string>>")
    with_params = frame.join(packed, "log_id", "left").withColumn("params", F.coalesce("params", none))
    return {r["log_id"]: r["verdict"] for r in ops.judge(with_params, table, policy).collect()}


def test_every_predicate(spark):
    from tests.sequential import numeric

    rows = rule_rows()
    got = judged(spark, rows, CASES)
    names = RULES.fieldNames()
    for i, (message, found) in enumerate(CASES):
        values = {k: (numeric(v), v) for k, v in found.items()}
        for j, row in enumerate(rows):
            expected = holds(dict(zip(names, row)), message, values)
            assert (got[i * 1000 + j] is not None) == expected, (message, found, row)


@pytest.mark.parametrize("policy", ["first", "most_severe"])
def test_more_rules_change_no_verdict(spark, policy):
    rows = [r for r in rule_rows() if r[7] not in (r"(\w+ )+b",)]
    rows = [(*r[:1], r[1] % 4, *r[2:8], ("info", "critical", "warning")[r[0] % 3], *r[9:]) for r in rows]
    chained = judged(spark, rows, CASES, policy)
    last, own = max(r[0] for r in rows), {r[1] for r in rows}
    more = [(last + 1 + i, next(k for k in range(i * 7 + 1000, i * 7 + 1007) if k not in own), *rows[i % len(rows)][2:]) for i in range(600)]
    got = judged(spark, rows + more, CASES, policy)
    assert {k: v for k, v in got.items() if k in chained} == chained


def test_honor_is_abnormal(spark):
    frame = local_table(spark, [(1, 1, "x")], "log_id bigint, pattern_id bigint, message string").withColumn(
        "params", F.create_map().cast("map<string,struct<num:double,text:string>>"))
    table = local_table(spark, [(1, 1, "contains", None, "contains", None, None, "x", "info", False, None, True)], RULES)
    verdict = ops.judge(frame, table).first()["verdict"]
    assert verdict.reason == "Rule 1 matched" and not verdict.is_abnormal
    assert ops.judge(frame, table, honor_is_abnormal=True).first()["verdict"] is None


def test_add_rules(spark):
    catalog = local_table(spark, [(7, "a", None, "s", "normal", None, None, None, False, NOW, NOW, 1, None)], CATALOG)
    old = local_table(spark, [rule(4, 7, "contains", text="x")], RULES)
    columns = ("seq bigint, pattern_id bigint, rule_type string, field_name string, op string, threshold1 double, threshold2 double, "
               "search_text string, severity_if_match string, is_abnormal_if_match boolean, message string, is_active boolean")
    new = local_table(spark, [
        (1, 7, "threshold", "temp", ">", 80.0, None, None, "critical", True, None, True),
        (2, 7, "threshold", "temp", "between", 1.5, 2.0, None, "info", True, "", True),
        (3, 7, "contains", None, ">", None, None, "ERR", "info", True, None, True),
        (4, 7, "regex", None, None, None, None, ".*", "info", True, "own", True),
        (5, 8, "contains", None, None, None, None, "x", "info", True, None, True),
        (6, 7, "threshold", None, ">", 1.0, None, None, "info", True, None, True),
        (7, 7, "threshold", "t", "~", 1.0, None, None, "info", True, None, True),
        (8, 7, "threshold", "t", ">", None, None, None, "info", True, None, True),
        (9, 7, "contains", None, None, None, None, None, "info", True, None, True),
        (10, 7, "odd", None, None, None, None, None, "info", True, None, True),
        (11, 7, "contains", None, None, None, None, "x", "unknown", True, None, True),
        (12, 7, "threshold", "temp", "not_between", 1.0, None, None, "info", True, None, True),
    ], columns)
    rules, rejected = ops.add_rules(old, new, catalog)
    got = {r["rule_id"]: (r["op"], r["message"]) for r in rules.collect()}
    assert got == {4: (None, None), 5: (">", "temp > 80.0"), 6: ("between", "temp between 1.5 and 2.0"), 7: ("contains", "Message contains 'ERR'"),
                   8: ("matches", "own"), 9: ("not_between", "temp not between 1.0 and None")}
    assert {r["seq"] for r in rejected.collect()} == {5, 6, 7, 8, 9, 10, 11}


def test_many_patterns_are_looked_up(spark):
    """The index of required texts gives what trying one pattern after the other gives."""
    regexes = [r"alpha \d+ beta", r"beta", r"\d{3,}", r"(alpha|gamma) x", r"alpha (?P<n>\d+)", r"a.*z", r"gamma\s+(?P<n>\w+)", r"(?i)DELTA", r"\bbeta\b.* (?P<n>\d)$", r"\(x\)\+"]
    rows = local_table(spark, [(10 * i + 5, r, "normal", "info", "k" if i % 4 == 3 else None) for i, r in enumerate(regexes)],
                       "pattern_id bigint, regex string, label string, severity string, component string").collect()
    patterns = load_patterns(spark, rows)
    texts = ["alpha 1 beta", "beta", "alphabeta", "x 1234", "gamma x", "gamma  word", "dElta", "the beta has 7", "(x)+", "", None, "nothing", "a bc z", "alpha 12", "alpha  beta 9"]
    messages = local_table(spark, [(t, c) for t in texts for c in ("k", "other", None)], "message string, component string").repartition(3)

    def run(tried):
        message, ids = F.col("message"), F.col("plain")
        got = messages.withColumn("plain", match_id(message, patterns, tried=tried)).withColumn("scoped", match_id(message, patterns, F.col("component"), tried))
        return Counter(map(repr, got.select("*", group_texts(message, ids, patterns, tried).alias("groups")).collect()))

    assert run(0) == run(512) == run(5)
    assert Literals(["ab", "", "b", "ab"]).candidates("xaby") == [0, 1, 2, 3] and Literals(["q"]).candidates("") == [] and Literals([""]).candidates("") == [0]
