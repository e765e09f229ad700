"""Rules: when a known line is abnormal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.regexes import compiles, first_of, java_spellings, python_search
from logloom.functions.text import float_text
from logloom.operators.joins import max_id
from logloom.operators.numbering import number_rows
from logloom.operators.params import pack_params
from logloom.session import local_table
from logloom.schemas import RULE_SEVERITIES, RULE_TYPES, RULES, THRESHOLD_OPS

TOLERANCE = 1e-4
_FIELDS = ("rule_id", "rule_type", "field_name", "op", "threshold1", "threshold2", "search_text",
           "severity_if_match", "is_abnormal_if_match", "message")


def threshold_test(op: str, value: Column, low: Column, high: Column) -> Column:
    """One comparison; NULL where a bound or the value is missing."""
    tests = {
        ">": lambda: value > low,
        ">=": lambda: value >= low,
        "<": lambda: value < low,
        "<=": lambda: value <= low,
        "==": lambda: F.abs(value - low) < TOLERANCE,
        "!=": lambda: F.abs(value - low) >= TOLERANCE,
        "between": lambda: value.between(low, high),
        "not_between": lambda: low.isNotNull() & high.isNotNull() & ~value.between(low, high),
    }
    return tests[op]() if op in tests else F.lit(False)


def threshold_holds(op: Column, value: Column, low: Column, high: Column) -> Column:
    """The comparison named by a column; a missing bound makes any of them false."""
    chosen = F.lit(None).cast("boolean")
    for name in THRESHOLD_OPS:
        chosen = F.when(op == name, threshold_test(name, value, low, high)).otherwise(chosen)
    return F.coalesce(chosen, F.lit(False))


def rule_holds(rule, message: Column, params: Column) -> Column:
    """Whether a rule held in columns holds for a message and its parameters.

    ``contains`` on a missing parameter is false, ``regex`` then looks at the
    message; ``search_text`` of a regex rule is in the JVM's dialect here.
    """
    kind, field, needle = rule["rule_type"], F.nullif(rule["field_name"], F.lit("")), rule["search_text"]
    param = F.try_element_at(params, field)
    text = F.coalesce(float_text(param["num"]), param["text"])
    hay = F.when(field.isNull(), message)
    contains = F.contains(F.coalesce(text, hay), needle)
    regex = F.rlike(F.coalesce(text, message), needle)
    return F.coalesce(
        F.when(kind == "threshold", threshold_holds(rule["op"], param["num"], rule["threshold1"], rule["threshold2"]))
        .when(kind == "contains", contains)
        .when(kind == "regex", regex),
        F.lit(False),
    )


_RANK = {"info": 1, "warning": 2, "critical": 3}
_VERDICT = "struct<severity:string,reason:string,is_abnormal:boolean>"


def _severity_rank(severity: str | None) -> int:
    return _RANK.get(severity or "", 0)


def active_rules(rules: DataFrame) -> tuple[DataFrame, list[int]]:
    """Active rules, regex texts in the JVM's dialect; and the ids of rules only Python can run.

    A rule whose regex is invalid can never hold and is left out.
    """
    active = rules.where("is_active")
    texts = active.where("rule_type = 'regex' and search_text is not null").select("search_text").distinct().collect()
    regexes = [r[0] for r in texts if compiles(r[0])]
    spelled = list(zip(regexes, java_spellings(rules.sparkSession, regexes)))
    dialect = local_table(rules.sparkSession, spelled, "search_text string, _java string")
    is_regex = F.col("rule_type") == "regex"
    known = dialect.withColumn("_known", F.lit(True))
    usable = active.join(known, "search_text", "left").where(~is_regex | F.col("_known"))
    by_python = usable.where(is_regex & F.col("_java").isNull()) if None in dict(spelled).values() else None
    ids = [r[0] for r in by_python.select("rule_id").collect()] if by_python is not None else []
    spelling = F.when(is_regex, F.coalesce("_java", "search_text")).otherwise(F.col("search_text"))
    return usable.withColumn("search_text", spelling).select(*RULES.fieldNames()), ids


def judge(
    logs: DataFrame,
    rules: DataFrame,
    policy: str = "first",
    honor_is_abnormal: bool = False,
    params: str = "params",
) -> DataFrame:
    """Add ``verdict`` (severity, reason, is_abnormal): the winning rule of the row's pattern, else NULL.

    ``logs`` has pattern_id, message and the parameter map. Policy ``first`` takes
    the lowest rule id, ``most_severe`` the highest severity. Rules are written by hand
    and become literals of an expression, guarded by their pattern: no row is
    multiplied or moved, and each regex is compiled once per task.
    """
    usable, by_python = active_rules(rules)
    listed = usable.select("pattern_id", *_FIELDS).collect()
    judged = logs.withColumn("verdict", _verdict_chain(listed, policy, params, set(by_python)))
    if honor_is_abnormal:
        judged = judged.withColumn("verdict", F.when(F.col("verdict.is_abnormal"), F.col("verdict")))
    return judged


def literal_rule_holds(row, message: Column, params: Column, by_python: bool = False) -> Column:
    """The same for a rule known now: only the test it asks for is built."""
    field, needle = row["field_name"], row["search_text"]
    param = params[field] if field else None
    if row["rule_type"] == "threshold":
        if not field:
            return F.lit(False)
        low, high = (F.lit(row[t]).cast("double") for t in ("threshold1", "threshold2"))
        return threshold_test(row["op"], param["num"], low, high)
    if needle is None:
        return F.lit(False)
    subject = F.coalesce(float_text(param["num"]), param["text"]) if field else message
    if row["rule_type"] == "contains":
        return F.contains(subject, F.lit(needle))
    if row["rule_type"] == "regex":
        subject = F.coalesce(subject, message) if field else message
        return python_search(needle)(subject) if by_python else F.rlike(subject, F.lit(needle))
    return F.lit(False)


def _verdict_chain(listed, policy: str, params: str, by_python: set[int]) -> Column:
    by_pattern: dict[int, list] = {}
    for row in sorted(listed, key=lambda r: r["rule_id"]):
        by_pattern.setdefault(row["pattern_id"], []).append(row)
    branches = []
    for pattern_id, rows in by_pattern.items():
        if policy == "most_severe":
            rows = sorted(rows, key=lambda r: -_severity_rank(r["severity_if_match"]))
        own = []
        for row in rows:
            holds = literal_rule_holds(row, F.col("message"), F.col(params), row["rule_id"] in by_python)
            verdict = F.struct(
                F.lit(row["severity_if_match"]).alias("severity"),
                F.lit(row["message"] or f"Rule {row['rule_id']} matched").alias("reason"),
                F.lit(row["is_abnormal_if_match"]).alias("is_abnormal"))
            own.append((holds, verdict.cast(_VERDICT)))
        branches.append((F.col("pattern_id") == pattern_id, first_of(own, F.lit(None).cast(_VERDICT))))
    return first_of(branches, F.lit(None).cast(_VERDICT))


def apply_verdict(logs: DataFrame) -> DataFrame:
    """A verdict overrides classification, severity and reason; then it is dropped."""
    hit = F.col("verdict").isNotNull()
    return logs.withColumns({
        "classification": F.when(hit, F.lit("abnormal")).otherwise(F.col("classification")),
        "severity": F.when(hit, F.col("verdict.severity")).otherwise(F.col("severity")),
        "anomaly_reason": F.when(hit, F.col("verdict.reason")).otherwise(F.col("anomaly_reason")),
    }).drop("verdict")


def check_logs(logs: DataFrame, params: DataFrame | None, rules: DataFrame, policy: str = "first") -> DataFrame:
    """Judge stored logs with their stored parameters.

    Log rows that carry their parameter map, as ingest writes them, are judged where
    they are: nothing moves. Tables T2 and T3 apart are joined first.
    """
    if "params" in logs.columns:
        with_params = logs
    else:
        ruled = rules.where("is_active").select("pattern_id").distinct()
        none = F.create_map().cast("map<string,struct<num:double,text:string>>")
        with_params = logs.join(ruled, "pattern_id", "left_semi").join(pack_params(params), "log_id", "left").withColumn(
            "params", F.coalesce("params", none))
    judged = judge(with_params, rules, policy).where("verdict is not null")
    return judged.select("log_id", F.col("verdict.severity").alias("severity"),
                         F.col("verdict.reason").alias("anomaly_reason"),
                         F.col("verdict.is_abnormal").alias("is_abnormal"))


def checked_rules(new_rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Complete new rules and tell why a row cannot be added (``reject_reason``, NULL when fine)."""
    kind, op = F.col("rule_type"), F.col("op")
    exists = catalog.select("pattern_id", F.lit(True).alias("_exists"))
    t1, t2 = (F.coalesce(float_text(F.col(c)), F.lit("None")) for c in ("threshold1", "threshold2"))
    text = (
        F.when(kind == "contains", F.format_string("Message contains '%s'", F.col("search_text")))
        .when(kind == "regex", F.format_string("Message matches pattern '%s'", F.col("search_text")))
        .when(op == "between", F.concat_ws("", F.col("field_name"), F.lit(" between "), t1, F.lit(" and "), t2))
        .when(op == "not_between", F.concat_ws("", F.col("field_name"), F.lit(" not between "), t1, F.lit(" and "), t2))
        .otherwise(F.concat_ws(" ", F.col("field_name"), op, t1))
    )
    reason = (
        F.when(F.col("seq").isNull(), F.lit("seq is required"))
        .when(F.col("_exists").isNull(), F.lit("pattern not found"))
        .when(~F.coalesce(kind.isin(*RULE_TYPES), F.lit(False)), F.lit("unknown rule type"))
        .when((kind == "threshold") & F.nullif(F.col("field_name"), F.lit("")).isNull(), F.lit("field_name is required"))
        .when((kind == "threshold") & ~F.coalesce(op.isin(*THRESHOLD_OPS), F.lit(False)), F.lit("op is required"))
        .when((kind == "threshold") & F.col("threshold1").isNull(), F.lit("threshold1 is required"))
        .when((kind != "threshold") & F.col("search_text").isNull(), F.lit("search_text is required"))
        .when(~F.coalesce(F.col("severity_if_match").isin(*RULE_SEVERITIES), F.lit(False)), F.lit("unknown severity"))
    )
    return (
        new_rules.join(exists, "pattern_id", "left")
        .withColumn("reject_reason", reason)
        .withColumn("message", F.coalesce(F.nullif(F.col("message"), F.lit("")), text))
        .withColumn("op", F.when(kind == "contains", F.lit("contains")).when(kind == "regex", F.lit("matches")).otherwise(op))
        .drop("_exists")
    )


def add_rules(rules: DataFrame, new_rules: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append rules in ``seq`` order with the next ids; returns (all rules, rejected rows)."""
    checked = checked_rules(new_rules, catalog)
    good = number_rows(checked.where("reject_reason is null"), "seq", max_id(rules, "rule_id"), "rule_id")
    return rules.unionByName(good.select(*RULES.fieldNames())), checked.where("reject_reason is not null")
