"""Running patterns and rules again over all stored logs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from logloom.functions.text import wall_time
from logloom.functions.regexes import load_patterns
from logloom.operators.matching import found_in, match_id
from logloom.operators.params import explode_params, pack_params, params_of
from logloom.operators.rules import apply_verdict, judge
from logloom.plans.ingest import classify


@dataclass(frozen=True)
class Reprocessed:
    """Log rows after the run, with their parameter map; ``is_taken`` are those the pattern took, ``is_judged`` those a rule hit.

    A job that keeps several of the results writes ``rows`` first and derives the rest from
    what was written (:meth:`over`).
    """

    rows: DataFrame
    columns: tuple[str, ...]

    def over(self, rows: DataFrame) -> "Reprocessed":
        return Reprocessed(rows, self.columns)

    @property
    def logs(self) -> DataFrame:
        return self.rows.select(*self.columns)

    @property
    def params(self) -> DataFrame:
        return explode_params(self.rows)

    @property
    def matched(self) -> DataFrame:
        return self.rows.where("is_taken")

    @property
    def stats(self) -> DataFrame:
        return self.matched.agg(
            F.count("*").alias("matched_logs"),
            F.count_if(F.size("params") > 0).alias("logs_with_params"),
            F.count_if("is_judged").alias("abnormal_logs"),
        )


def reprocess_pattern(
    logs: DataFrame,
    params: DataFrame | None,
    catalog: DataFrame,
    rules: DataFrame,
    pattern_id: int,
    as_of: dt.datetime,
    policy: str = "first",
) -> Reprocessed:
    """Give every log the pattern is found in to that pattern, extract and judge anew.

    One projection over the logs, without a shuffle, where the rows carry their parameter
    map as ingest writes them; else the table of parameters is packed and joined first.
    """
    row = catalog.where(F.col("pattern_id") == pattern_id).select(
        "pattern_id", F.coalesce("manual_regex_rule", "regex_rule").alias("regex"), "label", "severity").first()
    if row is None:
        raise LookupError(f"pattern {pattern_id} not found")
    loaded = load_patterns(catalog.sparkSession, [row])
    if not loaded:
        raise ValueError(f"pattern {pattern_id} is no valid regex")
    pattern = loaded[0]
    message = F.col("message")
    found = found_in(message, pattern) if pattern.java else match_id(message, loaded).isNotNull()
    own_rules = rules.where(F.col("pattern_id") == pattern_id)

    rows = logs if "params" in logs.columns else logs.join(pack_params(params), "log_id", "left")
    taken = F.col("is_taken")

    def now(value, column: str):
        return F.when(taken, value).otherwise(F.col(column))

    # Params apart, a log without any has no map; with the map it may be NULL as well.
    none = F.create_map().cast("map<string,struct<num:double,text:string>>")
    rows = rows.withColumn("is_taken", F.coalesce(found, F.lit(False)))
    rows = rows.withColumns({
        "pattern_id": now(F.lit(pattern_id).cast("bigint"), "pattern_id"),
        "is_known": now(F.lit(True), "is_known"),
        "classification": now(classify(F.lit(True), F.lit(pattern.label)), "classification"),
        "severity": now(F.lit(pattern.severity).cast("string"), "severity"),
        "updated_at": now(wall_time(as_of), "updated_at"),
        "params": F.when(taken, params_of(message, F.lit(pattern_id), loaded)).otherwise(F.coalesce("params", none)),
    })
    # Logs that had the pattern before and are not taken keep what they have.
    judged = judge(rows, own_rules, policy).withColumn("verdict", F.when(taken, F.col("verdict")))
    done = apply_verdict(judged.withColumn("is_judged", F.col("verdict").isNotNull()))
    return Reprocessed(done, tuple(c for c in logs.columns if c != "params"))
