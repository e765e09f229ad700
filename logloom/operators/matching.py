"""Matching messages against hand-written patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.regexes import TRIED, Pattern, first_of, load_patterns
from logloom.operators.changes import last_per_key


def manual_patterns(catalog: DataFrame) -> list[Pattern]:
    """Hand-written patterns of the catalog, on the driver because expressions are built from them."""
    rows = (
        catalog.where(F.col("manual_regex_rule").isNotNull())
        .select("pattern_id", F.col("manual_regex_rule").alias("regex"), "label", "severity", "component")
        .collect()
    )
    return load_patterns(catalog.sparkSession, rows)


def found_in(message: Column, pattern: Pattern) -> Column:
    """Whether the pattern is found in the message; a plain-text test goes first."""
    test = F.rlike(message, F.lit(pattern.java))
    text = pattern.fragment
    return F.contains(message, F.lit(text)) & test if text else test


def match_id(message: Column, patterns: list[Pattern], component: Column | None = None, tried: int = TRIED) -> Column:
    """Id of the matching pattern with the lowest id, NULL when none matches.

    With ``component``, a pattern that names a component applies to that one only.
    Up to ``tried`` patterns are literals of an expression, each compiled once per task; only those
    that have no spelling for the JVM are tested in Arrow batches. More patterns are looked up in one
    pass over the message (:class:`Literals`), so a line costs what its candidates cost,
    whatever their number. A pattern means the same on both ways.
    """
    native = [p for p in patterns if p.java is not None] if len(patterns) <= tried else []
    others = [p for p in patterns if p.java is None] if len(patterns) <= tried else patterns
    chain = first_of([
        (_in_scope(p, component) & found_in(message, p) if component is not None else found_in(message, p), F.lit(p.pattern_id).cast("bigint"))
        for p in sorted(native, key=lambda p: p.pattern_id)], F.lit(None).cast("bigint"))
    if not others:
        return chain
    scope = F.lit(None).cast("string") if component is None else component
    found = _python_match(others, component is not None)(message, scope)
    return F.least(chain, found) if native else found


class Literals:
    """Which patterns can match a text: one pass over it finds the plain texts that every match must contain.

    An Aho-Corasick automaton over the required texts; patterns that require none are always candidates.
    """

    def __init__(self, fragments: list[str]):
        self.always, held = [], {}
        for place, fragment in enumerate(fragments):
            (held.setdefault(fragment, []) if fragment else self.always).append(place)
        self.automaton = ahocorasick.Automaton()
        for fragment, places in held.items():
            self.automaton.add_word(fragment, places)
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def candidates(self, text: str) -> list[int]:
        """Places of the patterns whose required text occurs, in ascending order."""
        if self.empty:
            return self.always
        met = {place for _, places in self.automaton.iter(text) for place in places}
        return sorted([*met, *self.always]) if met else self.always


def _in_scope(pattern: Pattern, component: Column) -> Column:
    if pattern.component is None:
        return F.lit(True)
    return F.coalesce(component == F.lit(pattern.component), F.lit(False))


def _python_match(patterns: list[Pattern], scoped: bool):
    tests = [(p.pattern_id, p.regex, p.fragment, p.component) for p in sorted(patterns, key=lambda p: p.pattern_id)]

    @F.pandas_udf("bigint")
    def lowest_match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        literals, compiled = Literals([t[2] for t in tests]), {}

        def first(text, comp):
            if text is None:
                return None
            for place in literals.candidates(text):
                i, regex, _, scope = tests[place]
                if scoped and scope is not None and scope != comp:
                    continue
                if place not in compiled:
                    compiled[place] = re.compile(regex)
                if compiled[place].search(text):
                    return i
            return None

        for message, component in batches:
            yield pd.Series([first(m, c) for m, c in zip(message, component)], dtype="Int64")

    return lowest_match


def match_by_component(logs: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Component-scoped match: adds ``matched_id``, ``matched_severity`` and the named groups as text."""
    from logloom.operators.params import group_texts

    ids = F.col("matched_id")
    severity = first_of([(ids == p.pattern_id, F.lit(p.severity)) for p in patterns if p.severity is not None], F.lit(None).cast("string"))
    return (
        logs.withColumn("matched_id", match_id(F.col("message"), patterns, F.col("component")))
        .withColumn("matched_severity", severity)
        .withColumn("matched_groups", group_texts(F.col("message"), ids, patterns))
    )


def update_logs(logs: DataFrame, updates: DataFrame) -> DataFrame:
    """Set known flag, classification and severity of logs; a NULL pattern keeps the old one, a log's last update counts."""
    new = last_per_key(updates, "log_id").select(
        "log_id", F.col("pattern_id").alias("_pattern"), F.col("is_known").alias("_known"),
        F.col("classification").alias("_class"), F.col("severity").alias("_severity"),
        F.lit(True).alias("_hit"),
    )
    hit = F.col("_hit").isNotNull()
    return (
        logs.join(new, "log_id", "left")
        .withColumns({
            "pattern_id": F.coalesce("_pattern", "pattern_id"),
            "is_known": F.when(hit, F.col("_known")).otherwise(F.col("is_known")),
            "classification": F.when(hit, F.col("_class")).otherwise(F.col("classification")),
            "severity": F.when(hit, F.col("_severity")).otherwise(F.col("severity")),
        })
        .select(*logs.columns)
    )
