"""Extracting named parameters from matched messages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.regexes import TRIED, Pattern, first_of
from logloom.functions.text import number_prefix

_TEXTS = "map<string,string>"
_VALUES = "map<string,struct<num:double,text:string>>"


def group_texts(message: Column, pattern_id: Column, patterns: list[Pattern], tried: int = TRIED) -> Column:
    """Map of group name to captured text for the row's pattern; empty when it has none.

    A group that took no part in the match, or captured nothing, is left out.
    """
    named = [p for p in patterns if p.groups]
    # Many patterns are looked up by id instead of being compared with it one after the other.
    native = [p for p in named if p.java is not None] if len(named) <= tried else []
    others = [p for p in named if p.java is None] if len(named) <= tried else named

    def own(p: Pattern) -> Column:
        captured = F.array(*[
            F.struct(F.lit(name).alias("key"), F.regexp_extract(message, p.java, index).alias("value"))
            for name, index in p.groups
        ])
        return F.map_from_entries(F.filter(captured, lambda e: e["value"] != "")).cast(_TEXTS)

    texts = first_of([(pattern_id == p.pattern_id, own(p)) for p in native], F.create_map().cast(_TEXTS))
    if others and native:
        ids = [p.pattern_id for p in others]
        texts = F.when(pattern_id.isin(ids), _python_groups(others)(message, pattern_id)).otherwise(texts)
    elif others:
        texts = _python_groups(others)(message, pattern_id)
    return texts


def _python_groups(patterns: list[Pattern]):
    regexes = {p.pattern_id: p.regex for p in patterns}

    @F.pandas_udf(_TEXTS)
    def groups(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        compiled = {}

        def one(text, i):
            if text is None or i not in regexes:
                return {}
            if i not in compiled:
                compiled[i] = re.compile(regexes[i])
            match = compiled[i].search(text)
            return {k: v for k, v in match.groupdict().items() if v} if match else {}

        for message, pattern_id in batches:
            yield pd.Series([one(m, i) for m, i in zip(message, pattern_id)], dtype=object)

    return groups


def typed(texts: Column) -> Column:
    """Captured texts with the number each starts with."""
    return F.transform_values(
        texts, lambda _, v: F.struct(number_prefix(v).alias("num"), v.alias("text"))
    ).cast(_VALUES)


def params_of(message: Column, pattern_id: Column, patterns: list[Pattern]) -> Column:
    """``map<name, struct<num, text>>`` of the row's parameters."""
    return typed(group_texts(message, pattern_id, patterns))


def explode_params(rows: DataFrame, params: str = "params") -> DataFrame:
    """Long form (T3): one row per log and parameter."""
    return rows.select("log_id", F.explode(params).alias("param_name", "value")).select(
        "log_id", "param_name",
        F.col("value.num").alias("param_value_num"), F.col("value.text").alias("param_value_text"),
    )


def pack_params(params: DataFrame) -> DataFrame:
    """Back from long form to one map per log; a log has one row per named group only."""
    entry = F.struct(F.col("param_name"), F.struct(
        F.col("param_value_num").alias("num"), F.col("param_value_text").alias("text")))
    return params.groupBy("log_id").agg(
        F.map_from_entries(F.collect_list(entry)).cast(_VALUES).alias("params")
    )
