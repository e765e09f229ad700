"""Ready-made pattern and rule packs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from logloom.operators.catalog import add_patterns
from logloom.operators.rules import add_rules
from logloom.session import local_table

# The link bandwidth pattern, its sample and its two limits.
BANDWIDTH_REGEX = (
    r"\[\s+\d+\.\d+\]\s+pci\s+[0-9a-fA-F]{4}:[0-9a-fA-F]{2}:[0-9a-fA-F]{2}\.[0-9a-fA-F]:\s+"
    r"(?P<available_bandwidth>\d+\.?\d*)\s+Gb/s\s+available\s+PCIe\s+bandwidth,\s+limited\s+by\s+"
    r"(?P<limited_by_speed>\d+\.?\d*)\s+GT/s\s+PCIe\s+x\d+\s+link\s+at\s+"
    r"[0-9a-fA-F]{4}:[0-9a-fA-F]{2}:[0-9a-fA-F]{2}\.[0-9a-fA-F]\s+\(capable\s+of\s+"
    r"(?P<capable_bandwidth>\d+\.?\d*)\s+Gb/s\s+with\s+(?P<capable_speed>\d+\.?\d*)\s+GT/s\s+PCIe\s+x\d+\s+link\)"
)
BANDWIDTH_SAMPLE = (
    "[   19.033705] pci 0000:01:00.0: 31.504 Gb/s available PCIe bandwidth, limited by 8.0 GT/s PCIe x4 link "
    "at 0000:00:08.0 (capable of 63.012 Gb/s with 16.0 GT/s PCIe x4 link)"
)
BANDWIDTH_NOTE = (
    "PCIe帯域幅ログ（available_bandwidth, limited_by_speed, capable_bandwidth, capable_speedを抽出可能）"
)
BANDWIDTH_LIMITS = (
    (50.0, "warning", "PCIe available bandwidth <= 50 Gb/s (性能低下の可能性)"),
    (30.0, "critical", "PCIe available bandwidth <= 30 Gb/s (重大な性能低下)"),
)


def install_pack(
    catalog: DataFrame, rules: DataFrame, patterns: DataFrame, pack_rules: DataFrame, as_of: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """Install patterns (as for ``add_patterns``) and their rules (``seq``, ``pattern_seq``, rule columns).

    Installing again updates the patterns and adds the rules once more.
    """
    added = add_patterns(catalog, patterns, as_of, update_existing=True)
    ids = added.assigned.withColumnRenamed("seq", "pattern_seq")
    bound = pack_rules.drop("pattern_id").join(ids, "pattern_seq").drop("pattern_seq")
    all_rules, _ = add_rules(rules, bound, added.catalog)
    return added.catalog, all_rules


def bandwidth_pack(catalog: DataFrame, rules: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """The link bandwidth pattern with its warning and critical limits."""
    spark = catalog.sparkSession
    patterns = local_table(
        spark, [(0, BANDWIDTH_REGEX, BANDWIDTH_SAMPLE, "normal", "info", "kernel", BANDWIDTH_NOTE)],
        "seq bigint, regex string, sample_message string, label string, severity string, component string, note string",
    )
    limits = local_table(
        spark, [(i, 0, "threshold", "available_bandwidth", "<=", limit, None, None, severity, True, text, True)
         for i, (limit, severity, text) in enumerate(BANDWIDTH_LIMITS)],
        "seq bigint, pattern_seq bigint, rule_type string, field_name string, op string, threshold1 double, "
        "threshold2 double, search_text string, severity_if_match string, is_abnormal_if_match boolean, "
        "message string, is_active boolean",
    )
    return install_pack(catalog, rules, patterns, limits, as_of)
