"""A plain model of the system: one line after the other, in Python. The yardstick for the set operations."""

from __future__ import annotations

import datetime as dt
import re

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
SYSLOG = re.compile(r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?):\s+(.*)$")
HEX = re.compile(r"(0[xX][0-9A-Fa-f]+)")
TOKEN = re.compile(r"(\s+)|(\d+)|([()\[\]{}?*+\-|^$\\.&~#])")


def parse(line, year, now):
    line = line.strip()
    m = SYSLOG.match(line)
    if not m:
        return now, None, None, line, line
    month, day, clock = m.group(1).split()
    try:
        hour, minute, second = map(int, clock.split(":"))
        ts = dt.datetime(year, MONTHS.index(month) + 1, int(day), hour, minute, second)
    except ValueError:
        ts = now
    return ts, m.group(2), m.group(3), m.group(4), line


def template(message):
    def swap(m):
        if m.group(1):
            return r"\s+"
        return r"\d+" if m.group(2) else "\\" + m.group(3)

    parts = HEX.split(message)
    return "".join("0x[0-9A-Fa-f]+" if i % 2 else TOKEN.sub(swap, part) for i, part in enumerate(parts))


def numeric(text):
    m = re.match(r"^([+-]?\d+\.?\d*)", text)
    return float(m.group(1)) if m else None


def holds(rule, message, params):
    field = rule["field_name"]
    value = params.get(field) if field else None
    value = None if value is None else (value[0] if value[0] is not None else value[1])
    if rule["rule_type"] == "threshold":
        low, high, op = rule["threshold1"], rule["threshold2"], rule["op"]
        if not isinstance(value, float) or low is None:
            return False
        if op in ("between", "not_between"):
            if high is None:
                return False
            return (low <= value <= high) == (op == "between")
        return {">": value > low, ">=": value >= low, "<": value < low, "<=": value <= low,
                "==": abs(value - low) < 1e-4, "!=": abs(value - low) >= 1e-4}[op]
    needle = rule["search_text"]
    if needle is None:
        return False
    if rule["rule_type"] == "contains":
        if field:
            return value is not None and needle in str(value)
        return needle in message
    try:
        return re.search(needle, str(value) if field and value is not None else message) is not None
    except re.error:
        return False


class Model:
    """State of the system. ``patterns``: dicts with id, regex (auto), manual, label, severity, count, sample."""

    def __init__(self, patterns=(), rules=(), first_log_id=1):
        self.patterns = [dict(p) for p in patterns]
        self.rules = sorted(rules, key=lambda r: r["rule_id"])
        self.logs, self.params, self.alerts = [], [], []
        self.next_log = first_log_id

    def by_hand(self, message):
        for p in sorted(self.patterns, key=lambda p: p["id"]):
            if p["manual"] is not None:
                try:
                    if re.search(p["manual"], message):
                        return p
                except re.error:
                    pass
        return None

    def learn(self, message):
        text = template(message)
        if not text:
            return None, False
        for p in self.patterns:
            if text in (p["regex"], p["manual"]):
                p["count"] += 1
                return p, False
        new = {"id": max([p["id"] for p in self.patterns], default=0) + 1, "regex": text, "manual": None,
               "label": "normal", "severity": None, "count": 1, "sample": message}
        self.patterns.append(new)
        return new, True

    def ingest(self, line, year, now):
        ts, host, component, message, raw = parse(line, year, now)
        pattern, new = self.by_hand(message), False
        if pattern is None:
            pattern, new = self.learn(message)
        known = pattern is not None and not new
        kind, severity, reason = "unknown", None, None
        found = {}
        if known:
            kind = "normal" if pattern["label"] == "unknown" else pattern["label"]
            severity = pattern["severity"]
            try:
                m = re.search(pattern["manual"] or pattern["regex"], message)
            except re.error:
                m = None
            if m:
                found = {k: (numeric(v), v) for k, v in m.groupdict().items() if v}
            for rule in self.rules:
                if rule["is_active"] and rule["pattern_id"] == pattern["id"] and holds(rule, message, found):
                    kind, severity = "abnormal", rule["severity_if_match"]
                    reason = rule["message"] or f"Rule {rule['rule_id']} matched"
                    break
        log_id, self.next_log = self.next_log, self.next_log + 1
        self.logs.append((log_id, ts, host, component, raw, message, pattern and pattern["id"], known, kind, severity, reason))
        self.params += [(log_id, k, num, text) for k, (num, text) in found.items()]
        if kind in ("abnormal", "unknown"):
            self.alerts.append((len(self.alerts) + 1, log_id, kind))
