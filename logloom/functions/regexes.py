"""Hand-written patterns: check them, find their groups, express them for the JVM.

Patterns are written in Python's dialect. The JVM engine runs them after a few
spelling changes; a pattern the JVM cannot run is still usable through an Arrow
UDF (see ``operators.matching``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

from logloom.functions.text import SPACE_MEMBERS

#: Patterns that are tried one after the other in an expression; more of them are looked up, by the plain texts they require or by id.
TRIED = 64

NAMED_GROUP = r"\(\?P<[^>]+>"


def has_named_groups(regex: Column) -> Column:
    return F.coalesce(F.rlike(regex, F.lit(NAMED_GROUP)), F.lit(False))


def group_names(regex: Column) -> Column:
    """Names of the named groups of a pattern column, in order."""
    return F.coalesce(
        F.regexp_extract_all(regex, F.lit(r"\(\?P<([^>]+)>"), F.lit(1)),
        F.array().cast("array<string>"),
    )


@F.pandas_udf(T.BooleanType())
def is_valid_regex(regex: pd.Series) -> pd.Series:
    """Whether Python can compile the pattern. For catalog rows, never for log lines."""
    return regex.map(compiles)


@dataclass(frozen=True)
class Pattern:
    """A hand-written pattern ready to be put into expressions."""

    pattern_id: int
    regex: str
    label: str | None = None
    severity: str | None = None
    component: str | None = None
    java: str | None = None          # None: only Python can run it
    groups: tuple[tuple[str, int], ...] = ()

    @property
    def fragment(self) -> str:
        return required_text(self.regex)


# Members of Python's classes, as both engines understand them: of texts, and under the flag ``a``.
_MEMBERS = {"w": r"\p{L}\p{N}_", "s": SPACE_MEMBERS, "d": r"\p{Nd}"}
_ASCII_MEMBERS = {"w": "A-Za-z0-9_", "s": r" \t\n\x0b\f\r", "d": "0-9"}


def to_java(regex: str) -> str | None:
    """Java spelling of a valid Python pattern, None where there is none.

    ``d`` keeps ``.`` and ``$`` to plain newlines as in Python. The engines differ in what
    ``\\w``, ``\\s``, ``\\d`` and ``\\b`` mean, so those are spelled out.
    """
    numbers = {name: index for name, index in re.compile(regex).groupindex.items()}
    flags, out, i, in_class, members, negated = "d", [], 0, False, _MEMBERS, False
    lead = re.match(r"\(\?([aiLmsux]+)\)", regex)
    if lead:
        wanted = lead.group(1)
        members = _ASCII_MEMBERS if "a" in wanted else _MEMBERS
        flags += "".join(c for c in wanted if c in "imsx") + ("u" if "i" in wanted and "a" not in wanted else "")
        i = lead.end()
    while i < len(regex):
        c, rest = regex[i], regex[i:]
        if c == "\\" and rest[1:2].lower() in ("w", "s", "d"):
            step, kind = 2, rest[1]
            if not in_class:
                text = f"[{'^' * kind.isupper()}{members[kind.lower()]}]"
            elif kind.islower():
                text = members[kind]
            elif negated:
                return None
            else:
                text = f"[^{members[kind.lower()]}]"
        elif c == "\\" and rest[1:2] in ("b", "B") and not in_class:
            w = f"[{members['w']}]"
            step = 2
            text = f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))" if rest[1] == "b" else f"(?:(?<={w})(?={w})|(?<!{w})(?!{w})(?!\\A\\z))"
        elif c == "\\":
            step, text = _escape(rest, in_class)
        elif in_class:
            # Java reads a second '[' or '&&' inside a class as class algebra.
            step, text = 1, ("\\" + c if c in "[&" else c)
            in_class = c != "]"
        elif c == "[":
            head = re.match(r"\[\^?\]?", rest).group(0)
            step, text, in_class, negated = len(head), head.replace("]", r"\]"), True, head.startswith("[^")
        elif named := re.match(r"\(\?P<(\w+)>", rest):
            step, text = named.end(), "("
        elif back := re.match(r"\(\?P=(\w+)\)", rest):
            step, text = back.end(), f"(?:\\{numbers[back.group(1)]})"
        elif remark := re.match(r"\(\?#[^)]*\)", rest):
            step, text = remark.end(), ""
        elif c == "{" and not re.match(r"\{(\d+(,\d*)?|,\d+)\}", rest):
            step, text = 1, r"\{"
        elif least := re.match(r"\{,(\d+)\}", rest):
            step, text = least.end(), f"{{0,{least.group(1)}}}"
        else:
            step, text = 1, c
        out.append(text)
        i += step
    return f"(?{flags})" + "".join(out)


def _escape(rest: str, in_class: bool) -> tuple[int, str]:
    c = rest[1:2]
    if c == "Z":
        return 2, r"\z"
    if c == "v":
        return 2, r"\x0B"
    if c == "b" and in_class:
        return 2, r"\x08"
    if c == "U":
        return 10, f"\\x{{{rest[2:10]}}}"
    if octal := re.match(r"\\0[0-7]{0,2}", rest):
        return octal.end(), f"\\x{int(octal.group(0)[1:], 8):02x}"
    return 2, rest[:2]


def required_text(regex: str) -> str:
    """The longest plain text every match must contain, ``''`` if none is certain.

    Only text outside groups and classes counts, and only in patterns without flags
    and without alternatives outside groups.
    """
    if "(?" in re.sub(r"\(\?(P<\w+>|:)", "(", regex):
        return ""
    runs, run, depth, i = [], "", 0, 0
    token = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)
    quantifier = re.compile(r"[*+?]|\{\d*,?\d*\}")
    while i < len(regex):
        piece = token.match(regex, i).group(0)
        i += len(piece)
        depth += (piece == "(") - (piece == ")")
        if piece == "|" and not depth:
            return ""
        literal = piece[1:] if re.fullmatch(r"\\[^A-Za-z0-9]", piece, re.S) else (
            piece if re.fullmatch(r"[^\\\[\](){}.^$*+?]", piece, re.S) else None
        )
        repeated = quantifier.match(regex, i)
        if literal is None or depth or repeated:
            runs.append(run)
            run = ""
        else:
            run += literal
        if repeated:
            i = repeated.end()
            while i < len(regex) and regex[i] in "?+":
                i += 1
    return max([*runs, run], key=len)


def jvm_accepts(spark: SparkSession, java: list[str]) -> list[bool]:
    """Which patterns the JVM can compile: one probe for many, halving on failure."""
    if not java:
        return []
    if len(java) > PROBED:
        return [ok for at in range(0, len(java), PROBED) for ok in jvm_accepts(spark, java[at:at + PROBED])]
    try:
        spark.range(1).select(*[F.rlike(F.lit(""), F.lit(j)).alias(f"p{i}") for i, j in enumerate(java)]).collect()
        return [True] * len(java)
    except Exception:
        if len(java) == 1:
            return [False]
        half = len(java) // 2
        return jvm_accepts(spark, java[:half]) + jvm_accepts(spark, java[half:])


# A repeated group makes the JVM's engine recurse once per repetition: on a long message
# that can exhaust the stack, so such patterns are left to Python, unless the count is
# bounded by two digits.
_REPEATED_GROUP = re.compile(r"(?<!\\)(?:\\\\)*\)(?:[*+]|\{\d*,\}|\{\d*,?\d{3,}\})")


def java_spellings(spark: SparkSession, regexes: list[str]) -> list[str | None]:
    """Java spelling of valid Python patterns, None for those only Python should run."""
    safe = [not _REPEATED_GROUP.search(r) for r in regexes]
    spelled = [to_java(r) if ok else None for r, ok in zip(regexes, safe)]
    safe = [j is not None for j in spelled]
    javas = [j for j in spelled if j is not None]
    accepted = iter([j if ok else None for j, ok in zip(javas, jvm_accepts(spark, javas))])
    return [next(accepted) if ok else None for ok in safe]


def compiles(regex: str) -> bool:
    try:
        re.compile(regex)
        return True
    except (re.error, TypeError, OverflowError, RecursionError):
        return False


def python_search(regex: str):
    """A column function: whether a Python pattern is found in a text, in Arrow batches."""

    @F.pandas_udf(T.BooleanType())
    def found(text: pd.Series) -> pd.Series:
        compiled = re.compile(regex)
        return pd.Series([None if t is None else compiled.search(t) is not None for t in text], dtype=object)

    return found


def python_group(regex: str, index: int):
    """A column function: one group of a Python pattern, ``''`` where it took no part."""

    @F.pandas_udf(T.StringType())
    def group(text: pd.Series) -> pd.Series:
        compiled = re.compile(regex)
        found = [None if t is None else compiled.search(t) for t in text]
        return pd.Series([(m.group(index) or "") if m else "" for m in found], dtype=object)

    return group


# Patterns that one probe asks the JVM about.
PROBED = 256


def load_patterns(spark: SparkSession, rows: list) -> list[Pattern]:
    """Usable patterns, lowest id first, from rows with ``pattern_id`` and ``regex``.

    Patterns Python rejects are left out, as the matching step skips them.
    """
    found = []
    for row in sorted(rows, key=lambda r: r["pattern_id"]):
        if not compiles(row["regex"]):
            continue
        compiled = re.compile(row["regex"])
        get = row.asDict().get
        groups = tuple(sorted(compiled.groupindex.items(), key=lambda item: item[1]))
        found.append(Pattern(row["pattern_id"], row["regex"], get("label"), get("severity"),
                             get("component"), None, groups))
    javas = java_spellings(spark, [p.regex for p in found])
    return [replace(p, java=java) for p, java in zip(found, javas)]


# Branches of one CASE; longer lists are several, so that no expression grows deep or wide.
BRANCHES = 64


def first_of(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first branch whose test holds; a value that is NULL counts as none."""
    cases = []
    for at in range(0, len(branches), BRANCHES):
        (test, value), *more = branches[at:at + BRANCHES]
        case = F.when(test, value)
        for test, value in more:
            case = case.when(test, value)
        cases.append(case)
    return F.coalesce(*cases, otherwise)
