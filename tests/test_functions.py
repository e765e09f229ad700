import datetime as dt
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from logloom.functions.regexes import (
    compiles, group_names, has_named_groups, java_spellings, load_patterns, required_text, to_java)
from logloom.functions.syslog import parse_lines
from logloom.functions.templates import fits_own_template, pattern_fits, template_of
from logloom.functions.text import float_text, number_prefix
from logloom.session import local_table
from tests.sequential import numeric, parse, template

NOW = dt.datetime(2025, 1, 1, 12)

LINES = [
    "Jul 14 11:20:17 172.20.224.102 kernel: [    0.005840] message",
    "Aug  5 01:02:03 h ntpd[3752]: x",
    "Aug  5 01:02:03 h kernel: a: b",
    "Aug  5 01:02:03 h a:b:c: d",
    "bad line", "", "   ", "\tAug  5 01:02:03 h k: x  ",
    "Feb 31 01:02:03 h k: x", "Xyz 1 01:02:03 h k: x", "Feb 29 01:02:03 h k: leap",
    "Jul 14 24:00:00 h k: x", "Jul 14 11:20:60 h k: leap second",
    "Jul 14 11:20:17 h k:", "Jul 14 11:20:17 h k: ", "Jul 14 11:20:17 h nocolon x",
    "Jul\u00a014 11:20:17\u2003h\u3000k:\x1cx y\u2028z",
    "Jul 14 11:20:17 h k: wide \x0b gap\x1f",
]

MESSAGES = [
    "[    0.005840]  gran_size: 16M", "at 0xFEE00000 x", "1230x1f-a_1_2", "0XfF", r"c:\d {x}", "", "0x", "0x0X1",
    "a.b*c?d+e|f^g$h#i~j&k-l", "tab\tand\u00a0nbsp\u2003em", "٣٤ digits", "___WS___ and ___NUM___", "\ue000 private", "0x1g 0xABCDEFG",
    "\\s+ literal \\d+ text", "x\\ y",
]


def test_parse_agrees_with_row_wise_model(spark):
    rows = local_table(spark, [(v, "f", i) for i, v in enumerate(LINES)], "value string, source_file string, line_seq bigint")
    got = {r["line_seq"]: (r["ts"], r["host"], r["component"], r["message"], r["raw_line"])
           for r in parse_lines(rows, 2025, NOW).collect()}
    for i, line in enumerate(LINES):
        assert got[i] == parse(line, 2025, NOW), line


def test_templates(spark):
    rows = local_table(spark, [(m,) for m in MESSAGES], "m string")
    got = {r["m"]: r["t"] for r in rows.select("m", template_of(F.col("m")).alias("t")).collect()}
    assert got[MESSAGES[0]] == r"\[\s+\d+\.\d+\]\s+gran_size:\s+\d+M"
    assert got["at 0xFEE00000 x"] == r"at\s+0x[0-9A-Fa-f]+\s+x"
    assert got["1230x1f-a_1_2"] == r"\d+0x[0-9A-Fa-f]+\-a_\d+_\d+"
    assert got[r"c:\d {x}"] == r"c:\\d\s+\{x\}"
    for m in MESSAGES:
        assert got[m] == template(m), m


def test_template_fits_its_message(spark):
    rows = local_table(spark, [(m,) for m in MESSAGES], "m string")
    message = F.col("m")
    got = rows.select("m", fits_own_template(message).alias("own"), pattern_fits(template_of(message), message).alias("any")).collect()
    for row in got:
        expected = re.fullmatch(template(row["m"]), row["m"]) is not None
        assert row["own"] == expected, row["m"]
        assert row["any"] == expected, row["m"]
    assert not [r for r in got if r["m"] == "0XfF"][0]["own"]


def test_long_message_keeps_the_jvm_alive(spark):
    text = " ".join(f"word{i}" for i in range(50_000))
    rows = local_table(spark, [(text,)], "m string").repartition(2)
    assert rows.select(pattern_fits(template_of(F.col("m")), F.col("m"))).first()[0]
    assert rows.select(fits_own_template(F.col("m"))).first()[0]


@pytest.mark.parametrize("values", [[0.0, 5.0, 85.5, 16.0, 404.0, 1e6, 12345678.0, 12345678.25, 9.999e15, 1e16, 1.5e17, 1e-4,
                                     0.00012345, 1e-5, 3.25e-7, 0.1, 123456789.125, -85.0, -0.5, 1e22]])
def test_float_text_prints_like_python(spark, values):
    rows = local_table(spark, [(v,) for v in values], "v double")
    for row in rows.select("v", float_text(F.col("v")).alias("t")).collect():
        assert row["t"] == str(row["v"])


def test_number_prefix(spark):
    texts = ["16M", "5c:ff", "0x1f", "abc", "85.5", "-3.", "+7x", "", ".5", "1.2.3"]
    rows = local_table(spark, [(t,) for t in texts], "t string")
    for row in rows.select("t", number_prefix(F.col("t")).alias("n")).collect():
        assert row["n"] == numeric(row["t"])


def test_named_groups(spark):
    rows = local_table(spark, [(r"(?P<a>x)(?P<b_c>\d+)(y)",), ("plain",)], "p string")
    got = rows.select(has_named_groups(F.col("p")), group_names(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, ["a", "b_c"]), (False, [])]


# pattern, texts to search
DIALECT = [
    (r"(?P<available_bandwidth>\d+\.?\d*)\s+Gb/s", ["31.504 Gb/s", "x Gb/s", "٣\u00a0Gb/s"]),
    (r"(?P<q>['\"])x(?P=q)", ["'x'", "'x\""]),
    (r"a{,2}b", ["aaab", "b", "c"]), (r"x{y}", ["x{y}", "xy"]), (r"{", ["{", "a"]),
    (r"[[a]", ["[", "a", "b"]), (r"[a&&b]+$", ["&", "a&&b", "c"]), (r"[]x]", ["]", "x", "y"]), (r"[^]x]", ["]", "y"]),
    (r"end\Z", ["end", "end\n"]), (r"end$", ["end", "end\n", "end\r"]), (r"a.b", ["a\nb", "a\rb", "a\u2028b"]),
    (r"(?i)Straße", ["STRASSE", "straße", "STRAßE"]), (r"(?a)\w+é", ["aé", "éé"]), (r"\w+", ["é", "-"]),
    (r"a(?#note)b", ["ab", "a"]), (r"(?x) a b  # c", ["ab", "a b"]), (r"\vx", ["\x0bx", "\nx"]), (r"[\b]", ["\x08", "b"]),
    (r"\U0001f6a8", ["\U0001f6a8", "x"]), (r"(?s)a.b", ["a\nb"]), (r"\0x", ["\0x", "0x"]), (r"(?m)^b$", ["a\nb", "ab"]),
    (r"(?<=a)b", ["ab", "cb"]), (r"a++b", ["aab", "b"]), (r"(?>a|ab)c", ["abc", "ac"]), (r"\d{2,}", ["1", "12"]),
]


def test_python_patterns_mean_the_same_in_the_jvm(spark):
    javas = java_spellings(spark, [p for p, _ in DIALECT])
    cases = [(p, j, t) for (p, texts), j in zip(DIALECT, javas) for t in texts]
    assert all(j is not None for j in javas), [p for (p, _), j in zip(DIALECT, javas) if j is None]
    columns = [F.rlike(F.lit(t), F.lit(j)).alias(f"c{i}") for i, (_, j, t) in enumerate(cases)]
    got = spark.range(1).select(*columns).first()
    for found, (pattern, _, text) in zip(got, cases):
        assert found == (re.search(pattern, text) is not None), (pattern, text)


def test_patterns_the_jvm_should_not_run(spark):
    rows = local_table(spark, [(1, "("), (2, r"(\w+\s)*x"), (3, r"(a)?(?(1)b|c)"), (4, r"ok (\d+)"), (5, r"\(x\)*y")],
                       "pattern_id bigint, regex string").collect()
    loaded = load_patterns(spark, rows)
    assert [(p.pattern_id, p.java is None) for p in loaded] == [(2, True), (3, True), (4, False), (5, False)]


_PIECES = st.sampled_from([r"\s+", r"\d+", "abc", "GPU temp", r"\.", "(x|y)", "(?P<n>q)?", "[a-f]", "z*", r"\[", "k{2}", "w?", ".", "(?:ab)+", "-", "m{0,1}", "|", "[q|]"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_PIECES, min_size=1, max_size=6, unique=True), st.text(alphabet="abcxyzqkwm GPUtemp.[]-12", max_size=30))
def test_required_text_is_in_every_match(pieces, text):
    regex = "".join(pieces)
    fragment = required_text(regex)
    if re.search(regex, text):
        assert fragment in text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab(?:P<n>)[]{}*+.\\d|&^$,12", max_size=12))
def test_translation_never_fails_on_valid_patterns(regex):
    if compiles(regex):
        assert isinstance(to_java(regex), str) or to_java(regex) is None
