"""Known and new lines by keyed state, against one ingest of all lines at once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.functions.regexes import load_patterns
from logloom.plans.ingest import ingest_batch
from logloom.schemas import CATALOG, RULES
from logloom.session import empty_table, local_table
from logloom.streaming import known as streaming

NOW = dt.datetime(2025, 7, 14)
HEAD = "Jul 14 11:20:17 h k: "


def batches():
    """Lines per micro-batch: a hot template, new ones in every batch, blanks, lines without a header."""
    out, place = [], 0
    for b in range(4):
        lines = []
        for i in range(400):
            text = HEAD + ("hot line 1" if i % 3 else f"kind {'abcdefghij'[i % 10]}{'xyz'[b % 3]} {i}")
            text = "" if i % 97 == 0 else "no header" if i % 89 == 0 else HEAD + "GPU temp 5" if i % 50 == 0 else text
            place += 1
            lines.append((text, f"{b}.log", place))
        out.append(lines)
    return out


@pytest.fixture
def catalog(spark):
    rows = [(1, None, r"GPU temp (?P<t>\d+)", "GPU temp 1", "normal", "info", None, None, True, NOW, NOW, 0, None),
            (2, r"kind\s+ax\s+\d+", None, "kind ax 1", "normal", "info", None, None, False, NOW, NOW, 3, None)]
    return local_table(spark, rows, CATALOG)


def test_state_says_the_same_as_one_ingest(spark, tmp_path, catalog):
    patterns = load_patterns(spark, [r for r in catalog.where("manual_regex_rule is not null").select("pattern_id", F.col("manual_regex_rule").alias("regex"), "label", "severity").collect()])
    known = catalog.where("regex_rule is not null").select(F.col("regex_rule").alias("template"), F.col("pattern_id").alias("template_id"))
    incoming, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "value string, source_file string, line_seq bigint"

    def run():
        for start, name, more in ((streaming.stream_sightings, "sightings", {"last_id": 2, "known": known}), (streaming.stream_lines, "lines", {})):
            lines = spark.readStream.schema(schema).parquet(incoming)
            query = start(lines, patterns, root, str(tmp_path / name), as_of=NOW, default_year=2025, **more)
            query.awaitTermination(300)
            assert query.exception() is None

    def forget_last_epoch(name):
        """What a stop between the write of an epoch and its commit leaves."""
        done = sorted((p for p in (tmp_path / name / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
        for p in (done[-1], done[-1].with_name(f".{done[-1].name}.crc")):
            p.unlink(missing_ok=True)

    everything = []
    for n, lines in enumerate(batches()):
        everything += lines
        spark.createDataFrame(lines, schema).coalesce(1).write.mode("append").parquet(incoming)
        run()
        if n % 2:
            forget_last_epoch("sightings")
            run()
        run()  # nothing new
        # An epoch writes what it met, however much was seen before.
        met = spark.read.parquet(f"{root}/seen/epoch={n}")
        assert met.count() <= 13 and not (tmp_path / "out" / "seen" / f"epoch={n + 1}").exists()
        assert spark.read.parquet(f"{root}/marks/epoch={n}").count() == 1
    whole = ingest_batch(spark.createDataFrame(everything, schema), catalog, empty_table(spark, RULES), as_of=NOW, default_year=2025, first_log_id=0)
    want = {(r.line_seq, r.is_known, r.pattern_id) for r in whole.rows.select("line_seq", "is_known", "pattern_id").collect()}
    got = [(r.line_seq, r.is_known, r.pattern_id) for r in streaming.flagged(spark, root, known).collect()]
    assert len(got) == len(everything) and set(got) == want
    assert sum(not r[1] for r in got) > 20
    counted = {(r.regex_rule, r.pattern_id, r.total_count, r.sample_message) for r in whole.catalog.where("pattern_id > 2").collect()}
    assert {(r.template, r.template_id, r.n, r.sample_message) for r in streaming.templates(spark, root).collect()} == counted
