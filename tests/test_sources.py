import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logloom.schemas import CATALOG, RULES
from logloom.session import empty_table, local_table
from logloom.operators import catalog
from logloom.sources import exports
from logloom.sources.lines import read_lines, read_ordered_files
from logloom.sources.log_ranges import LogRanges
from logloom.sources.store import Store
from logloom.streaming.ingest import fixed_clock, stream_alerts, stream_ingest
from tests.test_ingest import PATTERNS, RULE_ROWS, catalog_of, lines_of, logs_of, model_of, random_lines

NOW = dt.datetime(2025, 8, 1)
MODEL_COLUMNS = ("ts", "host", "component", "raw_line", "message", "pattern_id", "is_known", "classification", "severity", "anomaly_reason")


def test_lines_keep_arrival_order_across_splits(spark, tmp_path):
    expected = []
    for name in ("b.log", "a.log", "c.log"):
        lines = [f"{name} line {i}" + "x" * (i % 37) for i in range(500)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        expected.append((name, lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_lines(spark, [str(tmp_path / n) for n, _ in expected])
        assert df.rdd.getNumPartitions() > 5
        got = [(r["source_file"], r["value"]) for r in df.orderBy("line_seq").collect()]
        assert sorted(r[0] for r in df.select("line_seq").collect()) == list(range(1500))
        later = read_lines(spark, [str(tmp_path / "a.log")], first=2**62)
        assert later.agg(F.min("line_seq"), F.max("line_seq")).first()[:] == (2**62, 2**62 + 499)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(n, v) for n, lines in expected for v in lines]


def test_blank_lines_at_split_borders_stay_unique(spark, tmp_path):
    (tmp_path / "blank.log").write_text("\n" * 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        df = read_lines(spark, [str(tmp_path)])
        assert df.count() == df.select("line_seq").distinct().count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_breaks_bad_bytes_and_odd_names(spark, tmp_path):
    (tmp_path / "odd name é.log").write_bytes(b"one\r\ntwo\rth\xffree\n\nkept \xef\xbf\xbd")
    from logloom.functions.syslog import parse_lines

    rows = parse_lines(read_lines(spark, [str(tmp_path)]), 2025, NOW).orderBy("line_seq").collect()
    assert [r["message"] for r in rows] == ["one", "two", "three", "", "kept \ufffd"]
    assert {r["source_file"] for r in rows} == {"odd name é.log"}


def test_ordered_files_skip_the_missing(spark, tmp_path):
    for name in ("1", "2", "3 a+b%"):
        (tmp_path / name).write_text(f"file {name}\n")
    rows = read_ordered_files(spark, str(tmp_path), ["3 a+b%", "9", "1"]).orderBy("line_seq").collect()
    assert [(r["value"], r["source_file"]) for r in rows] == [("file 3 a+b%", "3 a+b%"), ("file 1", "1")]


def seeded(spark, root):
    store = Store(spark, str(root))
    store.update(NOW, catalog=catalog_of(spark), rules=local_table(spark, RULE_ROWS, RULES))
    return store


def test_store_ingests_in_batches_like_one_run(spark, tmp_path):
    lines = random_lines(21, 240)
    model = model_of()
    for line in lines:
        model.ingest(line, 2025, NOW)
    store = seeded(spark, tmp_path / "store")
    for start in (0, 100):
        part = lines[start:start + 100] if start == 0 else lines[start:]
        assert store.ingest(lines_of(spark, part), as_of=NOW, default_year=2025) is not None
    assert store.ingest(lines_of(spark, lines), as_of=NOW, default_year=2025, batch_id=2) is None
    got = [tuple(r) for r in store.table("logs").orderBy("log_id").select("log_id", *MODEL_COLUMNS).collect()]
    assert got == model.logs
    assert sorted(map(tuple, store.table("params").collect())) == sorted(model.params)
    alerts = sorted((r["alert_id"], r["log_id"], r["alert_type"]) for r in store.table("alerts").collect())
    assert alerts == model.alerts
    assert store.table("catalog").count() == len(model.patterns)
    # A rewritten table replaces what the batches before held.
    logs = store.table("logs").withColumn("classification", F.lit("ignore"))
    store.update(NOW, rewritten=("logs",), logs=logs)
    assert [r[0] for r in store.table("logs").select("classification").distinct().collect()] == ["ignore"]
    assert store.table("logs").count() == 240 and store.table("rules").count() == len(RULE_ROWS)


def test_uncommitted_batch_is_invisible(spark, tmp_path):
    store = seeded(spark, tmp_path / "store")
    first = store.ingest(lines_of(spark, random_lines(3, 50)), as_of=NOW, default_year=2025)
    first.logs.write.parquet(f"{store.root}/logs/batch=2")
    assert store.table("logs").count() == 50
    assert store.ingest(lines_of(spark, random_lines(4, 30)), as_of=NOW, default_year=2025) is not None
    assert store.table("logs").count() == 80


def test_stream_gives_what_the_batches_give(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    store = seeded(spark, tmp_path / "store")
    model, written = model_of(), []

    def drop(name, seed):
        lines = random_lines(seed, 80)
        (incoming / name).write_text("\n".join(lines) + "\n")
        written.extend(lines)

    def run():
        query = stream_ingest(spark, store, str(incoming), str(tmp_path / "cp"), as_of=lambda _: NOW, default_year=2025)
        query.awaitTermination(300)
        assert query.exception() is None

    def forget_last_epoch():
        """What a stop between the store's commit and the checkpoint's leaves."""
        done = sorted((p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
        for p in (done[-1], done[-1].with_name(f".{done[-1].name}.crc")):
            p.unlink(missing_ok=True)

    drop("1.log", 31)
    run()
    drop("2.log", 32)
    run()
    forget_last_epoch()
    run()
    forget_last_epoch()
    run()
    run()
    for line in written:
        model.ingest(line, 2025, NOW)
    got = [tuple(r) for r in store.table("logs").orderBy("log_id").select(*MODEL_COLUMNS).collect()]
    assert got == [log[1:] for log in model.logs]
    assert [r["alert_id"] for r in store.table("alerts").orderBy("alert_id").collect()] == [a[0] for a in model.alerts]
    assert stream_alerts(spark, store).isStreaming
    assert fixed_clock(NOW)(2) == NOW + dt.timedelta(minutes=2)


def test_exports(spark, tmp_path):
    df = local_table(spark, [(1, 'say "hi", all\nof you', None), (2, "plain", "x")], "log_id bigint, message string, severity string")
    exports.to_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r["message"] for r in back.collect()} == {'say "hi", all\nof you', "plain"}
    exports.to_json(df, str(tmp_path / "json"))
    rows = [json.loads(line) for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()]
    assert {"log_id": 1, "message": 'say "hi", all\nof you', "severity": None} in rows


def test_epochs_are_looked_up_without_the_log(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "state"))
    assert not store.has("a", 0)
    for batch, (source, epoch) in enumerate([("a", 0), ("b", 1), (None, None)]):
        store.commit(batch, {}, dt.datetime(2025, 1, 1), source=source, epoch=epoch)
    monkeypatch.setattr(Store, "commits", lambda self: pytest.fail("the commit log was collected"))
    assert [store.has(*x) for x in (("a", 0), ("b", 1), ("a", 1), ("b", 0))] == [True, True, False, False]


def test_edits_write_the_ranges_they_touch(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id AS log_id", "id % 7 AS pattern_id", "'normal' AS classification", "CAST(NULL AS STRING) AS severity",
                                        "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at", "map('a', id) AS params")
    rows = rows.withColumn("pattern_id", F.when(F.col("log_id").between(2300, 2450), 99).otherwise(F.col("pattern_id")))
    store = LogRanges(spark, str(tmp_path / "logs"), rows.schema, 100)
    store.append(rows.where("log_id < 2000"))
    store.append(rows.where("log_id >= 2000"))

    def files():
        return {p.parent.name: p.name for p in (tmp_path / "logs").glob("log_range=*/*.parquet")}

    def written(run):
        before = files()
        run()
        after = files()
        assert len(after) == 50 == len(before)
        return {name for name in after if after[name] != before[name]}

    edit = local_table(spark, [(1234, "abnormal", "critical"), (None, "ignore", None), (10 ** 9, "ignore", None)], "log_id bigint, classification string, severity string")
    now = dt.datetime(2025, 1, 2)
    assert written(lambda: store.rewrite(store.ranges_of_logs(edit), lambda part: catalog.edit_logs(part, edit, now))) == {"log_range=12"}
    labels = local_table(spark, [(99, "ignore", None, None), (12345, "normal", None, None)], "pattern_id bigint, label string, severity string, note string")
    patterns = empty_table(spark, CATALOG)
    assert store.ranges_of_patterns(labels) == [23, 24]
    assert written(lambda: store.rewrite(store.ranges_of_patterns(labels), lambda part: catalog.relabel(patterns, part, labels, now)[1])) == {"log_range=23", "log_range=24"}
    assert written(lambda: store.rewrite([], lambda part: part)) == set()
    got = store.rows().orderBy("log_id").collect()
    assert [r.log_id for r in got] == list(range(5000)) and store.rows().columns == rows.columns
    for r in got:
        want = ("abnormal", "critical") if r.log_id == 1234 else ("ignore", None) if 2300 <= r.log_id <= 2450 else ("normal", None)
        assert (r.classification, r.severity) == want and (r.updated_at is not None) == (want != ("normal", None)) and r.params == {"a": r.log_id}


def _rows_scanned(df):
    """Rows that came out of the scans of a query that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    scans = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        # Where adaptive execution wraps the plan, its leaves are below.
        inner = leaf.executedPlan().collectLeaves() if leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else None
        scans += [inner.apply(k) for k in range(inner.size())] if inner else [leaf]
    return sum(s.metrics().apply("numOutputRows").value() for s in scans)


def test_lookups_skip_row_groups(spark, tmp_path):
    """Ids by folder and bounds; patterns by what each row group holds, though every file's bounds span them all."""
    ids = F.col("id")
    rare = F.when((ids >= 30000) & (ids < 30010), 7777).when(ids % 2 == 0, 1).otherwise(F.lit(9999) + ids * 3)
    rows = spark.range(40000).select(
        ids.alias("log_id"), rare.cast("bigint").alias("pattern_id"), F.sha2(ids.cast("string"), 512).alias("message"))
    store = LogRanges(spark, str(tmp_path / "logs"), rows.schema, 20000, row_group_bytes=1 << 18)
    store.append(rows)
    assert store.of_pattern(7777).count() == 10 and store.of_pattern(2).count() == 0
    assert 10 <= _rows_scanned(store.of_pattern(7777)) < 10000
    assert _rows_scanned(store.of_pattern(9998)) < 10000
    page = store.of_logs(19990, 20009)
    assert sorted(r.log_id for r in page.collect()) == list(range(19990, 20010))
    assert _rows_scanned(page) < 20000
    assert store.of_logs(50000, 60000).count() == 0


def test_params_of_a_row_need_no_join(spark):
    from logloom.operators import reports

    kind = "map<string,struct<num:double,text:string>>"
    rows = spark.range(4).select(
        F.col("id").alias("log_id"), F.expr("timestamp_ntz'2025-01-01 00:00:00'").alias("ts"),
        F.lit(2).cast("bigint").alias("pattern_id"), *[F.lit(c).alias(c) for c in ("host", "message", "classification", "severity", "anomaly_reason")],
        F.lit(True).alias("is_known"),
        F.expr("CASE id WHEN 0 THEN map('b', named_struct('num', 2.5D, 'text', '2.5'), 'a', named_struct('num', 1D, 'text', '1')) "
               "WHEN 1 THEN map('a', named_struct('num', CAST(NULL AS DOUBLE), 'text', 'x')) WHEN 2 THEN map() END").cast(kind).alias("params"))
    got = {r["log_id"]: (r["param_name"], r["param_value_num"]) for r in reports.logs_with_param(rows, 2, "a").collect()}
    assert got == {0: ("a", 1.0), 1: ("a", None), 2: (None, None), 3: (None, None)}
    texts = {r["log_id"]: r["params"] for r in reports.latest_with_params(rows, 2).collect()}
    assert texts == {0: "a=1.0, b=2.5", 1: "", 2: None, 3: None}
    for df in (reports.logs_with_param(rows, 2, "a"), reports.latest_with_params(rows, 2)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
