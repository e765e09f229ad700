"""Log lines made from the given tables, each table as a whole.

``events`` becomes one log file and ``orders`` a later one; their messages share
shapes, so the second meets templates the first has taught. A few values of the
``props`` number give the irregular lines real files have: no header, impossible
date, stray white space, blank.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

YEAR = 2024
FIRST_RUN = dt.datetime(2024, 2, 1)
SECOND_RUN = dt.datetime(2024, 2, 2)
TRIAGE_RUN = dt.datetime(2024, 2, 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan with fewer splits than cores: the regex work outweighs a shuffle of so little."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def word(number: Column) -> Column:
    """A number spelled with letters, to vary the words of a message."""
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


def _date(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "),
                    F.lit(" "), F.date_format(ts, "HH:mm:ss"))


def _messages(kind: Column, names: tuple, seq: Column, user: Column, value: Column, k: Column) -> tuple[Column, Column]:
    """Message and component by kind; ``names`` lists the kinds in a fixed order."""
    seq_text, user_text = seq.cast("string"), user.cast("string")
    number, code = F.format_string("%.2f", value), F.lower(F.hex(seq))
    link, job, session, temp = names[:4]
    message = (
        F.when(kind == link, F.concat(
            F.lit("[    "), seq_text, F.lit("."), user_text, F.lit("] pci 0000:"), F.lower(F.hex(user)), F.lit(":00.0: "),
            number, F.lit(" Gb/s available link bandwidth, limited by "), k, F.lit(" GT/s link at 0x"), code))
        .when(kind == job, F.concat(F.lit("job "), word(k), F.lit(" failed: code 0x"), code, F.lit(" after "), number, F.lit(" s")))
        .when(kind == session, F.concat(F.lit("session "), seq_text, F.lit(" opened for user u"), user_text,
                                        F.lit(" (uid="), user_text, F.lit(")")))
        .when(kind == temp, F.concat(F.lit("GPU temp: "), number, F.lit("°C on card "), k))
        .otherwise(F.concat(F.lit("volume "), word(user), F.lit(' state {"k": '), k, F.lit("} ok")))
    )
    component = (
        F.when(kind.isin(link, temp), F.lit("kernel")).when(kind == job, F.lit("node-runner"))
        .when(kind == session, F.concat(F.lit("sshd["), user_text, F.lit("]"))).otherwise(F.lit("multipath"))
    )
    return message, component


def _host(user: Column) -> Column:
    return F.concat(F.lit("10.0.0."), (user % 16 + 100).cast("string"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(table(spark, sf_dir, "events"))
    k = F.regexp_extract("props", "[0-9]+", 0)
    message, component = _messages(F.col("event_type"), ("view", "error", "click", "signup"), F.col("event_id"),
                                   F.col("user_id"), F.col("value"), k)
    rest = F.concat(F.lit(" "), _host(F.col("user_id")), F.lit(" "), component, F.lit(": "), message)
    line = F.concat(_date(F.col("ts")), rest)
    value = (
        F.when(k == "7", F.concat(F.lit("free text "), message))
        .when(k == "13", F.concat(F.lit("Feb 31 01:02:03"), rest))
        .when(k == "21", F.concat(F.lit("\t"), line, F.lit("  ")))
        .when(k == "29", F.lit(""))
        .when(k == "33", F.concat(F.lit("Xyz  1 01:02:03"), rest))
        .otherwise(line)
    )
    return events.select(value.alias("value"), F.lit("events.log").alias("source_file"), F.col("event_id").alias("line_seq"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders"))
    user = F.col("o_custkey")
    message, component = _messages(
        F.col("o_orderpriority"), ("2-HIGH", "1-URGENT", "5-LOW", "3-MEDIUM"), F.col("o_orderkey"),
        user, F.col("o_totalprice"), user.cast("string"))
    value = F.concat(_date(F.col("o_orderdate")), F.lit(" "), _host(user), F.lit(" "), component, F.lit(": "), message)
    return orders.select(value.alias("value"), F.lit("orders.log").alias("source_file"), F.col("o_orderkey").alias("line_seq"))


def shipment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``lineitem`` that repeat, with the day they were seen and one file per year."""
    ship = table(spark, sf_dir, "lineitem")
    value = F.concat_ws(" ", F.lit("ship"), "l_returnflag", "l_linestatus", F.lit("qty"),
                        F.col("l_quantity").cast("bigint").cast("string"), F.lit("line"), F.col("l_linenumber").cast("string"))
    seen = F.col("l_shipdate").cast("timestamp_ntz")
    return ship.select(
        value.alias("value"), F.concat(F.lit("ship-"), F.year(seen).cast("string")).alias("source_file"),
        F.unix_timestamp(seen.cast("timestamp")).alias("line_seq"), seen.alias("seen_at"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of ``documents`` and ``conversations`` (origin, id, message)."""
    docs = spread(table(spark, sf_dir, "documents")).select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("message"))
    talks = spread(table(spark, sf_dir, "conversations")).select(
        F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), F.explode(F.split("text", "\n")).alias("message"))
    return docs.unionByName(talks)
