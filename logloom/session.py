"""Session defaults and staging of intermediate tables."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from logloom.schemas import schema_of


def build_session(app_name: str = "logloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package relies on.

    Shuffle partitions are left to adaptive execution: it starts from the
    cluster's own setting and coalesces, and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Expressions are built from rule and pattern lists; recording a call site for each is slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


@functools.cache
def _archive() -> str:
    """This package as an archive beside the driver, which Spark hands to the executors while the driver lives."""
    root, archive = Path(__file__).resolve().parent, Path(tempfile.mkdtemp(prefix="logloom-package-")) / "logloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    return str(archive)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that functions over Arrow batches can be unpickled there.

    Does nothing where the package was sent before.
    """
    sent = spark.conf.get("spark.logloom.shipped", None)
    if sent == spark.sparkContext.applicationId:
        return
    spark.sparkContext.addPyFile(_archive())
    spark.conf.set("spark.logloom.shipped", spark.sparkContext.applicationId)


def staging_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only on one machine (``local`` master, as in tests) does a temporary folder stand in
    for it: on a cluster each executor would write to its own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        configured = tempfile.mkdtemp(prefix="logloom-stage-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A new folder for one staged table."""
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Used where several outputs depend on one intermediate result: the work is
    done once, a lost executor costs no recomputation, and the planner sees the
    true size of the table.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ARROW = {
    T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64(),
    T.TimestampNTZType(): pa.timestamp("us"), T.ArrayType(T.StringType()): pa.list_(pa.string()),
}


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Driver-side rows (settings, patterns, change sets) as a local relation of known size.

    Unlike rows handed over through a Python RDD this needs no Python worker, and the
    planner knows how small the table is.
    """
    if isinstance(schema, str):
        schema = schema_of(schema)
    names = schema.fieldNames()
    columns = [pa.field(f.name, _ARROW[f.dataType]) for f in schema.fields]
    table = pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=pa.schema(columns))
    return spark.createDataFrame(table, schema)


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return local_table(spark, [], schema)
