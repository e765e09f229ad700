"""Continuous ingest of new log files, and a stream of alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.schemas import ALERTS
from logloom.sources.lines import numbered, scanned
from logloom.sources.store import Store


def stream_ingest(
    spark: SparkSession,
    store: Store,
    directory: str,
    checkpoint: str,
    *,
    as_of,
    default_year: int,
    max_files: int = 1000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Ingest files as they appear; each micro-batch is one committed batch of the store.

    ``as_of`` is a function of the epoch, so that a replayed batch gives the same rows.
    A batch is known by the checkpoint and its epoch there: one that was committed
    before a failure is skipped however often the stream starts anew, and one that was
    not is written again over what the failed try left. Files of a micro-batch count in
    order of their modification time and name.
    """
    incoming = scanned(spark.readStream.option("maxFilesPerTrigger", max_files).text(directory),
                       F.col("_metadata.file_modification_time").alias("_time"))

    def ingest(batch: DataFrame, epoch: int) -> None:
        if store.has(checkpoint, epoch):
            return
        lines = numbered(batch, ["_time", "_path"])
        store.ingest(lines, as_of=as_of(epoch), default_year=default_year, source=checkpoint, epoch=epoch)

    query = incoming.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def stream_alerts(spark: SparkSession, store: Store) -> DataFrame:
    """Alerts as a stream, as their folders are written; a folder is written once its batch's logs are."""
    return spark.readStream.schema(ALERTS).parquet(f"{store.root}/alerts/batch=*")


def fixed_clock(start: dt.datetime, step: dt.timedelta = dt.timedelta(minutes=1)):
    """A batch-id to time function for replayable runs."""
    return lambda epoch: start + epoch * step
