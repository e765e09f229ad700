"""State tables as parquet folders, one sub-folder per batch or version."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from logloom.operators.joins import max_id
from logloom.plans.ingest import Batch, ingest_batch
from logloom.schemas import TABLES
from logloom.session import empty_table, local_table

# Tables that only grow keep one folder per batch; the others are whole versions.
APPENDED = ("logs", "params", "alerts", "analyses")
_COMMITS = "batch_id bigint, committed_at timestamp_ntz, rewritten array<string>, source string, epoch bigint"


@dataclass(frozen=True)
class Store:
    """Tables under one root on shared storage. One writer at a time.

    A batch writes its folders (overwriting what a failed try left) and then its
    commit record; readers follow the commit records, so they see whole batches
    only and running a batch again changes nothing.
    """

    spark: SparkSession
    root: str

    def commits(self) -> list:
        try:
            rows = self.spark.read.schema(_COMMITS).parquet(f"{self.root}/commits").collect()
        except AnalysisException:
            return []
        return sorted(rows, key=lambda r: r["batch_id"])

    def has(self, source: str, epoch: int) -> bool:
        """Whether an epoch of a stream was committed."""
        try:
            rows = self.spark.read.schema(_COMMITS).parquet(f"{self.root}/commits")
            return not rows.where((F.col("source") == source) & (F.col("epoch") == epoch)).isEmpty()
        except AnalysisException:
            return False

    def committed(self) -> list[int]:
        return [r["batch_id"] for r in self.commits()]

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch={batch_id}"

    def table(self, name: str) -> DataFrame:
        """Current content of a table; empty when nothing was committed."""
        commits = self.commits()
        if not commits:
            return empty_table(self.spark, TABLES[name])
        wanted = [commits[-1]["batch_id"]]
        if name in APPENDED:
            restarts = [r["batch_id"] for r in commits if name in (r["rewritten"] or [])]
            wanted = [r["batch_id"] for r in commits if not restarts or r["batch_id"] >= restarts[-1]]
        return self.spark.read.schema(TABLES[name]).parquet(*[self._path(name, b) for b in wanted])

    def commit(self, batch_id: int, tables: dict[str, DataFrame], as_of: dt.datetime,
               rewritten: tuple[str, ...] = (), written: tuple[str, ...] = (),
               source: str | None = None, epoch: int | None = None) -> None:
        """Write the tables of a batch, carry the others over, then record the batch.

        ``rewritten`` names growing tables given as a whole (after a relabel or a
        reprocess); ``written`` those whose folder is already there.
        """
        if batch_id in self.committed():
            return
        for name, schema in TABLES.items():
            if name in written:
                continue
            df = tables.get(name)
            if df is None:
                df = empty_table(self.spark, schema) if name in APPENDED else self.table(name)
            df.select(*schema.fieldNames()).write.mode("overwrite").parquet(self._path(name, batch_id))
        record = local_table(self.spark, [(batch_id, as_of, list(rewritten), source, epoch)], _COMMITS)
        record.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def next_batch(self) -> int:
        return max(self.committed(), default=-1) + 1

    def update(self, as_of: dt.datetime, rewritten: tuple[str, ...] = (), **tables: DataFrame) -> None:
        """Commit tables as the next batch, e.g. hand-written patterns, or logs after a relabel."""
        self.commit(self.next_batch(), tables, as_of, rewritten)

    def ingest(self, lines: DataFrame, *, as_of: dt.datetime, default_year: int,
               batch_id: int | None = None, policy: str = "first",
               source: str | None = None, epoch: int | None = None) -> Batch | None:
        """Ingest lines as one batch; ``None`` when that batch, or that epoch of a stream, was committed before.

        The log rows are written once, with their parameter map; every other table
        comes from reading back the few columns it needs.
        """
        batch_id = self.next_batch() if batch_id is None else batch_id
        if batch_id in self.committed() or source is not None and self.has(source, epoch):
            return None
        before, rules, logs, alerts = (self.table(t) for t in ("catalog", "rules", "logs", "alerts"))
        batch = ingest_batch(lines, before, rules, as_of=as_of, default_year=default_year,
                             first_log_id=max_id(logs, "log_id") + 1, policy=policy)
        path = self._path("logs", batch_id)
        batch.rows.write.mode("overwrite").parquet(path)
        done = batch.over(self.spark.read.schema(batch.rows.schema).parquet(path))
        self.commit(batch_id, {
            "params": done.params, "catalog": done.catalog,
            "alerts": done.alerts(max_id(alerts, "alert_id")),
        }, as_of, written=("logs",), source=source, epoch=epoch)
        return done
