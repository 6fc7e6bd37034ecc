"""Capture sessions over a stream of SQL events.

Each micro-batch of events is written to the session's log and counted by the
same steps as in batch.  A list of the tables that count is then
swapped at once (`manifest`): readers see whole epochs only, also while a batch
runs or after one has failed half-way, and an epoch that is replayed after its
commit is left out.  Every `MERGE` tables of counts become one, and so do `LOGS`
folders of the log; what they cover is deleted one such merge later.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sqltext import literalised
from ..operators.usages import aggregated, as_relation, merged, recorded
from ..sources import snapshot
from ..workspace import delete
from .manifest import Manifest

EVENTS = "seq bigint, sql string, name string, duration_ms decimal(18,2), explain_sql string, ts timestamp"
#: Tables of counts, and folders of the log, that become one.
MERGE, LOGS = 16, 256


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of query-log rows as they arrive."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def with_binds(events: DataFrame, binds_col: str = "binds") -> DataFrame:
    """Events whose explain_sql is their statement with binds filled in, where that changes it."""
    filled = literalised(F.col("sql"), F.col(binds_col))
    return events.withColumn("explain_sql", F.when(filled != F.col("sql"), filled))


@dataclass
class Capture:
    """One session: `start`, `stop`, `run` to the end of what is there, `usages`, `write`.

    `folder` must be one that all executors share; it holds the checkpoint, the
    log and the counts.
    """

    events: DataFrame
    folder: str
    _query: StreamingQuery | None = field(default=None, repr=False)

    def _lists(self, spark: SparkSession) -> Manifest:
        return Manifest.read(spark, f"{self.folder}/manifest")

    def _save(self, events: DataFrame, epoch: int) -> None:
        spark = events.sparkSession
        before = self._lists(spark)
        if epoch <= before.epoch:  # committed, but Spark didn't get to know
            return
        own = f"epoch={epoch}-{uuid.uuid4().hex}"
        log, counts = f"{self.folder}/log/{own}", f"{self.folder}/counts/{own}"
        recorded(events).write.parquet(log)
        aggregated(spark.read.schema(EVENTS).parquet(log), f"{self.folder}/scratch/{own}").write.parquet(counts)
        delete(spark, f"{self.folder}/scratch/{own}")
        tables, gone = [*before.tables.get("counts", []), counts], []
        if len(tables) >= MERGE:
            base = f"{self.folder}/counts/base={epoch}-{uuid.uuid4().hex}"
            merged(spark.read.parquet(*tables)).write.parquet(base)
            tables, gone = [base], tables
        logs = [*before.tables.get("log", []), log]
        if len(logs) >= LOGS:  # one folder for many, of as many rows
            whole = f"{self.folder}/log/base={epoch}-{uuid.uuid4().hex}"
            spark.read.schema(EVENTS).parquet(*logs).write.parquet(whole)
            logs, gone = [whole], [*gone, *logs]
        before.commit(epoch, {"counts": tables, "log": logs}, gone)

    def start(self, **trigger) -> Capture:
        """Begin; a session that runs already goes on."""
        if self._query is None:
            trigger = trigger or {"availableNow": True}
            self._query = self.events.writeStream.foreachBatch(self._save).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**trigger).start()
        return self

    def settle(self) -> Capture:
        """Wait until all events that are there are taken in; the session runs on."""
        self._query.processAllAvailable()
        return self

    def stop(self) -> None:
        """End; a session that has ended stays so."""
        if self._query is not None:
            self._query.stop()
        self._query = None

    def run(self) -> Capture:
        """Take in all events that are there, then end."""
        self.start()
        try:
            self._query.awaitTermination()
        finally:
            self.stop()
        return self

    def usages(self) -> DataFrame:
        """The counts of the epochs committed so far, also while the session runs."""
        spark = self.events.sparkSession
        tables = self._lists(spark).tables.get("counts", [])
        return merged(spark.read.parquet(*tables) if tables else aggregated(spark.createDataFrame([], EVENTS)))

    def log(self) -> DataFrame:
        """The statements of the epochs committed so far."""
        spark = self.events.sparkSession
        parts = self._lists(spark).tables.get("log", [])
        return spark.read.schema(EVENTS).parquet(*parts) if parts else spark.createDataFrame([], EVENTS)

    def write(self, path: str) -> None:
        """The session's snapshot, a folder of JSON parts: log and counts of the same epochs."""
        now = self._lists(self.events.sparkSession)
        at = Capture(self.events, self.folder)
        at._lists = lambda spark: now
        snapshot.write(at.log(), as_relation(at.usages()), path)
