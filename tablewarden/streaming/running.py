"""Usage counts of a stream, kept in Spark's state store.

The running sums of each shape of statement are state of the streaming aggregation
and come back from the checkpoint after a restart; the usages of a shape are parsed
once, when the counts are read.  Every epoch writes the rows that it changed, each
with the whole sum so far, and commits them (`manifest`); what counts for a shape is
its row of the latest epoch.  Every `MERGE` tables become one.  The state has a row
for each shape that has come, with two texts, so it grows with the kinds of
statements and not with the log.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sqltext import shape
from ..operators.usages import recorded, usage_counts
from .manifest import Manifest

MERGE = 16


def latest(rows: DataFrame) -> DataFrame:
    """For each shape its row of the latest epoch."""
    rest = [c for c in rows.columns if c != "shape"]
    return rows.groupBy("shape").agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select("shape", "r.*")


def shape_counts(events: DataFrame) -> DataFrame:
    """Sums of the statements of each shape with the texts of its first ones, in one step, as a stream needs it."""
    planned = F.when(F.col("explain_sql").isNotNull(), F.struct("seq", "explain_sql"))
    found = events.groupBy(shape(F.col("sql")).alias("shape")).agg(
        F.count("*").alias("count"), F.sum("duration_ms").cast("decimal(28,2)").alias("duration"), F.min(F.struct("seq", "sql")).alias("first"), F.min(planned).alias("planned"),
    )
    return found.select("shape", "count", "duration", F.col("first.seq").alias("first"), F.col("first.sql").alias("sql"), F.col("planned.seq").alias("planned"), F.col("planned.explain_sql").alias("explain_sql"))


@dataclass
class Running:
    """One session over `events`; `folder` is one that all executors share."""

    events: DataFrame
    folder: str
    _query: StreamingQuery | None = field(default=None, repr=False)

    def _lists(self, spark: SparkSession) -> Manifest:
        return Manifest.read(spark, f"{self.folder}/manifest")

    def _save(self, changed: DataFrame, epoch: int) -> None:
        spark = changed.sparkSession
        before = self._lists(spark)
        if epoch <= before.epoch:
            return
        table = f"{self.folder}/counts/epoch={epoch}-{uuid.uuid4().hex}"
        changed.withColumn("epoch", F.lit(epoch).cast("long")).write.parquet(table)
        tables, gone = [*before.tables.get("counts", []), table], []
        if len(tables) >= MERGE:
            base = f"{self.folder}/counts/base={epoch}-{uuid.uuid4().hex}"
            latest(spark.read.parquet(*tables)).write.parquet(base)
            tables, gone = [base], tables
        before.commit(epoch, {"counts": tables}, gone)

    def start(self, **trigger) -> Running:
        """Begin, or go on with what the checkpoint holds; a session that runs already goes on."""
        if self._query is None:
            counted = shape_counts(recorded(self.events))
            sink = counted.writeStream.outputMode("update").foreachBatch(self._save).option("checkpointLocation", f"{self.folder}/checkpoint")
            self._query = sink.trigger(**(trigger or {"availableNow": True})).start()
        return self

    def settle(self) -> Running:
        """Wait until all events that are there are counted; the session runs on."""
        self._query.processAllAvailable()
        return self

    def stop(self) -> None:
        if self._query is not None:
            self._query.stop()
        self._query = None

    def run(self) -> Running:
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
        if not tables:
            return usage_counts(shape_counts(spark.createDataFrame([], self.events.schema)))
        return usage_counts(latest(spark.read.parquet(*tables)).drop("epoch"))
