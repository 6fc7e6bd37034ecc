"""From a query log to usage counts by table, column and operation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import shape, statement_usages
from ..schemas import columns
from ..workspace import saved

KEYS = ["table_name", "column_name", "operation", "where_columns"]


def recorded(query_log: DataFrame) -> DataFrame:
    """Statements that an application ran; the driver's own catalog queries go."""
    return query_log.filter("name is null or name <> 'SCHEMA'")


def observed(query_log: DataFrame) -> DataFrame:
    """One row for each usage in each statement: seq, pos, sql, duration_ms, explain_sql and the usage."""
    found = query_log.select("seq", "sql", "duration_ms", "explain_sql", F.posexplode(statement_usages(F.col("sql"))).alias("pos", "u"))
    return found.select("seq", "pos", "sql", "duration_ms", "explain_sql", "u.*")


def shapes(query_log: DataFrame) -> DataFrame:
    """Sums of the statements of each shape, and the numbers of its first statement and of its first one with a plan text.

    All sums have a fixed width, so that Spark adds them up by hash, before and after
    the shuffle, and sorts no statements.
    """
    planned = F.when(F.col("explain_sql").isNotNull(), F.col("seq"))
    return query_log.groupBy(shape(F.col("sql")).alias("shape")).agg(F.count("*").alias("count"), F.sum("duration_ms").cast("decimal(28,2)").alias("duration"), F.min("seq").alias("first"), F.min(planned).alias("planned"))


def aggregated(query_log: DataFrame, folder: str | None = None) -> DataFrame:
    """Statements by table, column, operation and ordered filter columns of their usages.

    They are first counted by shape, and a shape is parsed once.  The texts of each
    shape's first statements come from a second look at the log.  Small tables on the
    way are written to the shared folder, or to `folder`.
    """
    counts = saved(shapes(query_log), "shapes", folder)
    wanted = saved(counts.select(F.col("first").alias("at")).union(counts.filter("planned is not null").select("planned")).distinct(), "wanted", folder)
    texts = saved(query_log.join(wanted, F.col("seq").eqNullSafe(F.col("at")), "left_semi").select("seq", "sql", "explain_sql"), "texts", folder)
    texts = texts.groupBy(shape(F.col("sql")).alias("of"), F.col("seq").alias("at")).agg(F.min("sql").alias("sql"), F.min("explain_sql").alias("explain_sql"))
    told = lambda at: F.col("shape").eqNullSafe(F.col("of")) & F.col(at).eqNullSafe(F.col("at"))
    named = counts.join(texts, told("first"), "left").select("shape", "count", "duration", "first", "sql", "planned")
    return usage_counts(named.join(texts.select("of", "at", "explain_sql"), told("planned") & F.col("planned").isNotNull(), "left").drop("of", "at"))


def usage_counts(counts: DataFrame) -> DataFrame:
    """Counts by table, column, operation and filter columns, of counts by shape with their first texts (sql, explain_sql)."""
    found = counts.select("count", "duration", "first", "sql", "planned", "explain_sql", F.posexplode(statement_usages(F.col("shape"))).alias("pos", "u"))
    at, explain = F.struct(F.col("first").alias("seq"), "pos"), F.struct(F.col("planned").alias("seq"), "pos", "explain_sql")
    return _summed(found.select("u.*", "count", "duration", F.col("sql").alias("source"), F.when(F.col("explain_sql").isNotNull(), explain).alias("explain"), at.alias("at")))


def merged(counts: DataFrame) -> DataFrame:
    """Counts of several parts of a log, as `aggregated` gives them, added up."""
    return _summed(counts)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEYS).agg(
        F.sum("count").alias("count"), F.sum("duration").cast("decimal(28,2)").alias("duration"), F.min_by("source", "at").alias("source"), F.min("explain").alias("explain"), F.min("at").alias("at"),
    ).withColumn("explain_source", F.col("explain.explain_sql"))


def as_relation(counted: DataFrame) -> DataFrame:
    """The usage relation of counts; seq is the statement of first use."""
    known = {
        "seq": F.col("at.seq") * 1000 + F.col("at.pos"), "origin": F.lit("runtime"), "total_duration_ms": F.col("duration").cast("double"),
        "plan_rows": F.lit(None).cast("bigint"), "line": F.lit(None).cast("int"),
    }
    return counted.select(*[(known[c] if c in known else F.col(c) if c in counted.columns else F.lit(None).cast("string")).alias(c) for c in columns("usages")])


def runtime_usages(query_log: DataFrame) -> DataFrame:
    """The usage relation of a query log."""
    return as_relation(aggregated(recorded(query_log)))


def all_usages(source: DataFrame, runtime: DataFrame) -> DataFrame:
    """Usages of the source text first, then those of the log; seq keeps the order."""
    names = columns("usages")
    shift = lambda df, base: df.select(*[(F.col("seq") + base if c == "seq" else F.col(c)).alias(c) for c in names])
    return shift(source, -(1 << 60)).unionByName(shift(runtime, 0))
