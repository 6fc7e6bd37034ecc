"""Rules over the catalog alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..evidence import Evidence
from ..operators.indexes import without_prefix
from .common import finding, text

TIMESTAMPS = ("created_at", "updated_at")


def symbols(names: Column) -> Column:
    """One name as a symbol, several as a list of symbols."""
    listed = F.array_join(F.transform(names, lambda n: F.concat(F.lit(":"), n)), ", ")
    return F.when(F.size(names) == 1, listed).otherwise(F.concat(F.lit("["), listed, F.lit("]")))


def unindexed_key(e: Evidence, config: Config) -> DataFrame:
    rows = without_prefix(e.foreign_keys.join(e.tables.select("table_name"), "table_name", "left_semi"), e.indexes, F.col("columns"))
    return finding(
        rows, code="foreign_key_without_index", severity="high", title="Foreign key without an index", table=F.col("table_name"), column=F.concat_ws(", ", "columns"),
        problem=text("No index of ", F.col("table_name"), " begins with the columns of a foreign key."), recommendation=text("add_index :", F.col("table_name"), ", ", symbols(F.col("columns"))),
        evidence=text(F.concat_ws(", ", "columns"), " -> ", F.col("to_table")),
    )


def no_primary_key(e: Evidence, config: Config) -> DataFrame:
    return finding(
        e.tables.filter("primary_key is null"), code="table_without_primary_key", severity="high", title="Table without a primary key", table=F.col("table_name"),
        problem="Rows can't be told apart.", recommendation="Add a primary key.", evidence=text(F.col("table_name")),
    )


def no_timestamps(e: Evidence, config: Config) -> DataFrame:
    stamped = e.columns.filter(F.col("column_name").isin(*TIMESTAMPS)).groupBy("table_name").agg(F.count_distinct("column_name").alias("n")).filter(F.col("n") == len(TIMESTAMPS))
    return finding(
        e.tables.join(stamped, "table_name", "left_anti"), code="table_without_timestamps", severity="low", title="Table without timestamps", table=F.col("table_name"),
        problem="There is no record of when rows came and changed.", recommendation=text("add_timestamps :", F.col("table_name")), evidence=text(F.col("table_name")),
    )


RULES = {"foreign_key_without_index": unindexed_key, "table_without_primary_key": no_primary_key, "table_without_timestamps": no_timestamps}
