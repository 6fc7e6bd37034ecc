"""Rules over usage counts against access paths.

Usages are many, catalogs small.  Each rule reduces the usages of a table and
column to one row: the sum of counts, the first three as evidence, whether some
plan confirms the finding, and that plan's details.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..evidence import Evidence
from ..operators.indexes import unled, unserved_json, unsupported_orders
from .common import finding, text

KEY = ["table_name", "column_name"]
SHOWN = 3


def usage_text() -> Column:
    """A usage as evidence: place and code, or count, time, statement and plan."""
    duration = F.when(F.col("total_duration_ms").isNotNull(), F.concat(F.lit(" "), F.format_string("%.2f", F.col("total_duration_ms")), F.lit("ms total")))
    plan = F.when(F.col("plan_summary").isNotNull(), F.concat(F.lit("\nplan: "), F.col("plan_summary")))
    runtime = text("runtime x", F.col("count"), duration, ": ", F.col("source"), plan)
    return F.when(F.col("origin") == "source", text(F.col("path"), ":", F.col("line"), " ", F.col("source"))).otherwise(runtime)


def scan_confirmed(config: Config) -> Column:
    return (F.col("origin") == "runtime") & (F.col("plan_relation_node_type") == "Seq Scan") & (F.col("plan_relation_name") == F.col("table_name")) & (F.coalesce("plan_rows", F.lit(0)) >= config.planner_row_threshold)


def sort_confirmed(config: Config) -> Column:
    return (F.col("origin") == "runtime") & (F.col("plan_root_node_type") == "Sort") & (F.coalesce("plan_rows", F.lit(0)) >= config.planner_row_threshold)


def first_three(usages: DataFrame) -> DataFrame:
    """(table, column, evidence): the first three usages by seq, one a line.

    The group limit that Spark puts below the window keeps three rows of a group
    in each task before they are shuffled.
    """
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq"))
    few = usages.withColumn("__place", place).filter(F.col("__place") <= SHOWN)
    return few.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", usage_text().alias("t")))), lambda x: x["t"]), "\n").alias("evidence"))


def grouped(usages: DataFrame, config: Config, confirmed: Column) -> DataFrame:
    """One row for each table and column: uses, confirmed, details and evidence."""
    planned = (F.col("origin") == "runtime") & F.col("plan_summary").isNotNull()
    shown = F.struct(
        F.lit(True).alias("planner_confirmed"), F.lit(config.planner_row_threshold).cast("bigint").alias("planner_row_threshold"),
        "plan_root_node_type", "plan_relation_node_type", "plan_relation_name", "plan_rows",
    )
    sums = usages.groupBy(*KEY).agg(
        F.sum("count").alias("uses"), F.bool_or(F.coalesce(confirmed, F.lit(False))).alias("confirmed"),
        F.to_json(F.min_by(F.when(planned, shown), F.when(planned, F.col("seq"))), {"ignoreNullFields": "false"}).alias("details"),
    )
    return sums.join(first_three(usages), KEY)


def of(usages: DataFrame, operation: str) -> DataFrame:
    return usages.filter((F.col("operation") == operation) & F.col("table_name").isNotNull() & F.col("column_name").isNotNull())


def first_model(rows: DataFrame, models: DataFrame) -> DataFrame:
    return rows.join(models.groupBy("table_name").agg(F.min_by("model", "seq").alias("model")), "table_name", "left")


def severity() -> Column:
    return F.when(F.col("confirmed"), F.lit("high")).otherwise(F.lit("medium"))


def reported(rows: DataFrame, code: str, title: str, problem: Column | str, recommendation: Column | str) -> DataFrame:
    return finding(
        rows, code=code, severity=severity(), title=title, model=F.col("model"), table=F.col("table_name"), column=F.col("column_name"),
        problem=problem, recommendation=recommendation, evidence=F.col("evidence"), details=F.col("details"),
    )


def add_index() -> Column:
    return text("add_index :", F.col("table_name"), ", :", F.col("column_name"))


def recurring_where(e: Evidence, config: Config) -> DataFrame:
    used = unled(of(e.usages, "where").join(e.tables.select("table_name"), "table_name", "left_semi").join(e.enums.select(*KEY), KEY, "left_anti"), e.tables, e.indexes)
    rows = first_model(grouped(used, config, scan_confirmed(config)).filter(F.col("uses") >= config.where_occurrence_threshold), e.models)
    return reported(rows, "recurring_where_without_index", "Recurring filter without an index", text("Queries filter ", F.col("table_name"), " by ", F.col("column_name"), ", which no index begins with."), add_index())


def enum_where(e: Evidence, config: Config) -> DataFrame:
    enums = e.enums.select("model", *KEY).distinct()
    used = unled(of(e.usages, "where").join(e.enums.select(*KEY), KEY, "left_semi").join(e.tables.select("table_name"), "table_name", "left_semi"), e.tables, e.indexes)
    rows = grouped(used, config, scan_confirmed(config)).join(enums, KEY)
    return reported(rows, "enum_where_without_index", "Filter by an enum column without an index", text("Queries filter ", F.col("table_name"), " by the enum column ", F.col("column_name"), ", which no index begins with."), add_index())


def json_query(e: Evidence, config: Config) -> DataFrame:
    used = of(e.usages, "jsonb_where").join(e.tables.select("table_name"), "table_name", "left_semi")
    failing = unserved_json(used, e.indexes).select(*KEY).distinct()
    rows = first_model(grouped(used.join(failing, KEY, "left_semi"), config, scan_confirmed(config)), e.models)
    return reported(rows, "jsonb_query_without_index", "JSON predicate without an index", text("Queries look inside ", F.col("table_name"), ".", F.col("column_name"), " without an index that serves the operator and key."), text("Add a GIN index on ", F.col("column_name"), " for containment, or an expression index for a key."))


def unsorted(e: Evidence, config: Config) -> DataFrame:
    used = of(e.usages, "order").join(e.tables.select("table_name"), "table_name", "left_semi")
    rows = first_model(grouped(unsupported_orders(used, e.tables, e.indexes), config, sort_confirmed(config)), e.models)
    return reported(rows, "order_without_index", "Sort order without an index", text("Queries sort ", F.col("table_name"), " by ", F.col("column_name"), ", which no index gives in order."), add_index())


RULES = {"recurring_where_without_index": recurring_where, "enum_where_without_index": enum_where, "jsonb_query_without_index": json_query, "order_without_index": unsorted}
