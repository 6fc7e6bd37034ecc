"""Which access paths a table has, as joins against its indexes.

Catalogs are small next to logs; nothing here forces a broadcast, Spark picks
one when statistics prove the size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixes(indexes: DataFrame) -> DataFrame:
    """(table_name, prefix): every leading part of every index, as often as indexes begin with it."""
    return indexes.select("table_name", F.explode(F.transform(F.sequence(F.lit(1), F.size("columns")), lambda n: F.slice("columns", F.lit(1), n))).alias("prefix"))


def without_prefix(rows: DataFrame, indexes: DataFrame, *wanted: Column, table_col: str = "table_name") -> DataFrame:
    """`rows` for whose table no index begins with any of the column lists in `wanted`."""
    for columns in wanted:
        side = prefixes(indexes.filter("size(columns) > 0")).select(F.col("table_name").alias("__t"), "prefix")
        rows = rows.join(side, (F.col(table_col) == F.col("__t")) & (columns == F.col("prefix")), "left_anti")
    return rows


def _leading(tables: DataFrame, indexes: DataFrame) -> DataFrame:
    first = indexes.filter("size(columns) > 0").select("table_name", F.get("columns", F.lit(0)).alias("column_name"))
    key = tables.filter("size(primary_key) = 1").select("table_name", F.get("primary_key", F.lit(0)).alias("column_name"))
    return first.union(key)


def leading_columns(tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """(table_name, column_name) that an index begins with or that are a whole primary key, each once."""
    return _leading(tables, indexes).distinct()


def unled(rows: DataFrame, tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """`rows` whose column no index begins with and is no whole primary key."""
    return rows.join(_leading(tables, indexes), ["table_name", "column_name"], "left_anti")


def orders_by(columns: Column, column: Column, filters: Column) -> Column:
    """Whether an index gives rows in order of `column` once all columns before it are filtered on."""
    at = F.array_position(columns, column).cast("int")
    return (at > 1) & F.forall(F.slice(columns, F.lit(1), at - 1), lambda c: F.array_contains(filters, c))


def unsupported_orders(usages: DataFrame, tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """Order usages that no primary key, leading column or filtered composite index serves."""
    rows = unled(usages, tables, indexes)
    side = indexes.filter("size(columns) > 1").select(F.col("table_name").alias("__t"), F.col("columns").alias("__c"))
    served = orders_by(F.col("__c"), F.col("column_name"), F.coalesce("where_columns", F.array().cast("array<string>")))
    return rows.join(side, (F.col("table_name") == F.col("__t")) & F.coalesce(served, F.lit(False)), "left_anti")


def json_normal(text: Column) -> Column:
    """An expression without casts to text, blanks and parentheses."""
    return F.translate(F.regexp_replace(F.replace(text, F.lit("::text"), F.lit("")), r"\s+", ""), "()", "")


def json_fragments(source: Column, column: Column) -> Column:
    """Normal forms of the extractions of `column` in a statement's text."""
    pattern = F.concat(F.lit(r"\Q"), column, F.lit(r"\E\s*(?:->>|->)\s*'(?:[^']+)'"))
    return F.transform(F.regexp_extract_all(source, pattern, F.lit(0)), json_normal)


def contained(source: Column, column: Column) -> Column:
    """Whether the text has a containment test of `column`."""
    return F.regexp_like(source, F.concat(F.lit(r"\b\Q"), column, F.lit(r"\E\b\s*@>")))


def json_served(columns: Column, method: Column, source: Column, column: Column) -> Column:
    """Whether an index serves a JSON usage: whole-column containment, or an expression over the same key."""
    whole = F.array_contains(columns, column) & F.lower(method).isin("gin", "gist") & contained(source, column)
    normal = F.transform(columns, json_normal)
    expression = F.exists(json_fragments(source, column), lambda f: F.exists(normal, lambda c: F.contains(c, f)))
    return F.coalesce(whole, F.lit(False)) | F.coalesce(expression, F.lit(False))


def unserved_json(usages: DataFrame, indexes: DataFrame) -> DataFrame:
    """`usages` (JSON) that no index of their table serves."""
    side = indexes.select(F.col("table_name").alias("__t"), F.col("columns").alias("__c"), F.col("method").alias("__m"))
    served = json_served(F.col("__c"), F.col("__m"), F.col("source"), F.col("column_name"))
    return usages.join(side, (F.col("table_name") == F.col("__t")) & served, "left_anti")
