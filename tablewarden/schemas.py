"""The evidence relations as DDL, and empty ones of them.

Every relation whose order shows in a result carries `seq`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "tables": "table_name string, primary_key array<string>, estimated_row_count bigint",
    "columns": "table_name string, column_name string, type string, sql_type string, nullable boolean",
    "indexes": "table_name string, index_name string, columns array<string>, is_unique boolean, method string, orders map<string,string>, opclasses map<string,string>, predicate string",
    "foreign_keys": "table_name string, fk_name string, from_table string, to_table string, columns array<string>, primary_key string",
    "models": "seq bigint, model string, table_name string, default_scope_count int, source_location string",
    "reflections": "seq bigint, model string, table_name string, name string, macro string, options map<string,string>, foreign_key string, foreign_type string, target_table string, klass_name string, polymorphic boolean, inverse_name string, association_primary_key string",
    "enums": "model string, table_name string, column_name string",
    "query_log": "seq bigint, sql string, name string, duration_ms decimal(18,2), explain_sql string, ts timestamp",
    "usages": "seq bigint, table_name string, column_name string, operation string, source string, origin string, count bigint, total_duration_ms double, path string, line int, explain_source string, plan_summary string, plan_root_node_type string, plan_relation_node_type string, plan_relation_name string, plan_rows bigint, where_columns array<string>",
    "migrations": "seq bigint, table_name string, column_name string, path string, line int, source string",
    "plans": "statement string, plan_json string",
    "search_path": "rank int, schema_name string",
    "findings": "severity string, code string, title string, model string, table_name string, column_name string, problem string, recommendation string, evidence string, details string",
}


def columns(name: str) -> list[str]:
    """Names of a relation's columns, in order."""
    out, depth, word = [], 0, ""
    for ch in SCHEMAS[name] + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
