"""Table names with and without schemas, and their resolution by search path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the rank of a schema that the search path lacks.
UNRANKED = 1_000_000


def schema_of(name: Column) -> Column:
    """What stands before the first dot; null without one."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", 1))


def base_of(name: Column) -> Column:
    """What stands after the first dot, or the name."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"(?s)^[^.]*\.(.*)$", 1)).otherwise(name)


def ranked(names: DataFrame, search_path: DataFrame, col: str = "table_name") -> DataFrame:
    """`names` with rank: the place of the schema in the search path."""
    path = search_path.groupBy("schema_name").agg(F.min("rank").alias("rank")).withColumnRenamed("schema_name", "__schema")
    return names.join(path, schema_of(F.col(col)) == F.col("__schema"), "left").drop("__schema").withColumn("rank", F.coalesce("rank", F.lit(UNRANKED)))


def resolutions(known: DataFrame, search_path: DataFrame) -> DataFrame:
    """(base, resolved) of the known names: the only name with that base, else the one whose schema comes first in the path."""
    names = ranked(known.select("table_name").filter("table_name is not null").distinct(), search_path).withColumn("base", base_of(F.col("table_name")))
    found = names.groupBy("base").agg(
        F.count("*").alias("n"), F.min("table_name").alias("only"), F.min_by(F.when(F.col("rank") < UNRANKED, F.col("table_name")), F.struct("rank", "table_name")).alias("ranked"),
    )
    return found.select("base", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("ranked")).alias("resolved"))


def canonicalised(rows: DataFrame, known: DataFrame, search_path: DataFrame, cols: tuple[str, ...] = ("table_name",)) -> DataFrame:
    """`rows` with the names in `cols` resolved; null becomes '', qualified and unknown names stay.

    `known` is a catalog, so its resolutions are small; Spark decides by size
    whether to broadcast them.
    """
    table = resolutions(known, search_path)
    for col in cols:
        side = table.select(F.col("base").alias("__base"), F.col("resolved").alias("__resolved"))
        rows = rows.join(side, F.col(col) == F.col("__base"), "left")
        rows = rows.withColumn(col, F.coalesce(F.when(~F.contains(F.col(col), F.lit(".")), F.col("__resolved")), F.col(col), F.lit(""))).drop("__base", "__resolved")
    return rows


def without_path_aliases(names: DataFrame, extra: DataFrame, search_path: DataFrame) -> DataFrame:
    """`names` without unqualified ones for which `extra` has a name qualified by a schema of the path."""
    qualified = extra.select(schema_of(F.col("table_name")).alias("schema_name"), base_of(F.col("table_name")).alias("table_name")).join(search_path.select("schema_name").distinct(), "schema_name", "left_semi")
    return names.join(qualified.select("table_name"), "table_name", "left_anti")


def relative(path: Column, root: str) -> Column:
    """`path` below `root`; another path stays."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def singular(word: Column) -> Column:
    """English singular of a table name by suffix, for generated advice only."""
    rules = ((r"(?i)(ss|us|is)$", "$1"), (r"(?i)ies$", "y"), (r"(?i)(x|ch|sh|ss)es$", "$1"), (r"(?i)(statu|viru|bonu)ses$", "$1s"), (r"(?i)s$", ""))
    out = word
    for pattern, by in reversed(rules):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, by)).otherwise(out)
    return out
