"""Catalog relations from Spark tables, from JDBC metadata, or from tables of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import without_path_aliases
from ..schemas import SCHEMAS, empty

#: Metadata queries of the standard information schema and of PostgreSQL.
JDBC = {
    "columns": "select table_schema || '.' || table_name as table_name, column_name, data_type as type, udt_name as sql_type, is_nullable = 'YES' as nullable from information_schema.columns where table_schema not in ('pg_catalog', 'information_schema')",
    "tables": "select n.nspname || '.' || c.relname as table_name, c.reltuples::bigint as estimated_row_count, (select array_agg(a.attname order by k.n) from pg_index i cross join lateral unnest(i.indkey) with ordinality k(attnum, n) join pg_attribute a on a.attrelid = c.oid and a.attnum = k.attnum where i.indrelid = c.oid and i.indisprimary) as primary_key from pg_class c join pg_namespace n on n.oid = c.relnamespace where c.relkind in ('r', 'p') and n.nspname not in ('pg_catalog', 'information_schema')",
    "indexes": "select n.nspname || '.' || t.relname as table_name, x.relname as index_name, array(select pg_get_indexdef(i.indexrelid, k, true) from generate_series(1, i.indnkeyatts) k) as columns, i.indisunique as is_unique, m.amname as method, pg_get_expr(i.indpred, i.indrelid) as predicate from pg_index i join pg_class t on t.oid = i.indrelid join pg_class x on x.oid = i.indexrelid join pg_am m on m.oid = x.relam join pg_namespace n on n.oid = t.relnamespace where not i.indisprimary and n.nspname not in ('pg_catalog', 'information_schema')",
    "foreign_keys": "select n.nspname || '.' || t.relname as table_name, k.conname as fk_name, t.relname as from_table, f.relname as to_table, (select array_agg(a.attname order by c.n) from unnest(k.conkey) with ordinality c(attnum, n) join pg_attribute a on a.attrelid = k.conrelid and a.attnum = c.attnum) as columns, (select max(a.attname) from pg_attribute a where a.attrelid = k.confrelid and a.attnum = k.confkey[1]) as primary_key from pg_constraint k join pg_class t on t.oid = k.conrelid join pg_class f on f.oid = k.confrelid join pg_namespace n on n.oid = t.relnamespace where k.contype = 'f'",
    "search_path": "select (row_number() over ())::int - 1 as rank, s as schema_name from unnest(current_schemas(false)) s",
}


def jdbc_relation(spark: SparkSession, name: str, url: str, **options: str) -> DataFrame:
    """One catalog relation of a PostgreSQL database; columns that the source lacks are null."""
    found = spark.read.format("jdbc").options(url=url, query=JDBC[name], **options).load()
    return _shaped(found, name)


def _asked(result, *names: str) -> list[tuple]:
    """Rows of a JDBC result, the named columns as text."""
    out = []
    while result.next():
        out.append(tuple(result.getString(n) for n in names))
    result.close()
    return out


def database_catalog(spark: SparkSession, url: str, schema: str | None = None) -> dict[str, DataFrame]:
    """tables, columns, indexes and foreign_keys of any database with a JDBC driver, by the driver's own metadata calls.

    A catalog is small: the names of a database's tables, columns and keys pass
    through the driver.  Row estimates are not among what drivers tell and stay
    null; the index behind a primary key is left out.
    """
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        meta = connection.getMetaData()
        kinds = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        tables, columns, indexes, keys = [], [], [], []
        for (name,) in _asked(meta.getTables(None, schema, None, kinds), "TABLE_NAME"):
            primary = [c for _, c in sorted((int(n), c) for n, c in _asked(meta.getPrimaryKeys(None, schema, name), "KEY_SEQ", "COLUMN_NAME"))]
            tables.append((name, primary or None))
            columns += [(name, c, kind.lower(), kind.lower(), null == "YES") for c, kind, null in _asked(meta.getColumns(None, schema, name, None), "COLUMN_NAME", "TYPE_NAME", "IS_NULLABLE")]
            parts: dict[tuple, list] = {}
            for index, plain, place, column, when in _asked(meta.getIndexInfo(None, schema, name, False, True), "INDEX_NAME", "NON_UNIQUE", "ORDINAL_POSITION", "COLUMN_NAME", "FILTER_CONDITION"):
                if index is not None:
                    parts.setdefault((index, plain.lower() in ("false", "0", "f"), when), []).append((int(place), column))
            indexes += [(name, index, [c for _, c in sorted(own)], unique, when) for (index, unique, when), own in parts.items() if not (unique and [c for _, c in sorted(own)] == primary)]
            links: dict[tuple, list] = {}
            for key, to, place, column, target in _asked(meta.getImportedKeys(None, schema, name), "FK_NAME", "PKTABLE_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKCOLUMN_NAME"):
                links.setdefault((key, to), []).append((int(place), column, target))
            keys += [(name, key, name, to, [c for _, c, _ in sorted(own)], sorted(own)[0][2]) for (key, to), own in links.items()]
    finally:
        connection.close()
    made = {
        "tables": (tables, "table_name string, primary_key array<string>"), "columns": (columns, "table_name string, column_name string, type string, sql_type string, nullable boolean"),
        "indexes": (indexes, "table_name string, index_name string, columns array<string>, is_unique boolean, predicate string"), "foreign_keys": (keys, "table_name string, fk_name string, from_table string, to_table string, columns array<string>, primary_key string"),
    }
    return {name: _shaped(spark.createDataFrame(rows, kind), name) for name, (rows, kind) in made.items()}


def _shaped(found: DataFrame, name: str) -> DataFrame:
    """The columns of a relation's schema; those that the source lacks are null."""
    target = empty(found.sparkSession, name).schema
    return found.select(*[(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def frame_columns(table_name: str, frame: DataFrame) -> DataFrame:
    """The columns relation of one DataFrame, from its schema alone."""
    rows = [(table_name, f.name, f.dataType.typeName(), f.dataType.simpleString(), f.nullable) for f in frame.schema]
    return frame.sparkSession.createDataFrame(rows, SCHEMAS["columns"])


def frame_tables(frames: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """The tables relation of DataFrames, with exact row counts (Parquet answers them from its footers)."""
    spark = next(iter(frames.values())).sparkSession
    counted = [f.agg(F.count("*").alias("estimated_row_count")).select(F.lit(name).alias("table_name"), F.lit(keys.get(name)).cast("array<string>").alias("primary_key"), "estimated_row_count") for name, f in frames.items()]
    out = empty(spark, "tables")
    for one in counted:
        out = out.unionByName(one)
    return out


def statistics(spark: SparkSession, tables: list[str]) -> DataFrame:
    """(table_name, estimated_row_count) of saved tables, from what ANALYZE TABLE has left in the catalog; null where it never ran.

    Nothing is counted: only the catalog is asked, a statement a table.
    """
    out = spark.createDataFrame([], "table_name string, estimated_row_count bigint")
    for name in tables:
        rows = F.regexp_extract("data_type", r"(\d+) rows", 1)
        told = spark.sql(f"describe table extended {name}").filter("col_name = 'Statistics'").agg(F.max(F.nullif(rows, F.lit("")).cast("bigint")).alias("estimated_row_count"))
        out = out.union(told.select(F.lit(name).alias("table_name"), "estimated_row_count"))
    return out


def scanned(tables: DataFrame, models: DataFrame, search_path: DataFrame, ignored: tuple[str, ...]) -> DataFrame:
    """Names to audit: catalog and model tables, without ignored ones and unqualified doubles of names in the path."""
    extra = models.select("table_name").filter("table_name is not null").distinct()
    names = tables.select("table_name").union(extra).distinct().filter(~F.col("table_name").isin(list(ignored)))
    return without_path_aliases(names, extra, search_path)


def row_estimates(sizes: DataFrame, names: DataFrame, search_path: DataFrame) -> DataFrame:
    """(table_name, estimated_row_count) of `names` from `sizes` (schema_name, relation, row_count).

    A qualified name means its schema; another one the first schema of the path
    that has the relation.  Unknown names are null.
    """
    ranked = sizes.join(search_path, "schema_name", "left")
    exact = ranked.select(F.concat_ws(".", "schema_name", "relation").alias("table_name"), F.col("row_count").alias("exact"))
    first = ranked.filter("rank is not null").groupBy(F.col("relation").alias("table_name")).agg(F.min_by("row_count", "rank").alias("nearest"))
    return names.select("table_name").join(exact, "table_name", "left").join(first, "table_name", "left").select("table_name", F.coalesce("exact", "nearest").alias("estimated_row_count"))


def distinct_models(models: DataFrame) -> DataFrame:
    """Models once for each name and table, the first by seq."""
    first = models.groupBy("model", "table_name").agg(F.min_by(F.struct("seq", "default_scope_count", "source_location"), "seq").alias("m"))
    return first.select("m.seq", "model", "table_name", F.coalesce("m.default_scope_count", F.lit(0)).alias("default_scope_count"), "m.source_location")


def model_relations(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, reflections, enums) of model documents: rows with seq, model, table_name, reflections, default_scopes, enums, source_location.

    Live reflection of an application has no place in Spark; it exports these rows.
    """
    models = documents.select("seq", "model", "table_name", F.coalesce(F.size("default_scopes"), F.lit(0)).alias("default_scope_count"), "source_location")
    rows = documents.select("seq", "model", "table_name", F.posexplode("reflections").alias("pos", "r"))
    reflections = rows.select((F.col("seq") * 1000 + F.col("pos")).alias("seq"), "model", "table_name", "r.*")
    enums = documents.select("model", "table_name", F.explode(F.map_keys("enums")).alias("column_name"))
    return models, reflections, enums
