"""Captured query snapshots: reading, validating and writing JSON artifacts.

A snapshot is one JSON document, or a folder with the same content in parts:
`metadata` holds the head, `queries` and `query_usages` hold one item a line, each
with its number.  Spark writes and reads the parts row by row, so a long log never
meets in one task or in the driver; a single document is one value of one row, for
logs of up to some 100 MB (a VARIANT's limit).  Items are read as VARIANT, so that
absent, null and mistyped fields can be told apart; every check is a row (index,
order, message), and the first of them is reported.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AuditError
from ..report import NAME, metadata
from ..schemas import columns
from ..workspace import folders

#: Known layouts, the current one, and the usage fields by kind.
VERSIONS, CURRENT = (1, 2), 2
TEXTS = ("table", "column", "operation", "source")
NULLABLE_TEXTS = ("explain_source", "plan_summary", "plan_root_node_type", "plan_relation_node_type", "plan_relation_name")


def kind(value: Column) -> Column:
    """Type of a VARIANT: OBJECT..., ARRAY..., STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID; null if absent."""
    return F.schema_of_variant(value)


def _get(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def _is(value: Column, *kinds: str) -> Column:
    return F.coalesce(kind(value).rlike(f"^({'|'.join(kinds)})"), F.lit(False))


TEXT, WHOLE, NUMBER, OBJECT, LIST, NOTHING = ("STRING",), ("BIGINT",), ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), ("OBJECT",), ("ARRAY",), ("VOID",)


def _absent_or(value: Column, *kinds: str) -> Column:
    return value.isNull() | _is(value, *NOTHING, *kinds)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row with `doc`, the document as VARIANT; AuditError if it is missing or isn't JSON."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        raise AuditError(f"no query snapshot at {path}") from error
    docs = text.select(F.try_parse_json("value").alias("doc"))
    if docs.filter("doc is null").limit(1).count():
        raise AuditError(f"the query snapshot at {path} isn't JSON")
    return docs


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def header_faults(docs: DataFrame, generators: tuple[str, ...]) -> DataFrame:
    """(section, idx, ord, message) of the document's head; version is null for documents without metadata."""
    meta, usages = _get(F.col("doc"), "metadata"), _get(F.col("doc"), "query_usages")
    version, generator = _get(meta, "schema_version"), _get(meta, "generator")
    with_meta = ~_absent_or(meta)
    name = F.try_variant_get(generator, "$.name", "string")
    flag = F.try_variant_get(meta, "$.capture.literalized_binds", "variant")
    number = F.when(_is(version, *WHOLE), F.try_variant_get(version, "$", "bigint"))
    checks = [
        (~_is(F.col("doc"), *OBJECT) | ~_is(usages, *LIST), "must be an object with an array query_usages"),
        (with_meta & ~_is(meta, *OBJECT), "metadata must be an object"),
        (with_meta & ~F.coalesce(number.isin(*VERSIONS), F.lit(False)), f"metadata.schema_version must be one of {', '.join(map(str, VERSIONS))}"),
        (with_meta & ~(_is(_get(generator, "name"), *TEXT) & _is(_get(generator, "version"), *TEXT)), "metadata.generator must have name and version strings"),
        (with_meta & ~F.coalesce(name.isin(*generators), F.lit(False)), f"metadata.generator.name must be one of {', '.join(generators)}"),
        (with_meta & ~_is(flag, "BOOLEAN"), "metadata.capture.literalized_binds must be true or false"),
        (with_meta & ~_is(_get(F.col("doc"), "queries"), *LIST), "queries must be an array"),
    ]
    return _faults(docs, 0, F.lit(-1), checks)


def _faults(rows: DataFrame, section: int, index: Column, checks: list[tuple[Column, Column | str]]) -> DataFrame:
    found = F.array(*[F.when(bad, F.struct(F.lit(section).alias("section"), index.cast("int").alias("idx"), F.lit(i).alias("ord"), (m if isinstance(m, Column) else F.lit(m)).alias("message"))) for i, (bad, m) in enumerate(checks)])
    return rows.select(*_named(rows), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select(*_named(rows), "f.*")


def _named(rows: DataFrame) -> list[str]:
    """The column that tells documents apart, where there is one."""
    return [c for c in rows.columns if c == "document"]


def _items(docs: DataFrame, key: str) -> DataFrame:
    """(version, i, v): the items of an array of the documents."""
    version = F.try_variant_get("doc", "$.metadata.schema_version", "bigint").alias("version")
    return docs.select(*_named(docs), version, F.posexplode(F.try_variant_get("doc", f"$.{key}", "array<variant>")).alias("i", "v"))


def query_faults(items: DataFrame) -> DataFrame:
    v, at = F.col("v"), F.concat(F.lit("queries["), F.col("i").cast("string"), F.lit("]"))
    shape = _is(v, *OBJECT) & _is(_get(v, "sql"), *TEXT) & _absent_or(_get(v, "name"), *TEXT) & _is(_get(v, "duration_ms"), *NUMBER) & _absent_or(_get(v, "explain_sql"), *TEXT)
    negative = (F.col("version") == CURRENT) & (_number(_get(v, "duration_ms")) < 0)
    rows = items.filter(F.col("version").isNotNull())
    return _faults(rows, 1, F.col("i"), [(~shape, F.concat(at, F.lit(" is invalid"))), (negative, F.concat(at, F.lit(".duration_ms must be 0 or more")))])


def usage_faults(items: DataFrame) -> DataFrame:
    v, version = F.col("v"), F.col("version")
    at = lambda key, expected: F.concat(F.lit("query_usages["), F.col("i").cast("string"), F.lit(f"].{key} must be {expected}"))
    of = lambda key: _get(v, key)
    current, versioned = F.coalesce(version == CURRENT, F.lit(False)), version.isNotNull()
    where = of("where_columns")
    texts = F.forall(F.try_variant_get(where, "$", "array<variant>"), lambda x: _is(x, *TEXT))
    origin = F.try_variant_get(v, "$.origin", "string")
    checks = [(~_is(v, *OBJECT), F.concat(F.lit("query_usages["), F.col("i").cast("string"), F.lit("] must be an object")))]
    checks += [(~_is(of(key), *TEXT), at(key, "a string")) for key in TEXTS]
    checks += [(~_is(of("count"), *WHOLE), at("count", "an integer"))]
    checks += [(~_absent_or(of(key), *TEXT), at(key, "a string or null")) for key in NULLABLE_TEXTS]
    checks += [(~_absent_or(of("total_duration_ms"), *NUMBER), at("total_duration_ms", "a number or null")), (~_absent_or(of("plan_rows"), *WHOLE), at("plan_rows", "an integer or null"))]
    checks += [(~_absent_or(where) & ~(_is(where, *LIST) & F.coalesce(texts, F.lit(False))), at("where_columns", "an array of strings"))]
    checks += [(~F.coalesce(origin == "runtime", F.lit(False)) & ~(_absent_or(of("origin")) & ~versioned), at("origin", '"runtime"'))]
    checks += [(versioned & ~_is(of(key), *NOTHING), at(key, "present and null")) for key in ("path", "line")]
    checks += [(current & (_number(of("count")) < 1), at("count", "1 or more"))]
    checks += [(current & (_number(of(key)) < 0), at(key, "0 or more, or null")) for key in ("total_duration_ms", "plan_rows")]
    return _faults(items, 2, F.col("i"), checks)


def faults(docs: DataFrame, generators: tuple[str, ...] = (NAME,)) -> DataFrame:
    """All faults of the documents in `doc`, with their `document` where there is such a column; none means valid."""
    return reduce(DataFrame.unionByName, [header_faults(docs, generators), query_faults(_items(docs, "queries")), usage_faults(_items(docs, "query_usages"))])


def snapshot_usages(docs: DataFrame) -> DataFrame:
    """The usage relation of valid documents; absent origins and filter columns get their defaults."""
    return item_usages(_items(docs, "query_usages"))


def item_usages(items: DataFrame) -> DataFrame:
    """The usage relation of valid items (i, v)."""
    v = F.col("v")
    text = lambda key: F.try_variant_get(v, f"$.{key}", "string")
    made = {
        "seq": F.col("i").cast("bigint"), "table_name": text("table"), "column_name": text("column"), "origin": F.coalesce(text("origin"), F.lit("runtime")), "count": F.try_variant_get(v, "$.count", "bigint"),
        "total_duration_ms": F.try_variant_get(v, "$.total_duration_ms", "double"), "path": F.lit(None).cast("string"), "line": F.lit(None).cast("int"), "plan_rows": F.try_variant_get(v, "$.plan_rows", "bigint"),
        "where_columns": F.coalesce(F.try_variant_get(v, "$.where_columns", "array<string>"), F.array().cast("array<string>")),
    }
    return items.select(*[made.get(c, text(c)).alias(c) for c in columns("usages")])


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document without items, queries, usages) of a folder; items are (version, i, v)."""
    head = spark.read.text(f"{path}/metadata", wholetext=True).select(F.try_parse_json("value").alias("doc"))
    first = head.select(F.try_variant_get("doc", "$.metadata.schema_version", "bigint").alias("version")).first()
    version = F.lit(first["version"] if first else None).cast("bigint").alias("version")
    lines = lambda part: spark.read.text(f"{path}/{part}").select(F.try_parse_json("value").alias("line"))
    items = lambda part: lines(part).select(version, F.try_variant_get("line", "$.i", "bigint").alias("i"), F.try_variant_get("line", "$.v", "variant").alias("v"))
    return head, items("queries"), items("query_usages")


def load(spark: SparkSession, path: str, generators: tuple[str, ...] = (NAME,)) -> DataFrame:
    """Validated usages of the snapshot at `path`; the first fault raises AuditError."""
    if "metadata" in folders(spark, path):
        head, queries, items = _parts(spark, path)
        found = reduce(DataFrame.unionByName, [header_faults(head, generators), query_faults(queries), usage_faults(items)])
    else:
        head = read_document(spark, path)
        items, found = _items(head, "query_usages"), faults(head, generators)
    first = found.orderBy("section", "idx", "ord").first()
    if first:
        raise AuditError(f"the query snapshot at {path} is invalid: {first['message']}")
    return item_usages(items)


def _query_items(query_log: DataFrame) -> DataFrame:
    return query_log.select("seq", F.struct("sql", "name", F.col("duration_ms").cast("double").alias("duration_ms"), "explain_sql").alias("v"))


def _usage_items(usages: DataFrame) -> DataFrame:
    names = {"table_name": "table", "column_name": "column"}
    return usages.select("seq", F.struct(*[F.col(c).alias(names.get(c, c)) for c in columns("usages") if c != "seq"]).alias("v"))


def _head(query_log: DataFrame) -> dict:
    return metadata(CURRENT, capture={"literalized_binds": bool(query_log.filter("explain_sql is not null").limit(1).count())})


def write(query_log: DataFrame, usages: DataFrame, path: str) -> None:
    """The artifact as a folder of parts; items are numbered by their place in the log."""
    spark = query_log.sparkSession
    text = json.dumps({"metadata": _head(query_log), "queries": [], "query_usages": []})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    for part, rows in (("queries", _query_items(query_log)), ("query_usages", _usage_items(usages))):
        rows.select(F.to_json(F.struct(F.col("seq").alias("i"), "v"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/{part}")


def document(query_log: DataFrame, usages: DataFrame) -> str:
    """The artifact as one JSON text, for logs that fit the driver as one file does."""
    lines = lambda rows: [json.loads(r["v"]) for r in rows.orderBy("seq").select(F.to_json("v", {"ignoreNullFields": "false"}).alias("v")).collect()]
    return json.dumps({"metadata": _head(query_log), "queries": lines(_query_items(query_log)), "query_usages": lines(_usage_items(usages))}, indent=2)
