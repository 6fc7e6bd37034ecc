"""One query for each family of operators, over evidence derived from the driver's tables.

Arrays are joined to text, so that both engines compare alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures, report, rules
from .config import Config
from .functions import names, sqltext
from .functions.sqltext import let
from .operators import indexes, usages
from .plans import explain
from .sources import apptext, catalog, code, snapshot, tokens
from .workspace import ranked, saved, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
RULES = {
    "missing_belongs_to_index": ("tables", "columns", "indexes", "reflections"), "missing_foreign_key_constraint": ("tables", "columns", "foreign_keys", "reflections"),
    "missing_polymorphic_composite_index": ("tables", "columns", "indexes", "reflections"), "broad_dependent_destroy": ("tables", "reflections"), "default_scope": ("models",), "missing_inverse_of": ("reflections",),
    "foreign_key_without_index": ("tables", "indexes", "foreign_keys"), "table_without_primary_key": ("tables",), "table_without_timestamps": ("tables", "columns"),
    "recurring_where_without_index": ("tables", "indexes", "enums", "models", "usages"), "enum_where_without_index": ("tables", "indexes", "enums", "usages"),
    "jsonb_query_without_index": ("tables", "indexes", "models", "usages"), "order_without_index": ("tables", "indexes", "models", "usages"),
    "migration_reference_without_foreign_key": ("tables", "columns", "foreign_keys", "migrations"),
}
#: Suppression rules of the p29 query.
SUPPRESS = ({"code": "table_without_timestamps", "table": "region"}, {"severity": "medium", "model": "Ghost"}, {"column": "", "code": "table_without_primary_key"})


def listed(column: str | Column) -> Column:
    return F.coalesce(F.concat_ws(",", column), F.lit(""))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usages.recorded(fixtures.relation(spark, sf_dir, "query_log"))


def rule_query(number: int, code: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rules.findings(fixtures.evidence(spark, sf_dir, *RULES[code]), Config(), (code,))
        advice = ["recommendation"] if code == "missing_foreign_key_constraint" else []
        return found.select("code", "severity", "model", "table_name", "column_name", "evidence", "details", *advice)

    run.__name__ = f"r{number:02}_{code}"
    return run


def f01_table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("seq", F.posexplode(sqltext.table_refs(F.col("sql"))).alias("pos", "t")).select("seq", "pos", "t.name", "t.canonical", "t.alias")


def f03_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("seq", sqltext.where_fragment(F.col("sql")).alias("where_fragment"), sqltext.order_fragment(F.col("sql")).alias("order_fragment"))


def _refs(refs: Callable[[Column, Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = let(sqltext.table_refs(F.col("sql")), lambda tables: let(sqltext.where_fragment(F.col("sql")), lambda w: refs(w, tables)))
        return _log(spark, sf_dir).select("seq", F.explode(found).alias("r")).select("seq", "r.*")

    return run


def f05_column_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(sqltext.column_refs)(spark, sf_dir)


def f06_json_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(sqltext.json_refs)(spark, sf_dir)


def _binds() -> Column:
    bind = lambda value, numeric: F.struct(value.cast("string").alias("value"), F.lit(numeric).alias("numeric"))
    return F.when(F.col("seq") % 5 != 0, F.filter(F.array(bind(F.col("seq"), True), F.when(F.col("seq") % 3 > 0, bind(F.when(F.col("seq") % 3 == 1, F.lit("it's $1")), False))), lambda b: b.isNotNull()))


def f10_literalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("seq", sqltext.literalised(F.col("sql"), _binds()).alias("explain_sql"))


def p27_explainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.relation(spark, sf_dir, "query_log").select("seq", sqltext.explainable(F.col("sql")).alias("explainable"))


def f14_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    begun = F.col("ts").cast("timestamp")
    return events.select("event_id", sqltext.milliseconds(begun, begun + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 1000).cast("decimal(18,6)") / 800)).alias("ms"))


def f36_order_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragment = F.trim(sqltext.order_fragment(F.col("sql")))
    return _log(spark, sf_dir).select("seq", listed(sqltext.order_words(fragment)).alias("words"))


def a01_usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = usages.runtime_usages(fixtures.relation(spark, sf_dir, "query_log"))
    return found.select("table_name", "column_name", "operation", listed("where_columns").alias("where_columns"), "count", "total_duration_ms", "source", "explain_source", "seq")


def u01_all_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.usages(spark, sf_dir).groupBy("origin", "operation").agg(F.count("*").alias("n"), F.sum("count").alias("uses"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.relation(spark, sf_dir, "names")


def f15_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names.ranked(_names(spark, sf_dir), fixtures.relation(spark, sf_dir, "search_path"))
    return rows.select("table_name", names.schema_of(F.col("table_name")).alias("schema_name"), names.base_of(F.col("table_name")).alias("base"), "rank")


def j18_canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = usages.runtime_usages(fixtures.relation(spark, sf_dir, "query_log")).select("seq", "table_name", F.lit(None).cast("string").alias("plan_relation_name"))
    return names.canonicalised(counted, _names(spark, sf_dir), fixtures.relation(spark, sf_dir, "search_path"), ("table_name", "plan_relation_name"))


def s01_scanned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = fixtures.relation(spark, sf_dir, "models").select("table_name").union(spark.createDataFrame([("analytics.part",), ("other.nation",)], "table_name string"))
    return catalog.scanned(fixtures.relation(spark, sf_dir, "tables"), models, fixtures.relation(spark, sf_dir, "search_path"), ("region",))


def s02_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        one = catalog.frame_columns(name, spark.read.parquet(f"{sf_dir}/{name}.parquet")).select("table_name", "column_name")
        out = one if out is None else out.union(one)
    return out


def s05_row_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "part", "events", "nation")}
    sizes = catalog.frame_tables(frames, {"orders": ["o_orderkey"]}).select(F.explode(F.array(*map(F.lit, ("analytics", "public", "other")))).alias("schema_name"), F.col("table_name").alias("relation"), F.col("estimated_row_count").alias("row_count"))
    sizes = sizes.filter("not (schema_name = 'analytics' and relation in ('part', 'nation')) and not (schema_name = 'public' and relation = 'nation')").withColumn("row_count", F.col("row_count") + F.length("schema_name"))
    wanted = spark.createDataFrame([(n,) for n in ("orders", "part", "nation", "public.orders", "other.nation", "nowhere")], "table_name string")
    return catalog.row_estimates(sizes, wanted, fixtures.relation(spark, sf_dir, "search_path"))


def s05_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of tables over the given files, of which one has no statistics; the tables go, the figures stay."""
    named = {n: f"{n}_{uuid.uuid4().hex}" for n in ("orders", "part", "events", "nation")}
    for n, table in named.items():
        spark.catalog.createTable(table, path=f"{sf_dir}/{n}.parquet", source="parquet")
        if n != "nation":
            spark.sql(f"analyze table {table} compute statistics")
    found = saved(catalog.statistics(spark, list(named.values())), "statistics")
    for table in named.values():
        spark.sql(f"drop table {table}")
    return found.select(F.regexp_extract("table_name", "^[a-z]+", 0).alias("table_name"), "estimated_row_count")


def s08_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.distinct_models(fixtures.relation(spark, sf_dir, "models"))


def o05_plan_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.summaries(fixtures.relation(spark, sf_dir, "plans"))


def j19_annotated_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fixtures.usages(spark, sf_dir)
    return found.select("table_name", "column_name", "operation", listed("where_columns").alias("where_columns"), "origin", "source", "plan_summary", "plan_root_node_type", "plan_relation_node_type", "plan_relation_name", "plan_rows")


def _catalog_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(fixtures.relation(spark, sf_dir, n) for n in ("columns", "tables", "indexes"))


def p09_unindexed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, _, ix = _catalog_columns(spark, sf_dir)
    return indexes.without_prefix(columns, ix, F.array("column_name")).select("table_name", "column_name")


def p11_leading_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tables, ix = _catalog_columns(spark, sf_dir)
    return indexes.leading_columns(tables, ix)


def p13_unsupported_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tables, ix = _catalog_columns(spark, sf_dir)
    found = usages.runtime_usages(fixtures.relation(spark, sf_dir, "query_log")).filter("operation = 'order'")
    return indexes.unsupported_orders(found, tables, ix).select("table_name", "column_name", listed("where_columns").alias("where_columns"), "count")


def p22_unserved_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ix = _catalog_columns(spark, sf_dir)
    statements = usages.observed(_log(spark, sf_dir)).filter("operation = 'jsonb_where'").select("seq", "table_name", "column_name", F.col("sql").alias("source"))
    return indexes.unserved_json(statements, ix).select("seq", "table_name", "column_name")


def p23_json_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("seq", listed(indexes.json_fragments(F.col("sql"), F.lit("props"))).alias("fragments"), indexes.contained(F.col("sql"), F.lit("props")).alias("contained"))


def _all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(fixtures.evidence(spark, sf_dir, *sorted({n for names_ in RULES.values() for n in names_})).kept())


def _catalog_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = ("default_scope", "table_without_primary_key", "table_without_timestamps", "foreign_key_without_index")
    return rules.findings(fixtures.evidence(spark, sf_dir, "tables", "columns", "indexes", "foreign_keys", "models"), Config(), codes)


def p29_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.suppressed(_catalog_findings(spark, sf_dir), SUPPRESS).select("code", "severity", "model", "table_name", "column_name")


def o01_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's order as numbers, ranked over all parts."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    place = F.struct((-report.rank()).alias("r"), "code", blank("table_name"), blank("column_name"), blank("model"), blank("evidence"))
    found = ranked(_catalog_findings(spark, sf_dir).withColumn("place", place), "place")
    return found.select(F.col("place").cast("int").alias("place"), "severity", "code", "table_name", "column_name")


def a07_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts(_all_findings(spark, sf_dir))


def s19_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = _catalog_findings(spark, sf_dir).withColumns({"title": F.lit("t"), "problem": F.lit("p\nq"), "recommendation": F.lit("r")})
    return report.rendered_lines(few).select("code", "table_name", "body")


def s20_fails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _catalog_findings(spark, sf_dir)
    return spark.createDataFrame([(s, report.fails(found.filter("severity <> 'high'"), s)) for s in report.SEVERITIES], "threshold string, fails boolean")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot documents over the counted usages, one for each operation."""
    found = usages.runtime_usages(fixtures.relation(spark, sf_dir, "query_log"))
    item = F.struct("seq", F.struct(F.col("table_name").alias("table"), F.col("column_name").alias("column"), "operation", "source", "origin", "count", "total_duration_ms", "where_columns", F.col("path"), F.col("line")).alias("u"))
    grouped = found.groupBy("operation").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["u"]).alias("query_usages"))
    meta = F.struct(F.lit(2).alias("schema_version"), F.struct(F.lit(report.NAME).alias("name"), F.lit("1").alias("version")).alias("generator"), F.struct(F.lit(False).alias("literalized_binds")).alias("capture"))
    text = F.to_json(F.struct(meta.alias("metadata"), F.array().cast("array<string>").alias("queries"), "query_usages"), {"ignoreNullFields": "false"})
    return grouped.select(F.parse_json(text).alias("doc"))


def s09_model_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported models, one for each customer, taken apart into reflections and enums."""
    key = F.col("c_custkey")
    name = lambda prefix: F.concat(F.lit(prefix), key.cast("string"))
    none = F.lit(None).cast("string")
    fields = {
        "name": name("r"), "macro": F.when(key % 2 == 0, F.lit("has_many")).otherwise(F.lit("belongs_to")), "options": F.create_map(F.lit("dependent"), F.lit("destroy")), "foreign_key": name("k"), "foreign_type": none,
        "target_table": name("t"), "klass_name": name("K"), "polymorphic": key % 5 == 0, "inverse_name": none, "association_primary_key": none,
    }
    reflection = F.struct(*[v.alias(k) for k, v in fields.items()])
    docs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.alias("seq"), name("M").alias("model"), F.lit("customer").alias("table_name"), F.when(key % 3 > 0, F.array_repeat(reflection, 1)).alias("reflections"),
        F.array_repeat(F.lit("x"), (key % 4).cast("int")).alias("default_scopes"), F.when(key % 7 == 0, F.create_map(F.lit("state"), F.lit("1"))).alias("enums"), none.alias("source_location"),
    )
    models, reflections, enums = catalog.model_relations(docs)
    found = models.join(reflections.select("model", "name", "macro", "target_table", "polymorphic"), "model", "left").join(enums.select("model", F.col("column_name").alias("enum")), "model", "left")
    return found.select("model", "default_scope_count", "name", "macro", "target_table", "polymorphic", "enum")


def s17_snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the query log after they were written as a snapshot's parts and read again."""
    log = saved(_log(spark, sf_dir), "log")
    base = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.write(log, usages.runtime_usages(log), base)
    return snapshot.load(spark, base).select("table_name", "column_name", "operation", listed("where_columns").alias("where_columns"), "count", "total_duration_ms", "source", "explain_source")


def s18_report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the JSON report, in its order."""
    found = report.Report(_catalog_findings(spark, sf_dir)).as_json()
    rows = [(i, f["severity"], f["code"], f["table"], found["counts"][f["severity"]]) for i, f in enumerate(found["findings"], 1)]
    return spark.createDataFrame(rows, "place int, severity string, code string, table_name string, of_severity long")


def s13_snapshot_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.snapshot_usages(_documents(spark, sf_dir)).select("table_name", "column_name", "operation", listed("where_columns").alias("where_columns"), "count", "total_duration_ms", "source", "origin")


def f30_snapshot_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each generated document, null for valid ones."""
    docs = fixtures.relation(spark, sf_dir, "snapshot_documents").select("document", F.parse_json("text").alias("doc"))
    first = snapshot.faults(docs).groupBy("document").agg(F.min_by("message", F.struct("section", "idx", "ord")).alias("message"))
    return docs.select("document").join(first, "document", "left")


FILES = (
    ("app/models/order.rb", "class Order\n  # Order.where(o_totalprice: 1)\n  def self.recent\n    Order.where(o_custkey: 1, gone: 2)\n      .order(:o_orderdate, o_totalprice: :desc)\n  end\n  x = \"Order.where(o_orderkey: 1)\"\nend\n"),
    ("lib/report.rb", "Event.where(\"props ->> 'k' = '1'\").where(user_id: 3).order('ts DESC, event_id')\nGhost.where(a: 1)\nCustomer.reorder(:c_name)\n"),
)
CHANGES = (
    ("db/migrate/1.rb", "class A\n  def change\n    add_reference :orders, :customer\n    add_reference :orders, :part, foreign_key: true\n    add_belongs_to :events, :subject, polymorphic: true\n    add_column :nation, :region_id, :bigint\n    add_column :nation, :region_name, :string\n  end\nend\n"),
    ("db/migrate/2.rb", "class B\n  def change\n    create_table :notes do |t|\n      t.references :author\n      t.belongs_to :order, foreign_key: { to_table: :orders }\n      # t.references :hidden\n      t.string :name\n    end\n  end\nend\n"),
)


def x01_source_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame(list(FILES), "path string, text string").union(fixtures.relation(spark, sf_dir, "source_files"))
    found = apptext.source_usages(files, fixtures.relation(spark, sf_dir, "models"), fixtures.relation(spark, sf_dir, "columns"))
    return found.select("path", "line", "table_name", "column_name", "operation", listed("where_columns").alias("where_columns"))


def _code(spark: SparkSession, sf_dir: str, *kinds: int) -> DataFrame:
    """Usages in the generated models' files and the code of some kinds."""
    files = fixtures.relation(spark, sf_dir, "user_files").filter(F.col("c").isNotNull() & (F.col("c") % 5).isin(*kinds)).select("path", "text").union(fixtures.relation(spark, sf_dir, "model_files"))
    found = code.analysed(files, fixtures.relation(spark, sf_dir, "code_models"), fixtures.relation(spark, sf_dir, "code_columns"))
    return found.select("path", "line", "table_name", "column_name", "operation", listed("where_columns").alias("where_columns"), "source")


def x03_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all generated files, each with its place, line and kind."""
    files = fixtures.relation(spark, sf_dir, "user_files").select("path", "text").union(fixtures.relation(spark, sf_dir, "model_files"))
    return tokens.lexed(files).filter("kind <> 'space'").select("path", "pos", "line", "kind", "text")


def x04_local_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages through local variables, reassigned and shadowed."""
    return _code(spark, sf_dir, 0, 1).filter("path like 'lib/%'")


def x05_named_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages through named scopes, with those in the models' own files."""
    return _code(spark, sf_dir, 2)


def x06_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages through class methods that call others, or themselves."""
    return _code(spark, sf_dir, 3, 4).filter("path like 'lib/%'")


def x02_migration_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame(list(CHANGES), "path string, text string").union(fixtures.relation(spark, sf_dir, "migration_files"))
    return apptext.migration_changes(files).select("path", "line", "table_name", "column_name", "source")


def st03_stream_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log as a stream, captured to its end; the counts are those of a01."""
    from .streaming.capture import Capture, event_stream

    base = f"{shared_dir(spark)}/capture-{uuid.uuid4().hex}"
    fixtures.relation(spark, sf_dir, "query_log").write.parquet(f"{base}/events")
    found = Capture(event_stream(spark, f"{base}/events"), f"{base}/session").run().usages()
    return found.select("table_name", "column_name", "operation", listed("where_columns").alias("where_columns"), "count", F.col("duration").cast("double").alias("total_duration_ms"), "source", "explain_source")


def _counted(found: DataFrame) -> DataFrame:
    return found.select("table_name", "column_name", "operation", listed("where_columns").alias("where_columns"), "count", F.col("duration").cast("double").alias("total_duration_ms"), "source", "explain_source")


def st03_running_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log in three parts, counted in the state store by a session that is begun anew for each; the counts are those of a01."""
    from .streaming.capture import event_stream
    from .streaming.running import Running

    base = f"{shared_dir(spark)}/running-{uuid.uuid4().hex}"
    log = fixtures.relation(spark, sf_dir, "query_log")
    for part in range(3):
        log.filter(F.pmod("seq", F.lit(3)) == part).write.mode("append").parquet(f"{base}/events")
        session = Running(event_stream(spark, f"{base}/events"), f"{base}/session").run()
    return _counted(session.usages())


def s15_growing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log as lines of JSON that come in two steps; the session is begun anew for the second.  The counts are those of a01."""
    from .streaming.capture import Capture
    from .streaming.growing import log_stream

    base = f"{shared_dir(spark)}/growing-{uuid.uuid4().hex}"
    began = F.lit(1_700_000_000).cast("decimal(20,6)") + F.col("seq")
    event = F.to_json(F.struct("seq", "sql", "name", began.alias("started"), (began + (F.col("duration_ms") / 1000).cast("decimal(20,6)")).alias("finished")))
    lines = fixtures.relation(spark, sf_dir, "query_log").select("seq", event.alias("value"))
    for step in range(2):
        lines.filter(F.pmod("seq", F.lit(2)) == step).select("value").write.mode("append").text(f"{base}/log")
        session = Capture(log_stream(spark, f"{base}/log"), f"{base}/session").run()
    return _counted(session.usages()).drop("explain_source")


def st05_session_while_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a session that still runs: it has taken in the statements with even numbers, and a batch of others lies half-written."""
    from .streaming.capture import Capture, event_stream

    base = f"{shared_dir(spark)}/capture-{uuid.uuid4().hex}"
    log = fixtures.relation(spark, sf_dir, "query_log")
    log.filter(F.pmod("seq", F.lit(2)) == 0).write.parquet(f"{base}/events")
    session = Capture(event_stream(spark, f"{base}/events"), f"{base}/session").start(processingTime="1 second").settle()
    try:
        log.filter(F.pmod("seq", F.lit(2)) == 1).write.parquet(f"{base}/session/log/epoch=9-unfinished")
        return _counted(saved(session.usages(), "counts"))
    finally:
        session.stop()


def queries() -> dict[str, Query]:
    found = {f.__name__: f for f in (
        f01_table_refs, f03_fragments, f05_column_refs, f06_json_refs, f10_literalised, p27_explainable, f14_durations, f36_order_words, a01_usage_counts, u01_all_usages, f15_names, j18_canonical_names,
        s01_scanned_tables, s02_columns, s05_row_estimates, s05_statistics, s08_models, o05_plan_summaries, j19_annotated_usages, p09_unindexed_columns, p11_leading_columns, p13_unsupported_orders, p22_unserved_json,
        p23_json_fragments, p29_suppressed, o01_report_order, a07_severity_counts, s19_report_text, s20_fails, s09_model_relations, s13_snapshot_usages, s17_snapshot_round_trip, s18_report_findings, f30_snapshot_faults, x01_source_usages, x03_tokens, x04_local_variables, x05_named_scopes, x06_helpers, x02_migration_changes, st03_stream_usages, st03_running_usages, s15_growing_log, st05_session_while_running,
    )}
    return found | {(q := rule_query(i, code)).__name__: q for i, code in enumerate(RULES, 1)}
