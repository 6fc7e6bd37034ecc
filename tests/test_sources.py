"""Sources, plans, streaming capture, the command line and the driver's entry."""

import json
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewarden import workspace
from tablewarden.__main__ import main
from tablewarden.functions.names import canonicalised
from tablewarden.config import AuditError
from tablewarden.operators.usages import all_usages, as_relation, runtime_usages, shapes
from tablewarden.plans import explain
from tablewarden.plans.explain import annotated, nodes, summaries
from tablewarden.schemas import SCHEMAS, columns, empty
from tablewarden.sources import apptext, catalog, snapshot
from tablewarden.streaming import capture
from tablewarden.streaming.capture import Capture, event_stream, with_binds

LOG = "seq long, sql string, name string, duration_ms double, explain_sql string"


def log(spark, *rows):
    return spark.createDataFrame([(i, s, n, 1.5, None) for i, s, n in rows], LOG).withColumns({"duration_ms": F.col("duration_ms").cast("decimal(18,2)"), "ts": F.current_timestamp()}).select(*columns("query_log"))


def test_plan_walk_is_depth_first(spark):
    plan = {"Node Type": "Limit", "Plan Rows": 3, "Plans": [{"Node Type": "Join", "Plans": [{"Node Type": "Hash", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "deep"}]}, {"Node Type": "Index Scan", "Index Name": "i", "Relation Name": "next"}]}, {"Node Type": "Seq Scan", "Relation Name": "last"}]}
    rows = [("a", json.dumps([{"Plan": plan}])), ("b", "[]"), ("c", "nope"), ("d", None), ("e", '[{"Plan": {"Node Type": "Result", "Startup Cost": 0, "Total Cost": 0.126}}]')]
    plans = spark.createDataFrame(rows, SCHEMAS["plans"])
    assert nodes(plans).count() == 7
    found = {r["statement"]: r for r in summaries(plans).collect()}
    assert set(found) == {"a", "e"} and found["a"]["plan_relation_name"] == "deep" and found["a"]["plan_rows"] == 3
    assert found["a"]["plan_summary"] == "postgresql plan: Limit over Seq Scan on deep rows=3" and found["e"]["plan_summary"] == "postgresql plan: Result cost=0.00..0.13"
    assert summaries(empty(spark, "plans")).count() == 0


def test_plans_reach_runtime_usages_only(spark):
    usages = runtime_usages(log(spark, (1, "SELECT 1 FROM t WHERE t.a = 1 ", None), (2, "SELECT 1 FROM t WHERE t.b = ?", None)))
    plans = spark.createDataFrame([("SELECT 1 FROM t WHERE t.a = 1", '[{"Plan": {"Node Type": "Seq Scan", "Relation Name": "t"}}]'), ("SELECT 1 FROM t WHERE t.b = ?", '[{"Plan": {"Node Type": "X"}}]')], SCHEMAS["plans"])
    found = {r["column_name"]: r["plan_relation_node_type"] for r in annotated(all_usages(usages.withColumn("origin", F.lit("source")), usages), plans).filter("origin = 'runtime'").collect()}
    assert found == {"a": "Seq Scan", "b": None}
    assert annotated(usages.withColumn("origin", F.lit("source")), plans).filter("plan_summary is not null").count() == 0
    names = canonicalised(usages, spark.createDataFrame([("s.t",)], "table_name string"), empty(spark, "search_path"), ("table_name", "plan_relation_name"))
    assert {(r["table_name"], r["plan_relation_name"]) for r in names.collect()} == {("s.t", "")}


def test_only_plans_of_used_statements_are_walked(spark, monkeypatch):
    """A log's plans are one for each different statement, its usages few: plan documents that no usage names are never looked at."""
    walked = []
    monkeypatch.setattr(explain, "summaries", lambda plans: walked.append(plans.count()) or summaries(plans))
    usages = runtime_usages(log(spark, (1, "SELECT 1 FROM t WHERE t.a = 7", None), (2, "SELECT 1 FROM t WHERE t.a = 8", None)))
    plans = spark.range(500).select(F.concat(F.lit(" SELECT 1 FROM t WHERE t.a = "), F.col("id").cast("string")).alias("statement"), F.lit('[{"Plan": {"Node Type": "Seq Scan", "Relation Name": "t"}}]').alias("plan_json"))
    assert [(r["count"], r["source"], r["plan_relation_node_type"]) for r in annotated(usages, plans).collect()] == [(2, "SELECT 1 FROM t WHERE t.a = 7", "Seq Scan")]
    assert walked == [1]


def test_log_is_counted_without_a_sort(spark):
    """Shapes of statements are added up by hash, in s17, st03, s13 and a07 as in a01: a task's memory doesn't grow with its statements."""
    plan = shapes(log(spark, (1, "SELECT 1 FROM t WHERE t.a = 7", None)))._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan and "ObjectHash" not in plan


def test_capture_equals_batch_and_goes_on(spark, tmp_path):
    first, second = log(spark, (1, "SELECT 1 FROM t WHERE t.a = 1", None), (2, "SELECT 1 FROM t WHERE t.a = 2", "SCHEMA")), log(spark, (3, "SELECT 1 FROM t WHERE t.a = 3 ORDER BY t.b", "x"))
    folder = str(tmp_path / "events")
    first.write.parquet(folder)
    session = Capture(event_stream(spark, folder), str(tmp_path / "session"))
    assert session.start() is session.start()
    session.run()
    session.stop()
    second.write.mode("append").parquet(folder)
    session.run()
    key = lambda r: (r["table_name"], r["column_name"], r["operation"], r["count"], r["source"])
    assert sorted(map(key, session.usages().collect())) == sorted(map(key, runtime_usages(first.union(second)).collect()))
    assert session.log().count() == 2
    session.write(str(tmp_path / "snapshot"))
    loaded = snapshot.load(spark, str(tmp_path / "snapshot"))
    assert {(r["column_name"], r["count"]) for r in loaded.collect()} == {("a", 2), ("b", 1)}
    assert spark.read.text(str(tmp_path / "snapshot/queries")).count() == 2
    made = json.loads(snapshot.document(session.log(), runtime_usages(session.log())))
    assert len(made["queries"]) == 2 and {u["column"] for u in made["query_usages"]} == {"a", "b"} and made["metadata"]["capture"] == {"literalized_binds": False}
    (tmp_path / "snapshot/query_usages/part-x.txt").write_text('{"i": 7, "v": {"table": 3}}\n')
    with pytest.raises(AuditError, match=r"query_usages\[7\].table must be a string"):
        snapshot.load(spark, str(tmp_path / "snapshot"))


def test_epochs_are_merged_and_replayed(spark, tmp_path, monkeypatch):
    """Counts stay those of the whole log while epochs are merged; an epoch that is replayed counts once."""
    monkeypatch.setattr(capture, "MERGE", 2)
    (tmp_path / "events").mkdir()
    whole = None
    session = Capture(event_stream(spark, str(tmp_path / "events")), str(tmp_path / "session"))
    assert session.usages().count() == 0 and session.log().count() == 0
    for i in range(5):
        batch = log(spark, (2 * i, f"SELECT 1 FROM t WHERE t.a = {i}", None), (2 * i + 1, f"SELECT 1 FROM t WHERE t.c{i} = 1", "x"))
        batch.write.mode("append").parquet(str(tmp_path / "events"))
        whole = batch if whole is None else whole.union(batch)
        session.run()
    session._save(batch, 4)
    names = [n.split("-")[0] for n in workspace.folders(spark, str(tmp_path / "session/counts"))]
    assert names == ["base=3", "base=4", "epoch=4"]  # what a merge covers stays until the next one
    key = lambda r: (r["column_name"], r["count"], r["source"], r["seq"])
    assert sorted(map(key, as_relation(session.usages()).collect())) == sorted(map(key, runtime_usages(whole).collect()))


def test_binds_become_explain_text(spark):
    events = spark.createDataFrame([("a = $1", [("1", True)]), ("b", [])], "sql string, binds array<struct<value:string,numeric:boolean>>")
    assert [r["explain_sql"] for r in with_binds(events).collect()] == ["a = 1", None]


def test_source_text(spark, tmp_path):
    (tmp_path / "app/models/deep").mkdir(parents=True)
    (tmp_path / "app/models/deep/a.rb").write_text("# User.where(id: 1)\nUser.active.where(name: 'x', other: 2).order(name: :desc)\n'User.where(id: 2)'\nAdmin::User.where(\"data @> ?\", 1)\nx = foo.where(id: 1)\n")
    (tmp_path / "app/models/b.txt").write_text("User.where(id: 1)")
    files = apptext.read_text(spark, str(tmp_path))
    assert files.count() == 1 and apptext.read_text(spark, str(tmp_path / "none")).count() == 0
    models = spark.createDataFrame([(1, "User", "users"), (2, "Admin::User", "admins")], "seq long, model string, table_name string")
    known = spark.createDataFrame([("users", "id"), ("users", "name"), ("admins", "data")], "table_name string, column_name string")
    found = apptext.source_usages(files, models, known).orderBy("seq").collect()
    assert [(r["line"], r["table_name"], r["column_name"], r["operation"], r["where_columns"]) for r in found] == [(2, "users", "name", "order", ["name"]), (2, "users", "name", "where", []), (4, "admins", "data", "jsonb_where", [])]
    assert apptext.source_usages(files.limit(0), models, known).count() == 0 and apptext.migration_changes(files.limit(0)).count() == 0


def test_catalog(spark):
    frames = {"a": spark.range(3), "b": spark.range(0)}
    assert {(r["table_name"], r["estimated_row_count"]) for r in catalog.frame_tables(frames, {"a": ["id"]}).collect()} == {("a", 3), ("b", 0)}
    assert catalog.frame_columns("a", frames["a"]).first()["sql_type"] == "bigint"
    reflection = "struct<name:string,macro:string,options:map<string,string>,foreign_key:string,foreign_type:string,target_table:string,klass_name:string,polymorphic:boolean,inverse_name:string,association_primary_key:string>"
    docs = spark.createDataFrame([(1, "A", "as", [("bs", "has_many", {}, "a_id", None, "bs", "B", False, None, None)], ["x"], {"state": "1"}, None), (2, "B", "bs", None, None, None, None)], f"seq long, model string, table_name string, reflections array<{reflection}>, default_scopes array<string>, enums map<string,string>, source_location string")
    models, reflections, enums = catalog.model_relations(docs)
    assert [r["default_scope_count"] for r in models.orderBy("seq").collect()] == [1, 0] and reflections.count() == 1 and enums.first()["column_name"] == "state"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    spark.createDataFrame([("logs", None, 1)], SCHEMAS["tables"]).write.parquet(str(tmp_path / "tables.parquet"))
    monkeypatch.chdir(tmp_path)
    assert main([str(tmp_path), "--format", "json", "--fail-on", "high"]) == 1
    made = json.loads(capsys.readouterr().out)
    assert [f["code"] for f in made["findings"]] == ["table_without_primary_key", "table_without_timestamps"]
    assert main([str(tmp_path), "--format", "xml"]) == 2 and main([str(tmp_path), "--runtime-report", str(tmp_path / "no.json")]) == 2
    (tmp_path / "tablewarden.yml").write_text("ignored_findings:\n  - code: table_without_primary_key\n")
    assert main([str(tmp_path), "--fail-on", "medium"]) == 0 and "table_without_timestamps" in capsys.readouterr().out


def test_entry_and_registration(spark):
    found, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(found) and entry.entry(spark).columns[:2] == ["code", "severity"] and entry.entry(spark).count() > 0
    own = [n for n in sys.modules if n.startswith("tablewarden") and ".llm" not in n]
    assert own and not any("llm" in open(sys.modules[n].__file__).read() for n in own if sys.modules[n].__file__)
