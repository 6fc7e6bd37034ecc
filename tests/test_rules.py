"""Rules on small evidence, positive and negative, and the report made of them."""

import json

import pytest
from pyspark.sql import functions as F

from tablewarden import rules
from tablewarden.audit import audit
from tablewarden.config import AuditError, Config, resolve
from tablewarden.evidence import Evidence
from tablewarden.report import Report, suppressed
from tablewarden.schemas import SCHEMAS, columns, empty
from tablewarden.sources import snapshot


def frame(spark, name, *rows):
    names = columns(name)
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], SCHEMAS[name])


def usage(seq=1, column="status", operation="where", count=5, origin="runtime", **more):
    return {"seq": seq, "table_name": "payments", "column_name": column, "operation": operation, "source": f"SELECT {column}", "origin": origin, "count": count, "total_duration_ms": 1.0, "where_columns": []} | more


def codes(spark, which, config=Config(), **relations):
    known = {name: frame(spark, name, *rows) for name, rows in relations.items()}
    return rules.findings(Evidence.of(spark, **known), config, (which,)).collect()


TABLE = {"tables": [{"table_name": "payments", "primary_key": ["id"], "estimated_row_count": 50_000}]}
COLUMNS = {"columns": [{"table_name": "payments", "column_name": c} for c in ("id", "user_id", "status", "created_at", "subject_id", "subject_type")]}


def index(*names, method="btree"):
    return {"indexes": [{"table_name": "payments", "columns": list(names), "method": method}]}


def belongs(**more):
    return {"reflections": [{"seq": 1, "model": "Payment", "table_name": "payments", "name": "user", "macro": "belongs_to", "options": {}, "foreign_key": "user_id", "target_table": "users", "polymorphic": False} | more]}


def test_association_indexes(spark):
    found = codes(spark, "missing_belongs_to_index", **TABLE, **COLUMNS, **belongs())
    assert [(r["severity"], r["model"], r["column_name"]) for r in found] == [("high", "Payment", "user_id")]
    assert not codes(spark, "missing_belongs_to_index", **TABLE, **COLUMNS, **belongs(), **index("user_id", "status"))
    assert codes(spark, "missing_belongs_to_index", **TABLE, **COLUMNS, **belongs(), **index("status", "user_id"))
    assert not codes(spark, "missing_belongs_to_index", **TABLE, **COLUMNS, **belongs(foreign_key="gone"))
    assert not codes(spark, "missing_belongs_to_index", **COLUMNS, **belongs())
    assert codes(spark, "missing_belongs_to_index", **TABLE, **COLUMNS, **belongs(foreign_key="id"))


@pytest.mark.parametrize(("key", "missing"), [("id", False), ("uuid", True), (None, True)])
def test_foreign_keys(spark, key, missing):
    keys = {"foreign_keys": [{"table_name": "payments", "to_table": "users", "columns": ["user_id"], "primary_key": key}]}
    assert bool(codes(spark, "missing_foreign_key_constraint", **TABLE, **COLUMNS, **belongs(), **keys)) == missing


def test_advice_names_what_differs(spark):
    advice = lambda **more: codes(spark, "missing_foreign_key_constraint", **TABLE, **COLUMNS, **belongs(**more))[0]["recommendation"]
    assert advice() == "add_foreign_key :payments, :users"
    assert advice(foreign_key="status", association_primary_key="uuid") == "add_foreign_key :payments, :users, column: :status, primary_key: :uuid"


@pytest.mark.parametrize(("columns_", "missing"), [(("subject_type", "subject_id"), False), (("subject_id", "subject_type"), False), (("subject_id",), True)])
def test_polymorphic(spark, columns_, missing):
    reflection = belongs(polymorphic=True, foreign_key="subject_id", foreign_type="subject_type")
    assert bool(codes(spark, "missing_polymorphic_composite_index", **TABLE, **COLUMNS, **reflection, **index(*columns_))) == missing
    assert not codes(spark, "missing_belongs_to_index", **TABLE, **COLUMNS, **reflection)


def test_destroy_scope_and_inverse(spark):
    many = lambda **more: {"reflections": [{"seq": 1, "model": "User", "table_name": "users", "name": "payments", "macro": "has_many", "options": {"dependent": "destroy"}, "target_table": "payments"} | more]}
    found = codes(spark, "broad_dependent_destroy", **TABLE, **many())
    assert json.loads(found[0]["details"]) == {"estimated_row_count": 50_000, "row_threshold": 10_000, "evidence_source": "estimate"}
    assert not codes(spark, "broad_dependent_destroy", Config(dependent_destroy_row_threshold=50_001), **TABLE, **many())
    assert codes(spark, "missing_inverse_of", **many()) and not codes(spark, "missing_inverse_of", **many(inverse_name="user"))
    assert not codes(spark, "missing_inverse_of", **many(options={"dependent": "destroy", "inverse_of": "x"})) and not codes(spark, "missing_inverse_of", **many(options={"a": "b"}))
    assert codes(spark, "missing_inverse_of", **many(options={"autosave": "true"}))
    models = {"models": [{"seq": 1, "model": "A", "table_name": "schema_migrations", "default_scope_count": 1}, {"seq": 2, "model": "B", "table_name": "b", "default_scope_count": 0}]}
    assert [r["model"] for r in codes(spark, "default_scope", **models)] == ["A"]


def test_schema_rules(spark):
    keys = {"foreign_keys": [{"table_name": "payments", "to_table": "users", "columns": ["user_id", "status"]}]}
    assert codes(spark, "foreign_key_without_index", **TABLE, **keys, **index("user_id"))[0]["column_name"] == "user_id, status"
    assert not codes(spark, "foreign_key_without_index", **TABLE, **keys, **index("user_id", "status", "id"))
    bare = {"tables": [{"table_name": "logs"}, {"table_name": "schema_migrations"}]}
    assert [r["table_name"] for r in codes(spark, "table_without_primary_key", **bare)] == ["logs"]
    assert len(codes(spark, "table_without_primary_key", Config(ignored_tables=()), **bare)) == 2
    assert codes(spark, "table_without_timestamps", **TABLE, **COLUMNS)
    assert not codes(spark, "table_without_timestamps", **TABLE, columns=[{"table_name": "payments", "column_name": c} for c in ("created_at", "updated_at")])


def test_recurring_filters(spark):
    where = "recurring_where_without_index"
    assert codes(spark, where, **TABLE, usages=[usage()])[0]["severity"] == "medium"
    assert codes(spark, where, **TABLE, usages=[usage(count=1), usage(2, count=1, origin="source", path="a.rb", line=3)])[0]["evidence"].endswith("\na.rb:3 SELECT status")
    for less in (dict(usages=[usage(count=1)]), dict(usages=[usage()], **index("status", "id")), dict(usages=[usage(column="id")]), dict(usages=[usage()], enums=[{"model": "P", "table_name": "payments", "column_name": "status"}])):
        assert not codes(spark, where, **TABLE, **less)
    plan = dict(plan_summary="p", plan_root_node_type="Limit", plan_relation_node_type="Seq Scan", plan_relation_name="payments")
    high = codes(spark, where, **TABLE, usages=[usage(plan_rows=10_000, **plan)])[0]
    assert high["severity"] == "high" and json.loads(high["details"])["plan_rows"] == 10_000
    low = codes(spark, where, **TABLE, usages=[usage(plan_rows=None, **plan)])[0]
    assert low["severity"] == "medium" and json.loads(low["details"])["planner_confirmed"] and json.loads(low["details"])["plan_rows"] is None
    many = codes(spark, where, **TABLE, usages=[usage(i, source=f"q{i}") for i in (9, 4, 7, 5, 6)])[0]
    assert [x.rsplit(": ", 1)[1] for x in many["evidence"].split("\n")] == ["q4", "q5", "q6"]


def test_enum_filters_have_no_threshold(spark):
    enums = [{"model": m, "table_name": "payments", "column_name": "status"} for m in ("A", "B")]
    assert sorted(r["model"] for r in codes(spark, "enum_where_without_index", **TABLE, usages=[usage(count=1)], enums=enums)) == ["A", "B"]
    assert not codes(spark, "enum_where_without_index", **TABLE, usages=[usage(count=1)], enums=enums, **index("status"))


@pytest.mark.parametrize(
    ("source", "columns_", "method", "found"),
    [
        ("m @> 1", ["m"], "GIN", False), ("m @> 1", ["m"], "btree", True), ("m ->> 'k'", ["m"], "gin", True), ("m ->> 'k'", ["((m ->> 'k'::text))"], "btree", False), ("m ->> 'j'", ["(m ->> 'k'::text)"], "btree", True),
        ('"m" ->> \'k\'', ["(m ->> 'k'::text)"], "btree", True), ("m -> 'k'", ["(m ->> 'k')"], None, True),
    ],
)
def test_json_predicates(spark, source, columns_, method, found):
    rows = [usage(column="m", operation="jsonb_where", source=source)]
    assert bool(codes(spark, "jsonb_query_without_index", **TABLE, usages=rows, **index(*columns_, method=method))) == found


def test_sort_orders(spark):
    order = "order_without_index"
    one = lambda filters, **more: [usage(column="created_at", operation="order", where_columns=filters, **more)]
    assert not codes(spark, order, **TABLE, usages=one(["status"]), **index("status", "created_at"))
    assert not codes(spark, order, **TABLE, usages=one(["b", "a"]), **index("a", "b", "created_at"))
    assert codes(spark, order, **TABLE, usages=one([]), **index("status", "created_at")) and codes(spark, order, **TABLE, usages=one(None), **index("status", "created_at"))
    assert not codes(spark, order, **TABLE, usages=one([]), **index("created_at"))
    mixed = one(["status"], seq=1, source="fine", plan_root_node_type="Sort", plan_rows=99_999, plan_summary="x") + one([], seq=2, source="slow")
    row = codes(spark, order, **TABLE, usages=mixed, **index("status", "created_at"))[0]
    assert row["severity"] == "medium" and "fine" not in row["evidence"] and row["details"] is None
    assert codes(spark, order, **TABLE, usages=one([], plan_root_node_type="Sort", plan_rows=10_000))[0]["severity"] == "high"


def test_migrations(spark):
    change = lambda **more: {"migrations": [{"seq": 1, "table_name": "payments", "column_name": "user_id", "path": "m.rb", "line": 2, "source": "x"} | more]}
    code = "migration_reference_without_foreign_key"
    assert codes(spark, code, **TABLE, **COLUMNS, **change())
    assert not codes(spark, code, **TABLE, **COLUMNS, **change(column_name="gone")) and not codes(spark, code, **COLUMNS, **change())
    assert not codes(spark, code, **TABLE, **COLUMNS, **change(), foreign_keys=[{"table_name": "payments", "to_table": "other", "columns": ["user_id"]}])


def findings(spark):
    return frame(spark, "findings", *[{"severity": s, "code": c, "title": "t", "table_name": t, "problem": "a\nb", "evidence": "e", "details": d} for s, c, t, d in (("low", "z", "b", None), ("high", "y", "c", '{"a": 1}'), ("high", "y", None, None), ("high", "x", "d", None))])


def test_report(spark):
    report = Report(findings(spark))
    made = report.as_json()
    assert [(f["code"], f["table"]) for f in made["findings"]] == [("x", "d"), ("y", None), ("y", "c"), ("z", "b")] and made["counts"] == {"high": 3, "low": 1}
    assert made["findings"][2]["details"] == {"a": 1} and made["metadata"]["schema_version"] == 1
    assert "problem: a\n  b" in report.render("text") and json.loads(report.render("JSON")) == made
    assert (report.exit_status(), report.exit_status("low"), Report(findings(spark).filter("severity = 'low'")).exit_status("medium")) == (0, 1, 0)
    assert Report(empty(spark, "findings")).render() == "No findings."
    with pytest.raises(AuditError):
        report.exit_status("fatal")
    with pytest.raises(AuditError):
        report.render("xml")
    assert suppressed(findings(spark), ({"code": "y", "table": ""}, {"severity": "low"})).count() == 2
    assert suppressed(findings(spark), ()).count() == 4


def test_config(tmp_path):
    assert resolve({"where_occurrence_threshold": "3", "explain_runtime_queries": "yes", "ignored_tables": "a"}) == Config(where_occurrence_threshold=3, explain_runtime_queries=True, ignored_tables=("a",))
    for bad in ({"nope": 1}, {"where_occurrence_threshold": 0}, {"where_occurrence_threshold": "x"}, {"explain_runtime_queries": "maybe"}, {"ignored_findings": {}}, {"ignored_findings": [{}]}, {"ignored_findings": [{"x": "y"}]}, {"ignored_findings": [{"code": 1}]}, {"ignored_tables": [1]}, {"output_format": "xml"}, {"runtime_query_report_path": 3}):
        with pytest.raises(AuditError):
            resolve(bad)
    (tmp_path / "tablewarden.yml").write_text("planner_row_threshold: 5\noutput_format: json\n")
    assert resolve({"output_format": "text"}, root=str(tmp_path)) == Config(planner_row_threshold=5)
    for text in ("- a\n", "a: [\n", "a: &x 1\nb: *x\n"):
        (tmp_path / "bad.yml").write_text(text)
        with pytest.raises(AuditError):
            resolve(None, "bad.yml", str(tmp_path))
    with pytest.raises(AuditError):
        resolve(None, "missing.yml", str(tmp_path))


def test_audit_with_a_snapshot_and_plans(spark, tmp_path):
    sql = "SELECT * FROM payments WHERE payments.status = 1"
    runtime = frame(spark, "usages", usage(source=sql, explain_source=sql))
    path = str(tmp_path / "snapshot.json")
    snapshot.write(frame(spark, "query_log", {"seq": 1, "sql": sql}).withColumn("duration_ms", F.lit(1.0)), runtime, path)
    loaded = snapshot.load(spark, path)
    assert loaded.first()["source"] == sql
    plans = frame(spark, "plans", {"statement": sql, "plan_json": '[{"Plan": {"Node Type": "Seq Scan", "Relation Name": "payments", "Plan Rows": 20000}}]'})
    evidence = Evidence.of(spark, tables=frame(spark, "tables", *TABLE["tables"]), columns=frame(spark, "columns", *COLUMNS["columns"]), search_path=frame(spark, "search_path"))
    report = audit(evidence, {"explain_runtime_queries": True, "ignored_findings": [{"code": "table_without_timestamps"}]}, runtime=loaded, plans=plans, root=str(tmp_path)).as_json()
    assert [(f["code"], f["severity"], f["details"]["planner_confirmed"]) for f in report["findings"]] == [("recurring_where_without_index", "high", True)]
    with pytest.raises(AuditError):
        audit(evidence, {"explain_runtime_queries": True}, root=str(tmp_path))
    with pytest.raises(AuditError):
        audit(evidence, {"explain_runtime_queries": True}, runtime=loaded.withColumns({"source": F.lit("x ?"), "explain_source": F.lit(None).cast("string")}), root=str(tmp_path))


def test_snapshot_errors(spark, tmp_path):
    with pytest.raises(AuditError, match="no query snapshot"):
        snapshot.load(spark, str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(AuditError, match="isn't JSON"):
        snapshot.load(spark, str(tmp_path / "bad.json"))
    (tmp_path / "list.json").write_text("[]")
    with pytest.raises(AuditError, match="query_usages"):
        snapshot.load(spark, str(tmp_path / "list.json"))
