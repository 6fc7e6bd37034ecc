"""Statement parsing: fixed cases, and random statements against a small plain parser."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewarden.functions import sqltext
from tablewarden.functions.names import base_of, canonicalised, relative, schema_of, singular, without_path_aliases
from tablewarden.operators.usages import observed, runtime_usages, shapes
from tablewarden.schemas import SCHEMAS

CASES = {
    "SELECT * FROM payments WHERE metadata @> '{\"a\": 1}'": [("jsonb_where", "payments", "metadata", "")],
    "SELECT p.* FROM payments p WHERE p.status = 1 ORDER BY p.created_at": [("where", "payments", "status", ""), ("order", "payments", "created_at", "status")],
    "SELECT * FROM payments p INNER JOIN users u ON u.id = p.user_id WHERE u.status = 2": [("where", "users", "status", "")],
    "SELECT * FROM payments AS p WHERE p.metadata @> '{}'": [("jsonb_where", "payments", "metadata", "")],
    "SELECT * FROM analytics.payments WHERE payments.status = 1 AND analytics.payments.metadata ->> 'k' = 1": [("where", "analytics.payments", "status", ""), ("jsonb_where", "analytics.payments", "metadata", "")],
    "SELECT * FROM payments a, payments b WHERE a.status = 1": [("where", "payments", "status", "")],
    "SELECT * FROM payments a INNER JOIN payments b ON a.id = b.parent_id WHERE a.status = 1 ORDER BY b.created_at": [("where", "payments", "status", ""), ("order", "payments", "created_at", "")],
    "SELECT * FROM part JOIN supplier ON supplier.id = part.id WHERE supplier.name = 1": [],
    "SELECT EXTRACT(YEAR FROM ts) FROM events WHERE props ->> 'k' = '1'": [],
    "UPDATE \"t\" SET a = 1 WHERE \"t\".\"id\" = 3": [("where", "t", "id", "")],
    "SELECT * FROM t WHERE t.a = 1 AND t.a ->> 'x' = 1 AND t.b = 2": [("where", "t", "b", ""), ("jsonb_where", "t", "a", "")],
    "select * from t where t.b = 1 and t.a = 2\norder by t.c limit 1": [("where", "t", "b", ""), ("where", "t", "a", ""), ("order", "t", "c", "b,a")],
    "BEGIN": [], "": [],
}


def parsed(spark, statements):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(statements)], "seq long, sql string").select("seq", "sql", F.lit(1).cast("decimal(18,2)").alias("duration_ms"), F.lit(None).cast("string").alias("explain_sql"))
    found = {i: [] for i in range(len(statements))}
    for r in observed(rows).orderBy("seq", "pos").collect():
        found[r["seq"]].append((r["operation"], r["table_name"], r["column_name"], ",".join(r["where_columns"])))
    return [found[i] for i in range(len(statements))]


def test_fixed_statements(spark):
    assert dict(zip(CASES, parsed(spark, list(CASES)), strict=True)) == CASES


def plain(sql):
    """Loops and dictionaries instead of arrays of structs."""
    name = r'"?([a-zA-Z_][\w$]*)"?'
    table = re.compile(rf"\b(?:FROM|JOIN|UPDATE)\s+(?:{name}\.)?{name}(?:\s+(?:AS\s+)?{name})?", re.I | re.A)
    aliases = {}
    for s, t, a in table.findall(sql):
        full = f"{s}.{t}" if s else t
        aliases.setdefault(t, full)
        aliases.setdefault(full, full)
        if a and a.upper() not in sqltext.CLAUSES:
            aliases[a] = full
    if not aliases:
        return []
    where = re.search(r"\bWHERE\b(.+?)(?:\bGROUP\b|\bORDER\b|\bLIMIT\b|\bOFFSET\b|\bFOR\b|\Z)", sql, re.I | re.S | re.A)
    order = re.search(r"\bORDER\s+BY\b(.+?)(?:\bLIMIT\b|\bOFFSET\b|\bFOR\b|\Z)", sql, re.I | re.S | re.A)

    def refs(text, tail=""):
        out = []
        for s, q, c in re.findall(rf"(?:{name}\.)?{name}\.{name}{tail}", text or "", re.A):
            key = f"{s}.{q}" if s else q
            target = aliases.get(key, aliases.get(q))
            if target and (key, target, c) not in out:
                out.append((key, target, c))
        return out

    w, o = where and where[1], order and order[1]
    json = [(t, c) for tail in (r"\s*(?:->>|->)\s*'(?:[^']+)'", r"\s*@>") for _, t, c in refs(w, tail)]
    if len(set(aliases.values())) == 1:
        json += [(next(iter(aliases.values())), c) for tail in (r"\s*(?:->>|->)\s*'(?:[^']+)'", r"\s*@>") for c in re.findall(name + tail, w or "", re.A)]
    json = list(dict.fromkeys(json))
    out = [("where", t, c, "") for t, c in dict.fromkeys((t, c) for _, t, c in refs(w)) if (t, c) not in json]
    out += [("jsonb_where", t, c, "") for t, c in json]
    context = {}
    for key, _, c in refs(w):
        context.setdefault(key, []).append(c) if c not in context.get(key, []) else None
    return out + [("order", t, c, ",".join(context.get(key, []))) for key, t, c in refs(o)]


def test_random_statements(spark):
    rng = random.Random(9)
    words = ["SELECT", "FROM", "JOIN", "UPDATE", "WHERE", "ORDER BY", "LIMIT", "AS", "AND", "LEFT", "a", "b", "t", "s.t", '"t"', "a.x", "b.y", "t.x", "s.t.z", '"t"."y"', "x -> 'k'", "t.x ->> 'k'", "a.z @> '{}'", "y @>", "= 1", ",", "\n", "group", "For"]
    statements = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 22))) for _ in range(1500)] + ["FROM a b JOIN b WHERE x @> 1", "FROM t WHERE t.x = 1 ORDER BY t.y"]
    found = parsed(spark, statements)
    for sql, got in zip(statements, found, strict=True):
        assert got == plain(sql), sql


def test_literals_change_no_usage(spark):
    """A statement and its shape have the same usages, also where quotes pair oddly or a literal holds clauses and names."""
    rng = random.Random(10)
    words = ["FROM", "JOIN", "WHERE", "ORDER BY", "LIMIT", "t", "a t", "s.t b", '"t"', "a.x", "b.y", "t.x", "t.c1", "t1.x", "$1", "a$1.x", "7", "7, 8,9", "1.5", "12x", "x ->>", "t.x ->", "'k'", "'5'", "'it''s'", "'a.x'", "'b.y", "' FROM t '", "'no where'", "''", "'", "@>", "'> x'", "IN (1, 2)", '\'"a"\'', "-3"]
    statements = [rng.choice([" ", " ", ""]).join(rng.choice(words) for _ in range(rng.randrange(2, 24))) for _ in range(1500)] + ["SELECT 1 FROM t WHERE t.x IN (" + ", ".join(map(str, range(20000))) + ")", "SELECT 1 FROM t WHERE t.x = '" + "y " * 20000 + "'"]
    rows = spark.createDataFrame([(s,) for s in statements], "sql string").withColumn("shape", sqltext.shape(F.col("sql")))
    same = rows.select("sql", "shape", sqltext.statement_usages(F.col("sql")).alias("a"), sqltext.statement_usages(F.col("shape")).alias("b")).collect()
    assert [(r["sql"], r["a"]) for r in same] == [(r["sql"], r["b"]) for r in same] and sum(bool(r["a"]) for r in same) > 100
    assert spark.createDataFrame([("SELECT 1 FROM t WHERE t.a = 12 AND t.b = 'c d' AND t.c IN (1,2, 3)",)], "s string").select(sqltext.shape(F.col("s"))).first()[0] == "SELECT 0 FROM t WHERE t.a = 0 AND t.b = 'x' AND t.c IN (0)"


def test_logs_are_counted_without_a_sort(spark):
    """Sums of fixed width are added up by hash; first texts kept in the sums would sort all statements of a task."""
    log = spark.createDataFrame([], SCHEMAS["query_log"])
    plan = shapes(log)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_counts_add_up_and_keep_the_first_statement(spark):
    log = spark.createDataFrame([(2, "SELECT 1 FROM t WHERE t.a = 2", None, 1.25, None), (1, "SELECT 1 FROM t WHERE t.a = 1", "Load", 2.5, None), (3, "SELECT 1 FROM t WHERE t.a = 3", "SCHEMA", 9.0, None), (4, "SELECT 1 FROM t WHERE t.a = 4", "x", 1.0, "planned")], "seq long, sql string, name string, duration_ms double, explain_sql string")
    row = runtime_usages(log.withColumn("duration_ms", F.col("duration_ms").cast("decimal(18,2)"))).collect()
    assert len(row) == 1 and row[0]["count"] == 3 and row[0]["total_duration_ms"] == 4.75 and row[0]["source"].endswith("= 1") and row[0]["explain_source"] == "planned"
    assert runtime_usages(spark.createDataFrame([], SCHEMAS["query_log"])).count() == 0


@pytest.mark.parametrize(
    ("sql", "binds", "expected"),
    [
        ("a = $1 AND b = $2", [("1", True), ("paid", False)], "a = 1 AND b = 'paid'"), ("a = $1 OR b = $11", [("x'y", False)] + [(str(i), True) for i in range(10)], "a = 'x''y' OR b = 9"),
        ("a = ? AND b = ?", [("1", True)], "a = 1 AND b = NULL"), ("a = ?", [(None, False)], "a = NULL"), ("a = 1", [("1", True)], "a = 1"), ("a = $1", [], "a = $1"), (None, [("1", True)], None), ("$2", [("5", True), ("$1", False)], "'5'"),
    ],
)
def test_binds(spark, sql, binds, expected):
    df = spark.createDataFrame([(sql, binds)], "sql string, binds array<struct<value:string,numeric:boolean>>")
    assert df.select(sqltext.literalised(F.col("sql"), F.col("binds"))).first()[0] == expected


def test_explainable(spark):
    cases = {"SELECT 1": True, " with x as (select 1) select 1": True, "UPDATE t": False, "SELECT $1": False, "SELECT a ? b": False, "": False, None: False, "SELECTED": False}
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select(sqltext.explainable(F.col("s"))).collect()
    assert [r[0] for r in rows] == list(cases.values())


def test_names(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    assert (one(schema_of(F.lit("a.b.c"))), one(base_of(F.lit("a.b.c"))), one(schema_of(F.lit("b"))), one(base_of(F.lit("b")))) == ("a", "b.c", None, "b")
    assert [one(singular(F.lit(w))) for w in ("users", "categories", "boxes", "statuses", "status", "class", "branches")] == ["user", "category", "box", "status", "status", "class", "branch"]
    assert one(relative(F.lit("/r/app/a.rb"), "/r/")) == "app/a.rb" and one(relative(F.lit("/x/a.rb"), "/r")) == "/x/a.rb"
    known = spark.createDataFrame([(n,) for n in ("a.t", "b.t", "c.u", "x.v", "y.v")], "table_name string")
    path = spark.createDataFrame([(0, "b"), (1, "a")], "rank int, schema_name string")
    rows = spark.createDataFrame([("t",), ("u",), ("v",), ("a.t",), (None,), ("w",)], "table_name string")
    assert sorted(r[0] for r in canonicalised(rows, known, path).collect()) == sorted(["b.t", "c.u", "v", "a.t", "", "w"])
    names = spark.createDataFrame([("t",), ("u",), ("a.t",)], "table_name string")
    assert {r[0] for r in without_path_aliases(names, known, path).collect()} == {"u", "a.t"}
