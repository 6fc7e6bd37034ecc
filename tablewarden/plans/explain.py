"""Plan documents (JSON) as relations: nodes, first relation node, summary, annotation.

A plan is a tree.  Its nodes are gathered inside its row, level by level, by one
fold over a VARIANT: each document is parsed once, no step is a job of its own,
and nothing is shuffled or written.  Each node has the path of child numbers that
leads to it, so that the order of paths is the order of a depth-first walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = {"node_type": ("Node Type", "string"), "relation_name": ("Relation Name", "string"), "index_name": ("Index Name", "string"), "plan_rows": ("Plan Rows", "bigint"), "startup_cost": ("Startup Cost", "double"), "total_cost": ("Total Cost", "double")}


def _field(node: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(node, f"$['{key}']", kind)


def _walked(plans: DataFrame) -> DataFrame:
    """(statement, nodes): the nodes of each plan, level by level; documents that aren't plans are left out.

    No plan has more levels below its root than its text has the word Plans; once
    a plan has no further level, the steps that are left do nothing.
    """
    root = F.try_variant_get(F.try_parse_json("plan_json"), "$[0].Plan", "variant")
    level = F.array(F.struct(F.array().cast("array<int>").alias("path"), F.col("root").alias("node")))
    steps = F.sequence(F.lit(0), F.regexp_count("plan_json", F.lit('"Plans"')))
    children = lambda at: F.transform(
        F.coalesce(F.try_variant_get(at["node"], "$.Plans", "array<variant>"), F.array().cast("array<variant>")),
        lambda node, i: F.struct(F.concat(at["path"], F.array(i)).alias("path"), node.alias("node")),
    )
    below = lambda found: F.filter(F.flatten(F.transform(found, children)), lambda x: x["node"].isNotNull())
    step = lambda done, _: F.when(F.size(done["last"]) == 0, done).otherwise(F.struct(F.concat(done["all"], done["last"]).alias("all"), below(done["last"]).alias("last")))
    every = F.aggregate(steps, F.struct(F.slice(level, F.lit(1), F.lit(0)).alias("all"), level.alias("last")), step, lambda done: done["all"])
    fields = lambda at: F.struct(at["path"].alias("path"), *[_field(at["node"], key, kind).alias(name) for name, (key, kind) in NODE.items()])
    return plans.select("statement", "plan_json", root.alias("root")).filter("root is not null").select("statement", F.transform(every, fields).alias("nodes"))


def nodes(plans: DataFrame) -> DataFrame:
    """(statement, path, node_type, ...) of (statement, plan_json); documents that aren't plans give none."""
    return _walked(plans).select("statement", F.inline("nodes"))


def label(prefix: str = "") -> Column:
    """Node type, index and relation of a node, as one line."""
    col = lambda name: F.col(prefix + name)
    return F.concat_ws(" ", col("node_type"), F.concat(F.lit("using "), col("index_name")), F.concat(F.lit("on "), col("relation_name")))


def cost(startup: Column, total: Column) -> Column:
    return F.when(startup.isNotNull() & total.isNotNull(), F.format_string("%.2f..%.2f", startup, total))


def summaries(plans: DataFrame) -> DataFrame:
    """(statement, plan_summary, plan_root_node_type, plan_relation_node_type, plan_relation_name, plan_rows).

    Rows and cost are the root's; the relation is that of the first node in
    depth-first order that has one.
    """
    known = F.transform(F.filter("nodes", lambda x: x["relation_name"].isNotNull()), lambda x: F.struct(x["path"].alias("path"), *[x[c].alias(c) for c in ("node_type", "relation_name", "index_name")]))
    both = _walked(plans.dropDuplicates(["statement"])).select("statement", F.get("nodes", F.lit(0)).alias("root"), F.array_min(known).alias("r")).select("statement", "root.*", "r")
    below = F.when(F.size("r.path") > 0, F.concat(F.lit("over "), label("r.")))
    text = F.concat_ws(" ", label(), below, F.concat(F.lit("rows="), F.col("plan_rows").cast("string")), F.concat(F.lit("cost="), cost(F.col("startup_cost"), F.col("total_cost"))))
    return both.select(
        "statement", F.concat(F.lit("postgresql plan: "), text).alias("plan_summary"), F.col("node_type").alias("plan_root_node_type"),
        F.col("r.node_type").alias("plan_relation_node_type"), F.col("r.relation_name").alias("plan_relation_name"), "plan_rows",
    )


def annotated(usages: DataFrame, plans: DataFrame) -> DataFrame:
    """Runtime usages with the summary of their statement's plan; others and those without a plan stay as they are.

    Plans of statements that no usage names go first, so that only the others are told apart and walked.
    """
    from ..functions.sqltext import explainable

    statement = F.trim(F.coalesce("explain_source", "source"))
    names = ["plan_summary", "plan_root_node_type", "plan_relation_node_type", "plan_relation_name", "plan_rows"]
    wanted = usages.filter(explainable(statement) & (F.col("origin") == "runtime")).select(statement.alias("__wanted"))
    asked = plans.withColumn("statement", F.trim("statement")).join(wanted, F.col("statement") == F.col("__wanted"), "left_semi")
    side = summaries(asked).select(F.col("statement").alias("__statement"), *[F.col(c).alias(f"__{c}") for c in names])
    joined = usages.join(side, (statement == F.col("__statement")) & explainable(statement) & (F.col("origin") == "runtime"), "left")
    found = F.col("__statement").isNotNull()
    return joined.withColumns({c: F.when(found, F.col(f"__{c}")).otherwise(F.col(c)) for c in names}).drop("__statement", *[f"__{c}" for c in names])
