"""Query usages in application source, through variables, named scopes and helpers.

Everything is a relation over the token rows of `tokens`:

* chains: a receiver and the calls on it, `Order.where(..).order(..)`; a call has
  the keywords, symbols and strings that stand directly among its arguments,
* assignments of local variables with the scope that they stand in, met by each
  later use as of its place: the innermost enclosing scope that assigns the name,
  and there the last assignment before the use,
* definitions: named scopes and class methods in models' files, each with the chain
  that is its last statement; of several the last one counts, and a file knows
  those in files up to its own path,
* what a chain has filtered before a call: its own `where` calls, and for each
  variable or helper the filters of the chain behind it, found by a fixpoint that
  joins only what the round before has added.  A helper that comes back to itself
  adds nothing there.

A call's receiver decides its table: a model's constant, a variable that holds a
chain of one, or in a model's file no receiver at all.  Unknown methods pass it on;
`||`, `&&`, `?` and ranges give no relation.

Windows are over the rows of one file; joins are on paths and places.  The parts of
all shuffles are counted by the length of the text (`tokens.PART_CHARS`), so that a
task's memory is the same at any size.  Rounds of the fixpoint are as many as helpers call each other in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sqltext import order_words
from ..schemas import columns
from ..workspace import in_parts, ranked, saved
from .apptext import JSON_MARK
from .tokens import again, lexed, nested, parts_of

RECORDED = ("where", "order", "reorder")
#: Keywords that end or change a statement where they open no block.
ENDINGS = ("if", "unless", "while", "until", "do", "then", "and", "or", "rescue", "ensure", "else", "elsif", "when", "in")


def _siblings(upto: bool = False):
    """The tokens that one bracket or block holds directly, in order; `upto`: as a frame up to each token."""
    order = Window.partitionBy("path", "parent").orderBy("i")
    return order.rowsBetween(Window.unboundedPreceding, 0) if upto else order


def _in(c: Column | str, *values: str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).isin(*values), F.lit(False))


def linked(files: DataFrame, parts: int | None = None) -> DataFrame:
    """Token rows with neighbours among their siblings (p, n), the chain (its first token), what it has gone through so far (goes), its last call (part), the statement, and the call whose direct argument they are."""
    rows = nested(lexed(files, parts))
    near = {name: f(c).over(_siblings()) for f, sign in ((F.lag, "p"), (F.lead, "n")) for name, c in ((sign, "text"), (f"{sign}kind", "kind"), (f"{sign}i", "i"))}
    rows = rows.withColumns(near | {"ngap": F.lead("gap").over(_siblings())})
    t, value = F.col("text"), _in("pkind", "name", "constant") | _in("p", ")", "]", "}", "end")
    goes_on = _in(t, ".", "&.", "::") | _in("p", ".", "&.", "::", "->") | F.col("closes") | (_in(t, "(", "[") & ~F.col("gap") & value) | (F.col("block") & value)
    rows = rows.withColumn("chain", F.last(F.when(~goes_on, F.col("i")), True).over(_siblings(True)))
    breaks = (F.col("kind") == "newline") | (t == ";")
    ends = breaks | ((F.col("kind") == "keyword") & _in(t, *ENDINGS) & ~F.col("opens"))
    called = (F.col("kind") == "name") & (_in("p", ".", "&.") | (F.col("chain") == F.col("i"))) & ~_in("n", "=", "+=", "-=", "||=", "&&=")
    rows = rows.withColumns({"line_no": F.sum(breaks.cast("int")).over(_siblings(True)), "stmt": F.sum(ends.cast("int")).over(_siblings(True)), "called": called})
    begins = _in("nkind", "label", "symbol", "string", "constant", "name", "number", "variable", "words", "heredoc_start") | _in("n", "->", "[", ":")
    rows = rows.withColumn("command", called & F.coalesce(F.col("ngap"), F.lit(False)) & begins)
    last = F.last(F.when(F.col("command"), F.struct("stmt", "i")), True).over(_siblings().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"last": last, "asks": (t == "(") & ~F.col("gap") & F.coalesce(F.lag("called").over(_siblings()), F.lit(False))})
    rows = again(rows.withColumn("commanded", F.when(F.col("last.stmt") == F.col("stmt"), F.col("last.i"))).drop("last", "command"), F.col("asks"))
    rows = rows.withColumn("inside", F.when(F.col("mark"), F.col("i")).otherwise(F.col("parent")))
    caller = F.max(F.when(F.col("mark"), F.col("pi"))).over(Window.partitionBy("path", "inside"))
    rows = rows.withColumn("argument_of", F.coalesce("commanded", caller)).filter("not mark").drop("mark", "inside", "asks", "commanded")
    upto = Window.partitionBy("path", "chain").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"goes": F.sum(_in("text", ".", "&.", "(", "[").cast("int")).over(upto), "part": F.last(F.when(F.col("called"), F.col("i")), True).over(upto)})


def _arguments(rows: DataFrame) -> DataFrame:
    """(path, i, keywords, symbols, strings, first_name) of each call, in order of their places."""
    t, kind = F.col("text"), F.col("kind")
    first = F.col("p").isNull() | (F.col("p") == ",") | (F.col("pi") == F.col("argument_of"))
    last = F.col("n").isNull() | _in("n", ",", ";") | _in("nkind", "newline") | (_in("nkind", "keyword") & _in("n", *ENDINGS))
    plain = F.when(kind == "symbol", F.regexp_replace(t, r"\A:\"?|\"\z", "")).when(kind == "string", F.regexp_replace(t, r"(?s)\A(?:%[qQ]?)?.(.*).\z", "$1")).when(kind == "heredoc_start", F.col("said"))
    fixed = kind.isin("symbol", "string", "heredoc_start") & ~(t.startswith('"') & F.contains(t, F.lit("#{"))) & ~t.startswith("`")
    key = F.when(kind == "label", F.regexp_replace(t, ":$", "")).when(fixed & first & _in("n", "=>"), plain)
    args = rows.filter("argument_of is not null").withColumns({"key": key, "own": F.when(fixed & first & last, plain)})
    listed = lambda c, when: F.transform(F.array_sort(F.collect_list(F.when(when & F.col(c).isNotNull(), F.struct("i", F.col(c).alias("x"))))), lambda r: r["x"])
    return args.groupBy("path", F.col("argument_of").alias("call")).agg(
        listed("key", F.lit(True)).alias("keywords"), listed("own", kind == "symbol").alias("symbols"), listed("own", kind != "symbol").alias("strings"),
        F.min_by(F.col("own"), F.col("i")).alias("first_name"), F.max(F.col("pos") + F.length("text")).alias("args_end"),
    ).withColumnRenamed("call", "i")


def _bodies(rows: DataFrame) -> DataFrame:
    """(path, opener, body): the chain that is the whole last statement of a block or definition."""
    bars = F.sum((F.col("text") == "|").cast("int")).over(_siblings(True))
    listed = (F.first("text").over(_siblings(True)) == "|") & ((bars < 2) | ((bars == 2) & (F.col("text") == "|")))
    inside = rows.withColumn("listed", listed).filter(~F.col("listed") & (F.col("kind") != "newline") & (F.col("text") != ";"))
    inside = inside.withColumn("last_line", F.max("line_no").over(Window.partitionBy("path", "parent")))
    changed = (F.col("kind") == "keyword") & _in("text", *ENDINGS)
    rescued = F.max(changed & _in("text", "rescue", "ensure")).over(Window.partitionBy("path", "parent"))
    final = inside.withColumn("rescued", rescued).filter("line_no = last_line")
    odd = changed | _in("text", "||", "&&", "?", "..", "...", "=") | F.col("rescued")
    found = final.groupBy("path", F.col("parent").alias("opener")).agg(F.min("i").alias("body"), F.max("line_no").alias("line_no"), F.bool_or(odd).alias("odd"))
    return found.filter(~F.col("odd"))


def definitions(rows: DataFrame, homes: DataFrame, arguments: DataFrame) -> DataFrame:
    """(table_name, name, path, at, body): named scopes and class methods of models' files."""
    rows = saved(rows.join(homes, "path"), "model_tokens")
    bodies = _bodies(rows)
    order = Window.partitionBy("path").orderBy("i")
    wide = rows.withColumns({"t1": F.lead("text").over(order), "t2": F.lead("text", 2).over(order), "t3": F.lead("text", 3).over(order)})
    scopes = rows.filter(F.col("called") & (F.col("text") == "scope")).join(arguments, ["path", "i"]).filter("first_name is not null").select("path", "home", F.col("i").alias("call"), F.col("first_name").alias("name"))
    lambdas = rows.filter("text = '->'").select("path", F.col("i").alias("chain"), F.col("argument_of").alias("call"))
    blocks = rows.filter("block").select("path", "chain", F.col("i").alias("opener"), F.col("argument_of").alias("call"), "text")
    of_call = blocks.drop("call").join(lambdas, ["path", "chain"]).select("path", "call", "opener")
    of_call = of_call.union(blocks.filter("text = 'do' and chain = opener").select("path", "call", "opener")).union(blocks.filter("chain <> opener").select("path", F.col("chain").alias("call"), "opener")).filter("call is not null")
    named = scopes.join(of_call, ["path", "call"]).join(bodies.drop("line_no"), ["path", "opener"]).select("home", "name", "path", F.col("call").alias("at"), "body")
    singletons = wide.filter("text = 'class' and t1 = '<<' and t2 = 'self'").select("path", F.col("i").alias("barrier"), F.lit(True).alias("singleton"))
    defs = wide.filter("text = 'def' and opens").join(singletons, ["path", "barrier"], "left")
    own = F.when((F.col("t1") == "self") & (F.col("t2") == "."), F.col("t3")).when(F.col("singleton"), F.col("t1"))
    methods = defs.select("path", "home", F.col("i").alias("opener"), own.alias("name")).filter("name is not null").join(bodies.filter("line_no > 0"), ["path", "opener"])
    short = rows.filter("kind = 'endless'").join(singletons, ["path", "barrier"], "left")
    name = F.regexp_extract("text", r"\Adef\s+(?:self\.)?(\w+[?!]?)", 1)
    short = short.filter(F.col("singleton") | F.col("text").rlike(r"\Adef\s+self\.")).select("home", name.alias("name"), "path", F.col("i").alias("at"), F.col("ni").alias("body"))
    return named.union(methods.select("home", "name", "path", F.col("opener").alias("at"), "body")).union(short).withColumnRenamed("home", "table_name")


def variables(rows: DataFrame) -> DataFrame:
    """(path, i, value, again): for each use of a local variable the chain that it holds there, null where that is none.

    An assignment counts from the end of its value on; a value that begins with
    the variable itself is told so (`again`): its calls see what all of them filter.
    """
    firsts = rows.select("path", F.col("i").alias("at"), "text", "kind", "scope", "barrier", "n", "p", "ni", "chain", "parent")
    after = rows.filter("text = '='").select("path", F.col("i").alias("ni"), F.col("ni").alias("value"))
    ends = rows.groupBy("path", F.col("chain").alias("value")).agg(F.max_by(_in("n", "||", "&&", "?", "..", "..."), "i").alias("odd"), F.max("i").alias("last"))  # of fixed width: added up by hash
    held = F.when(~F.coalesce("odd", F.lit(False)), F.col("value"))
    writes = firsts.filter("kind = 'name' and chain = at and n = '='").join(after, ["path", "ni"]).join(ends, ["path", "value"], "left").select("path", F.col("text").alias("name"), F.coalesce("last", "at").alias("at"), "scope", "barrier", held.alias("value"))
    openers = rows.filter("opens").select("path", F.col("i").alias("parent"), F.col("block").alias("in_block"), F.col("p").alias("before"), F.col("pkind").alias("before_kind"), F.col("chain").alias("opened")).filter("in_block or before_kind = 'title' or before = '->'")
    inside = firsts.filter("kind in ('name', 'label') or text = '|'").join(openers, ["path", "parent"]).withColumn("bars", F.sum((F.col("text") == "|").cast("int")).over(Window.partitionBy("path", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    named = F.col("kind").isin("name", "label") & (F.col("p").isNull() | _in("p", ",", "|", "*", "&", "**"))
    arrows = rows.filter("block").select("path", F.col("chain").alias("opened"), F.col("i").alias("arrow_scope"))
    given = inside.filter(named & ((F.col("in_block") & (F.col("bars") == 1)) | (F.col("before_kind") == "title") | (F.col("before") == "->"))).join(arrows, ["path", "opened"], "left")
    given = given.select("path", F.regexp_replace("text", ":$", "").alias("name"), "at", F.when(F.col("before") == "->", F.coalesce("arrow_scope", "scope")).otherwise(F.col("scope")).alias("scope"), "barrier", F.lit(None).cast("int").alias("value"))
    closed = rows.filter("closes").select("path", F.col("partner").alias("scope"), F.col("i").alias("until"))
    writes = writes.union(given).join(closed, ["path", "scope"], "left").select("path", "name", "barrier", "at", "scope", "until", "value")
    uses = rows.filter("kind = 'name' and chain = i").filter(~_in("n", "=")).select("path", F.col("text").alias("name"), "barrier", "i")
    met = uses.join(writes, ["path", "name", "barrier"]).filter((F.col("at") < F.col("i")) & (F.col("i") < F.coalesce("until", F.lit(2**31 - 1))))
    place = F.shiftleft(F.col("scope").cast("long"), 32) + F.col("at")  # the innermost scope, there the last
    found = met.groupBy("path", "i").agg(F.max_by("value", place).alias("value"))
    own = writes.filter("value is not null").select("path", F.col("value").alias("i"), F.col("name").alias("of"))
    again = own.join(uses.select("path", "i", F.col("name").alias("of")), ["path", "i", "of"]).select("path", "i", F.lit(True).alias("again"))
    return found.join(again, ["path", "i"], "left").select("path", "i", "value", F.coalesce("again", F.lit(False)).alias("again"))


def _grown(start: DataFrame, step, label: str) -> DataFrame:
    """`start` and what `step` derives from each round's new rows, until there are none."""
    whole = new = saved(start, label)
    while True:
        new = saved(step(new), label)
        if not new.limit(1).count():
            return whole
        whole = whole.unionByName(new)


def analysed(files: DataFrame, models: DataFrame, catalog: DataFrame) -> DataFrame:
    """The usage relation of (path, text) files.

    `models` has model, table_name, seq and, where files are to be matched to
    models, source_location; `catalog` has table_name, column_name and may have
    sql_type, by which columns are known to hold JSON, and seq, their order.
    Usages come in order of paths and places; an outer call comes before those
    that it is called on.  All steps run in as many parts as the text makes.
    """
    parts = parts_of(files)
    with in_parts(files.sparkSession, parts):
        return _analysed(files, models, catalog, parts)


def _analysed(files: DataFrame, models: DataFrame, catalog: DataFrame, parts: int) -> DataFrame:
    located = models if "source_location" in models.columns else models.withColumn("source_location", F.lit(None).cast("string"))
    names = located.groupBy(F.col("model").alias("constant")).agg(F.max_by("table_name", "seq").alias("table_name"))
    homes = located.filter("source_location is not null").groupBy(F.col("source_location").alias("path")).agg(F.max_by("table_name", "seq").alias("home"))
    typed = catalog if "sql_type" in catalog.columns else catalog.withColumn("sql_type", F.lit("jsonb"))
    typed = typed if "seq" in typed.columns else typed.withColumn("seq", F.lit(0))
    ordered = lambda when: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("seq", "column_name")))), lambda x: x["column_name"]))
    known = typed.groupBy("table_name").agg(ordered(F.lit(True)).alias("known"), ordered(F.lower("sql_type") == "jsonb").alias("json"))

    rows = saved(linked(files, parts), "tokens")
    arguments = saved(_arguments(rows), "arguments")
    held = saved(variables(rows), "variables")

    # tables of chains: by constant, by file, or through variables
    head = rows.filter("goes = 0").filter((F.col("kind") == "constant") | (F.col("text") == "::"))
    constants = head.groupBy("path", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("constant")).join(names, "constant")
    starts = rows.filter("chain = i").select("path", "chain", "kind", "called")
    implicit = starts.filter("called").join(held.select("path", F.col("i").alias("chain")), ["path", "chain"], "left_anti").join(homes, "path").select("path", "chain", F.col("home").alias("table_name"))
    through = saved(held.filter("value is not null").select("path", F.col("i").alias("chain"), "value", "again"), "through")
    follow = lambda new: through.join(new.select("path", F.col("chain").alias("value"), "table_name"), ["path", "value"]).select("path", "chain", "table_name")
    tables = saved(_grown(constants.select("path", "chain", "table_name").union(implicit), follow, "tables"), "tables")

    # filters of chains: their own, and those behind variables and helpers
    calls = rows.filter("called").select("path", "chain", "i", "line", F.col("text").alias("name")).join(held.select("path", "i"), ["path", "i"], "left_anti")
    calls = saved(calls.join(tables, ["path", "chain"]).join(known, "table_name").join(arguments, ["path", "i"], "left"), "calls")
    none = F.array().cast("array<string>")
    filters = F.array_intersect("known", F.coalesce("keywords", none))
    defined = definitions(rows, homes, arguments).groupBy("table_name", "name").agg(F.array_sort(F.collect_list(F.struct("path", "at", "body"))).alias("defs"))
    helped = calls.join(defined, ["table_name", "name"], "left").withColumn("d", F.try_element_at(F.filter("defs", lambda d: d["path"] <= F.col("path")), F.lit(-1)))
    helped = saved(helped.select("path", "chain", "i", "d", filters.alias("cols"), "name"), "helped")
    key = F.concat_ws(":", "to_path", F.col("to").cast("string"))
    edges = saved(
        helped.filter("d is not null").select("path", "chain", F.col("i").alias("at"), F.col("d.path").alias("to_path"), F.col("d.body").alias("to"))
        .union(through.select("path", "chain", F.lit(-1).alias("at"), F.col("path").alias("to_path"), F.col("value").alias("to")))
        .union(through.filter("again").select("path", "chain", F.lit(-1).alias("at"), F.col("path").alias("to_path"), F.col("chain").alias("to"))), "edges",
    )
    direct = helped.filter((F.col("name") == "where") & F.col("d").isNull() & (F.size("cols") > 0)).select("path", "chain", F.col("i").alias("at"), "cols")
    further = edges.select(F.col("path").alias("to_path"), F.col("chain").alias("to"), F.col("at").alias("next_at"), F.col("to_path").alias("next_path"), F.col("to").alias("next"))

    def deeper(new: DataFrame) -> DataFrame:
        met = new.join(further, ["to_path", "to"]).select("path", "chain", F.concat("ord", F.array("next_at")).alias("ord"), "seen", F.col("next_path").alias("to_path"), F.col("next").alias("to"))
        return met.filter(~F.array_contains("seen", key)).withColumn("seen", F.concat("seen", F.array(key)))

    reached = _grown(edges.select("path", "chain", F.array("at").alias("ord"), F.array(key).alias("seen"), "to_path", "to"), deeper, "reached")
    behind = reached.join(direct.select(F.col("path").alias("to_path"), F.col("chain").alias("to"), "at", "cols"), ["to_path", "to"]).select("path", "chain", F.concat("ord", F.array("at")).alias("ord"), "cols")
    items = behind.union(direct.select("path", "chain", F.array("at").alias("ord"), "cols")).groupBy("path", "chain").agg(F.array_sort(F.collect_list(F.struct("ord", "cols"))).alias("items"))

    # usages
    strings, words = F.coalesce("strings", none), F.coalesce("keywords", none)
    sorted_by = F.array_intersect(F.array_distinct(F.concat(words, F.coalesce("symbols", none), F.flatten(F.transform(strings, order_words)))), F.col("known"))
    json = F.filter("json", lambda c: F.exists(strings, lambda s: s.rlike(JSON_MARK) & F.regexp_like(s, F.concat(F.lit(r"\b\Q"), c, F.lit(r"\E\b")))))
    usage = lambda operation, cols, context: F.transform(cols, lambda c: F.struct(F.lit(operation).alias("operation"), c.alias("column_name"), context.alias("where_columns")))
    before = F.array_distinct(F.flatten(F.transform(F.filter(F.coalesce("items", F.array().cast("array<struct<ord:array<int>,cols:array<string>>>")), lambda x: F.get(x["ord"], F.lit(0)) < F.col("i")), lambda x: x["cols"])))
    found = F.when(F.col("name") == "where", F.concat(usage("where", filters, none), usage("jsonb_where", json, none))).otherwise(usage("order", sorted_by, before))
    recorded = calls.filter(F.col("name").isin(*RECORDED)).join(items, ["path", "chain"], "left")
    recorded = recorded.select("path", "chain", "i", "table_name", "args_end", F.posexplode(found).alias("k", "u"))
    ends = rows.filter("part is not null and not text in ('.', '&.')").groupBy("path", F.col("part").alias("i")).agg(F.max(F.col("pos") + F.length("text")).alias("end"))
    begun = rows.filter("chain = i").select("path", "chain", F.col("pos").alias("begin"), "line")
    out = recorded.join(begun, ["path", "chain"]).join(ends, ["path", "i"]).join(files.select("path", "text"), "path")
    source = F.substring("text", F.col("begin") + 1, F.greatest("end", F.coalesce("args_end", "end")) - F.col("begin"))
    made = {
        "operation": F.col("u.operation"), "column_name": F.col("u.column_name"), "where_columns": F.col("u.where_columns"), "source": source, "origin": F.lit("source"), "count": F.lit(1).cast("bigint"),
        "total_duration_ms": F.lit(None).cast("double"), "plan_rows": F.lit(None).cast("bigint"), "seq": F.struct(F.col("path").alias("p"), F.col("chain").alias("c"), (-F.col("i")).alias("i"), F.col("k").alias("k")),
    }
    cols = [(made[c] if c in made else F.col(c) if c in ("path", "line", "table_name") else F.lit(None).cast("string")).alias(c) for c in columns("usages")]
    return ranked(out.select(*cols), "seq").select(*columns("usages"))
