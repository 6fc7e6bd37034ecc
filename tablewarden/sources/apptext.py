"""Query patterns and reference changes in application source text.

Source files are read whole by Spark and cut into statements by built-in
functions: comments and line breaks inside call chains go, then each call of
`where`, `order` or `reorder` in a chain that starts at a model's constant gives
the columns among its arguments.  This covers chains that stand in one statement;
what needs a language parser (values passed through variables, helpers and scopes
defined elsewhere) is left out rather than guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sqltext import let, order_words
from ..schemas import columns

#: The folders whose files are read.
FOLDERS = ("app/controllers", "app/jobs", "app/models", "app/queries", "app/services", "lib")
_PLAIN = r"[^()\"']++|\"[^\"]*\"|'[^']*'"
#: Arguments with brackets in them, down to the sixth level.
ARGS = rf"(?:{_PLAIN})*+"
for _ in range(6):
    ARGS = rf"(?:{_PLAIN}|\({ARGS}\))*+"
CHAIN = rf"(?s)(?<![\w:.\"'])((?:[A-Z]\w*::)*[A-Z]\w*)((?:\s*&?\.\s*[a-z_]\w*[?!]?(?:\({ARGS}\))?)+)"
CALL = rf"(?s)\.\s*(where|order|reorder)\(({ARGS})\)"
#: Calls whose arguments have no brackets: a symbol, keyword or string and what follows it in the statement.
UNBRACKETED = rf"(?<![\w:@$\"'])(where|order|reorder)[ \t]+(?=:\w|\w+:[^:]|[\"'])((?:(?!\s+(?:if|unless|do|and|or|then)\b)(?:,\s*\n\s*|[^()\"'\n;{{}}\[\]]|\"[^\"\n]*\"|'[^'\n]*'|\[[^\]\n]*\]|\({ARGS}\)))+)"
#: Calls without a receiver, and the constant that stands for a model's own file.
BARE, OWN = r"(?<![\w:@$\"'])(?<!\.\s{0,99})(?<!def )(?=(?:where|order|reorder)\()", "Implicit__Self"
KEYWORD = r"(?:^|[,{(\s])(\w+):(?!:)"
SYMBOL = r"(?<![\w:]):(\w+)"
QUOTED = r"\"([^\"]*)\"|'([^']*)'"
JSON_MARK = r"->>|->|@>|jsonb_extract_path"


def read_text(spark: SparkSession, root: str, pattern: str = "*.rb", folders: tuple[str, ...] = FOLDERS) -> DataFrame:
    """(path, text) of the files in the folders below `root`, whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    exists = lambda p: (path := hadoop.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    found = [f"{root}/{folder}" for folder in folders if exists(f"{root}/{folder}")]
    if not found:
        return spark.createDataFrame([], "path string, text string")
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(found, wholetext=True)
    return read.select(F.regexp_replace("_metadata.file_path", "^file:", "").alias("path"), F.col("value").alias("text")).dropDuplicates(["path"])


def without_comments(text: Column) -> Column:
    """Comments from # to the line's end go; # inside quotes stays."""
    return F.regexp_replace(text, r"(?m)(\"[^\"\n]*\"|'[^'\n]*')|#[^\n]*", "$1")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: x != "")


def _unquoted(args: Column) -> Column:
    return F.regexp_replace(args, QUOTED, '""')


def source_usages(files: DataFrame, models: DataFrame, catalog: DataFrame) -> DataFrame:
    """The usage relation of (path, text) files.

    `models` gives a constant's table, by source_location (where it has that column) the
    table of calls without a receiver in that file, and `catalog` (table_name, column_name) the
    columns that count.  An outer call comes before those it is called on; files
    come in order of their paths.
    """
    known = catalog.groupBy("table_name").agg(F.collect_set("column_name").alias("known"))
    tables = models.groupBy(F.col("model").alias("constant")).agg(F.min_by("table_name", "seq").alias("table_name")).join(known, "table_name")
    if "source_location" in models.columns:
        own = models.filter("source_location is not null").groupBy(F.concat(F.lit("file "), "source_location").alias("constant")).agg(F.max_by("table_name", "seq").alias("table_name"))
        tables = tables.unionByName(own.join(known, "table_name").select(*tables.columns))
    text = F.regexp_replace(F.regexp_replace(without_comments(F.col("text")), UNBRACKETED, "$1($2)"), BARE, f"{OWN}.")
    chains = files.select("path", text.alias("text")).select("path", "text", F.posexplode(F.arrays_zip(_groups("text", CHAIN, 1).alias("constant"), _groups("text", CHAIN, 2).alias("calls"))).alias("chain_no", "c"))
    rows = chains.select("path", "text", "chain_no", "c.constant", "c.calls", F.when(F.col("c.constant") == OWN, F.concat(F.lit("file "), "path")).otherwise(F.col("c.constant")).alias("key"))
    rows = rows.join(tables.withColumnRenamed("constant", "key"), "key")
    line = F.size(F.split(F.call_function("substring_index", F.col("text"), F.concat("constant", "calls"), F.lit(1)), "\n"))
    calls = F.reverse(F.arrays_zip(_groups("calls", CALL, 1).alias("name"), _groups("calls", CALL, 2).alias("args")))
    met = rows.select("path", line.alias("line"), "chain_no", "constant", "table_name", "known", "calls", F.posexplode(calls).alias("call_no", "k"))
    args, name = F.col("k.args"), F.col("k.name")
    bare = _unquoted(args)
    strings = F.array_distinct(F.concat(_all(args, QUOTED, 1), _all(args, QUOTED, 2)))
    filters = lambda t: F.array_intersect(_all(_unquoted(t), KEYWORD), F.col("known"))
    earlier = F.flatten(F.transform(F.filter(F.arrays_zip(_groups("calls", CALL, 1).alias("n"), _groups("calls", CALL, 2).alias("a")), lambda x: x["n"] == "where"), lambda x: filters(x["a"])))
    json = F.filter(F.col("known"), lambda c: F.exists(strings, lambda s: s.rlike(JSON_MARK) & F.regexp_like(s, F.concat(F.lit(r"\b\Q"), c, F.lit(r"\E\b")))))
    sorted_by = F.array_intersect(F.array_distinct(F.concat(_all(bare, KEYWORD), _all(bare, SYMBOL), F.flatten(F.transform(strings, order_words)))), F.col("known"))
    none = F.array().cast("array<string>")
    usage = lambda operation, cols, context: F.transform(F.array_sort(cols), lambda c: F.struct(F.lit(operation).alias("operation"), c.alias("column_name"), context.alias("where_columns")))
    empty = F.array().cast("array<struct<operation:string,column_name:string,where_columns:array<string>>>")
    found = F.when(name == "where", F.concat(usage("where", filters(args), none), usage("jsonb_where", json, none))).otherwise(let(F.array_distinct(earlier), lambda w: usage("order", sorted_by, w)))
    out = met.select("path", "line", "chain_no", "call_no", "table_name", "constant", "calls", F.posexplode(F.coalesce(found, empty)).alias("pos", "u"))
    made = {
        "seq": F.col("chain_no").cast("bigint") * 1_000_000 + F.col("call_no") * 1_000 + F.col("pos"), "operation": F.col("u.operation"), "column_name": F.col("u.column_name"), "where_columns": F.col("u.where_columns"),
        "source": F.regexp_replace(F.replace(F.concat("constant", "calls"), F.lit(f"{OWN}."), F.lit("")), r"\s+", " "), "origin": F.lit("source"), "count": F.lit(1).cast("bigint"), "total_duration_ms": F.lit(None).cast("double"), "plan_rows": F.lit(None).cast("bigint"),
    }
    # one number for each source file, of which an application has thousands at most
    ranks = files.select("path").distinct().select("path", F.row_number().over(Window.orderBy("path")).alias("file_no"))
    cols = [(made[c] if c in made else F.col(c) if c in ("path", "line", "table_name") else F.lit(None).cast("string")).alias(c) for c in columns("usages")]
    return out.select(*cols).join(ranks, "path").withColumn("seq", F.col("file_no").cast("bigint") * 1_000_000_000_000 + F.col("seq")).select(*columns("usages"))


def _groups(col: str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(group))


#: Statements of migrations that add a reference.
_NAME = r"(?::?[\"']|:)({})\b[\"']?"
_TABLE, _COLUMN = _NAME.format(r"[\w.]+"), _NAME.format(r"\w+")
ADD_REFERENCE = rf"(?m)^[ \t]*(?:add_reference|add_belongs_to)[\s(]+{_TABLE}\s*,\s*{_COLUMN}([^\n]*)"
ADD_COLUMN = rf"(?m)^[ \t]*add_column[\s(]+{_TABLE}\s*,\s*{_NAME.format(r'\w+_id')}([^\n]*)"
#: A block ends at the end with its own indentation.
CREATE_TABLE = rf"(?ms)^([ \t]*)create_table[\s(]+{_TABLE}[^\n]*?\bdo\s*\|(\w+)\|(.*?)^\1end\b"
BUILDER = rf"(?m)^[ \t]*(\w+)\.(?:references|belongs_to)[\s(]+{_COLUMN}([^\n]*)"
COVERED = r"foreign_key:\s*(true|\{)|polymorphic:\s*true"


def migration_changes(files: DataFrame) -> DataFrame:
    """The migrations relation of (path, text) files: references added without a foreign key or polymorphism."""
    text = files.select("path", without_comments(F.col("text")).alias("text"))
    line = lambda part: F.size(F.split(F.call_function("substring_index", F.col("text"), part, F.lit(1)), "\n"))

    def top(pattern: str, suffix: str) -> DataFrame:
        zipped = F.arrays_zip(_groups("text", pattern, 0).alias("m"), _groups("text", pattern, 1).alias("t"), _groups("text", pattern, 2).alias("c"), _groups("text", pattern, 3).alias("rest"))
        rows = text.select("path", "text", F.explode(zipped).alias("x"))
        return rows.select("path", line(F.trim(F.col("x.m"))).alias("line"), F.col("x.t").alias("table_name"), F.concat(F.col("x.c"), F.lit(suffix)).alias("column_name"), F.col("x.rest").alias("rest"), F.trim("x.m").alias("source"))

    blocks = F.arrays_zip(_groups("text", CREATE_TABLE, 2).alias("t"), _groups("text", CREATE_TABLE, 3).alias("v"), _groups("text", CREATE_TABLE, 4).alias("body"))
    inside = text.select("path", "text", F.explode(blocks).alias("b")).select("path", "text", "b.t", "b.v", "b.body")
    built = F.arrays_zip(_groups("body", BUILDER, 0).alias("m"), _groups("body", BUILDER, 1).alias("v"), _groups("body", BUILDER, 2).alias("c"), _groups("body", BUILDER, 3).alias("rest"))
    rows = inside.select("path", "text", "t", "v", F.explode(built).alias("x")).filter(F.col("v") == F.col("x.v"))
    nested = rows.select("path", line(F.trim(F.col("x.m"))).alias("line"), F.col("t").alias("table_name"), F.concat("x.c", F.lit("_id")).alias("column_name"), F.col("x.rest").alias("rest"), F.trim("x.m").alias("source"))
    found = top(ADD_REFERENCE, "_id").unionByName(top(ADD_COLUMN, "")).unionByName(nested).filter(~F.col("rest").rlike(COVERED))
    return found.select(F.col("line").cast("bigint").alias("seq"), "table_name", "column_name", "path", "line", "source")
