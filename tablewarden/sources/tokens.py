"""Tokens of application source text as rows, and how they nest.

One ordered alternation cuts a file into tokens whose texts, joined, are the
file; they become rows with their position and kind.  Nesting follows from running
sums over these rows: a token's depth is the number of brackets and blocks opened
and not closed before it, and what encloses it is the last opener of the depth
above.  All windows are over one file's rows, brought together by one shuffle.

Known limits: of several heredocs begun in one line the first ends the line, a
quoted string within a string's interpolation may hold no interpolation itself, and
a slash is a pattern's beginning only after an operator, a bracket, a comma or a
keyword.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of the language that are no names.
KEYWORDS = (
    "alias", "and", "begin", "break", "case", "class", "def", "defined?", "do", "else", "elsif", "end", "ensure", "false", "for", "if", "in", "module", "next", "nil", "not", "or", "redo", "rescue", "retry",
    "return", "self", "super", "then", "true", "undef", "unless", "until", "when", "while", "yield",
)
#: Tokens in the order in which they are tried.
TOKEN = "|".join((
    r"(?m:^=begin\b)(?s:.*?)(?:(?m:^=end\b)[^\n]*|\z)",  # block comments
    r"#[^\n]*",
    r"(?<=<<[~-]?[\"'`]?([A-Za-z_]\w{0,40})[\"'`]?(?![\w\"'])[^\n]{0,200})\n(?s:.*?)(?:(?m:^[ \t]*\1[ \t]*$)|\z)",  # a heredoc's body, from its first line break
    r"\n", r"[ \t\r\f]+|\\\n",
    r"<<[~-]?(?:[A-Z_]\w*|\"\w+\"|'\w+'|`\w+`)",  # a heredoc's beginning
    r"\"(?:[^\"\\#]|\\(?s:.)|#(?!\{)|#\{(?:[^{}\"]|\"[^\"]*\"|\{[^{}]*\})*\})*+\"", r"'(?:[^'\\]|\\(?s:.))*+'", r"`(?:[^`\\]|\\(?s:.))*+`",
    r"(?<![\w)\]}@$.])%[wWiIqQrsx]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>|\|[^|]*\||![^!]*!)\w*",
    r"(?<=[(,=~\[{|&!;:?]|[(,=~\[{|&!;:?][ ]|\n|\n[ ]{1,40}|\b(?:if|unless|when|and|or|not|return|while|until)[ ])/(?:[^/\\\n]|\\.)+/[imxounse]*",
    r"(?<![:\w]):\"[^\"]*\"|(?<![:\w]):[A-Za-z_]\w*[?!]?",
    r"(?<![.:?@$])\b[A-Za-z_]\w*[?!]?:(?!:)",
    r"\bdef\s+(?:self\.)?\w+[?!]?(?:\([^()\n]*\))?[ \t]+=(?=[ \t])",  # a definition without an end
    r"\b[A-Z]\w*", r"defined\?|\b[a-z_]\w*[?!]?(?![=~])|\b[a-z_]\w*", r"@{1,2}[A-Za-z_]\w*|\$\w+", r"\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?",
    r"&\.|::|->|=>|<=>|===|==|=~|!=|!~|<=|>=|\*\*|&&=?|\|\|=?|<<|>>|\.\.\.?|[-+*/%&|^]=", r"(?s:.)",
))
#: Characters of text whose tokens one task holds, some 150,000 rows.
PART_CHARS = 1 << 19
#: Scopes of local variables, and those that hide what is outside.
OPENERS = ("class", "module", "def", "begin", "case", "for", "do", "if", "unless", "while", "until", "(", "[", "{")
CLOSERS = (")", "]", "}", "end")


def parts_of(files: DataFrame) -> int:
    """How many parts these files make, of `PART_CHARS` each, so that a task's tokens are as many at any size."""
    return 1 + (files.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_CHARS


def lexed(files: DataFrame, parts: int | None = None) -> DataFrame:
    """(path, i, pos, line, kind, text): all tokens of (path, text) files; joined in order of `i` they are the file.

    The files are dealt to `parts` tasks: left to itself, Spark would join parts by the
    size of compressed text, of which a few MB make millions of rows.
    """
    rows = files.repartition(parts or parts_of(files), "path").select("path", F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(TOKEN), F.lit(0))).alias("i", "text"))
    before = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("text")
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    kind = (
        F.when(t.startswith("#") | t.startswith("=begin"), "comment").when(t == "\n", "newline").when(t.startswith("\n"), "heredoc").when(t.rlike(r"\A(?:[ \t\r\f]+|\\\n)\z"), "space")
        .when(t.rlike(r"\A<<[~-]?[A-Z_\"'`]"), "heredoc_start").when(t.rlike(r"\A[\"'`](?s:.*)[\"'`]\z"), "string").when(t.rlike(r"\A%[wWiI]?\W(?s:.)+\z") & t.rlike(r"\A%[wWiI]"), "words").when(t.rlike(r"\A%[rsx]?\W(?s:.*)\W\w*\z") & (F.length(t) > 2), "string")
        .when(t.rlike(r"\A%[qQ]\W"), "string").when(t.rlike(r"\A/.+/\w*\z"), "pattern").when(t.rlike(r"\A:[A-Za-z_\"]"), "symbol").when(t.rlike(r"\A[A-Za-z_]\w*[?!]?:\z"), "label").when(t.rlike(r"\Adef\s"), "endless")
        .when(t.isin(*KEYWORDS), "keyword").when(t.rlike(r"\A[A-Z]"), "constant").when(t.rlike(r"\A[a-z_]"), "name").when(t.rlike(r"\A[@$]\w|\A@@"), "variable").when(t.rlike(r"\A\d"), "number").otherwise("mark")
    )
    at = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    return rows.select("path", "i", at(F.length(t)).alias("pos"), (at(breaks) + 1).cast("int").alias("line"), kind.alias("kind"), "text")


def _next(c: str) -> Column:
    """The column's next value in the file that isn't null; a frame up to the file's end would be added up anew for each token."""
    return F.expr(f"lead({c}) ignore nulls over (partition by path order by i)")


def significant(tokens: DataFrame) -> DataFrame:
    """Tokens without blanks, comments and line breaks inside statements.

    gap: whether something of that kind stands before; said: the text of a
    heredoc, beside its beginning.
    """
    order = Window.partitionBy("path").orderBy("i")
    blank = F.col("kind").isin("space", "comment", "heredoc")
    rows = tokens.withColumn("body", F.when(F.col("kind") == "heredoc", F.regexp_replace("text", r"\n[^\n]*\z", "")))
    rows = rows.withColumns({"gap": F.coalesce(F.lag("kind").over(order).isin("space", "comment", "newline"), F.lit(True)), "said": F.when(F.col("kind") == "heredoc_start", _next("body"))}).filter(~blank)
    rows = rows.drop("body").withColumn("solid", F.when(F.col("kind") != "newline", F.struct("kind", "text")))
    rows = rows.withColumns({"after": _next("solid")["text"], "ahead": F.last("solid", True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    goes_on = F.coalesce(F.col("after").isin(".", "&."), F.lit(False)) | F.coalesce((F.col("ahead.kind") == "mark") & ~F.col("ahead.text").isin(")", "]", "}", ";", "|", "?", "!"), F.lit(False))
    rows = rows.filter(~((F.col("kind") == "newline") & goes_on)).drop("solid", "after", "ahead")
    dotted = F.coalesce(F.lag("text").over(order).isin(".", "&."), F.lit(False))
    return rows.withColumn("kind", F.when((F.col("kind") == "keyword") & dotted, "name").otherwise(F.col("kind")))


def _depth(opens: Column, closes: Column) -> Column:
    """How many openers are open at each token; openers and closers stand outside."""
    before = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(before), F.lit(0)) - F.when(closes, 1).otherwise(0)


def again(rows: DataFrame, when: Column) -> DataFrame:
    """`rows` with those of `when` entered twice, told apart by `mark`: as themselves and among what they enclose."""
    return rows.withColumn("mark", F.explode(F.when(when, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))


def _innermost(mark: Column, depth: str) -> Column:
    """The `i` of the innermost opener around each token, -1 for none: the last one that is marked on its depth."""
    upto = Window.partitionBy("path", depth).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.when(mark, F.col("i")), True).over(upto), F.lit(-1))


def nested(tokens: DataFrame) -> DataFrame:
    """Significant tokens with what encloses them; the name after `def` has the kind "title".

    parent: the bracket or block around a token; partner: of a closer, what it
    closes; scope: the innermost scope of local variables (class, module, def,
    block, lambda); barrier: the innermost one that hides what is outside it.

    Sorts cost most here: all that needs a file's order stands together, and so does what needs a depth's.
    """
    order = Window.partitionBy("path").orderBy("i")
    rows = significant(tokens).withColumns({"before": F.lag("text").over(order), "before_kind": F.lag("kind").over(order), "third": F.lag("text", 3).over(order)})
    t, word = F.col("text"), F.col("kind") == "keyword"
    leads = F.col("before").isNull() | F.col("before_kind").isin("newline", "label") | ((F.col("before_kind") == "mark") & ~F.col("before").isin(")", "]", "}")) | ((F.col("before_kind") == "keyword") & ~F.col("before").isin("end", "self", "nil", "true", "false"))
    loop = word & t.isin("while", "until", "for") & leads
    looped = F.coalesce(F.last(F.when(loop, F.col("line")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)) == F.col("line"), F.lit(False))
    opens = (word & (t.isin("class", "module", "def", "begin", "case") | (t.isin("if", "unless", "while", "until", "for") & leads) | ((t == "do") & ~looped))) | ((F.col("kind") == "mark") & t.isin("(", "[", "{"))
    closes = (word & (t == "end")) | ((F.col("kind") == "mark") & t.isin(")", "]", "}"))
    block = (t == "do") | ((t == "{") & (F.col("before_kind").isin("name") | F.col("before").isin(")", "->")))
    rows = rows.withColumns({"opens": opens, "closes": closes})
    rows = rows.withColumns({"hides": F.col("opens") & word & t.isin("class", "module", "def"), "block": F.col("opens") & block})
    title = F.col("kind").isin("name", "constant") & F.coalesce((F.col("before") == "def") | ((F.col("before") == ".") & (F.col("third") == "def")), F.lit(False))
    rows = rows.withColumns({"kind": F.when(title, "title").otherwise(F.col("kind")), "depth": _depth(F.col("opens"), F.col("closes"))}).drop("before", "before_kind", "third")

    rows = again(rows, F.col("opens")).withColumn("depth", F.col("depth") + F.col("mark").cast("int"))
    last = F.lag(F.struct("i", "hides", "block")).over(Window.partitionBy("path", "depth").orderBy("i"))  # on a closer's depth, what it closes stands last
    rows = rows.withColumns({"parent": _innermost(F.col("mark"), "depth"), "partner": F.when(F.col("closes"), last)}).filter("not mark").drop("mark", "depth")

    ends = lambda c: F.coalesce(F.col(f"partner.{c}"), F.lit(False))
    scopes = F.col("hides") | F.col("block")
    rows = rows.withColumns({"in_scopes": _depth(scopes, ends("hides") | ends("block")), "in_barriers": _depth(F.col("hides"), ends("hides"))}).withColumn("partner", F.col("partner.i"))
    hiding = F.col("mark") & F.col("hides")
    rows = again(rows, scopes).withColumns({"in_scopes": F.col("in_scopes") + F.col("mark").cast("int"), "in_barriers": F.col("in_barriers") + hiding.cast("int")})
    return rows.withColumns({"scope": _innermost(F.col("mark"), "in_scopes"), "barrier": _innermost(hiding, "in_barriers")}).filter("not mark").drop("mark", "in_scopes", "in_barriers", "hides")
