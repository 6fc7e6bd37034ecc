"""SQL statements as text: tables, aliases, column references, JSON operators, binds.

All of it is built-in expressions over one row.  A statement's matches are arrays
of structs, its alias map is looked up inside the row, and nothing is shuffled
before the usages are counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a table, a clause, a column and a JSON operator.
_NAME = r'"?([a-zA-Z_][\w$]*)"?'
TABLES = rf"(?i)\b(?:FROM|JOIN|UPDATE)\s+(?:{_NAME}\.)?{_NAME}(?:\s+(?:AS\s+)?{_NAME})?"
WHERE = r"(?is)\bWHERE\b(.+?)(?:\bGROUP\b|\bORDER\b|\bLIMIT\b|\bOFFSET\b|\bFOR\b|\z)"
ORDER = r"(?is)\bORDER\s+BY\b(.+?)(?:\bLIMIT\b|\bOFFSET\b|\bFOR\b|\z)"
QUALIFIED = rf"(?:{_NAME}\.)?{_NAME}\.{_NAME}"
EXTRACTION, CONTAINMENT = r"\s*(?:->>|->)\s*'(?:[^']+)'", r"\s*@>"
#: Literals that no pattern above can tell apart.
NUMBERS = r"(?<![\w$])[0-9]++(?![\w$])(?:\s*,\s*[0-9]++(?![\w$]))*+"
TEXT_LITERAL = r"(?i)'(?![^']*\b(?:FROM|JOIN|UPDATE|WHERE|ORDER|GROUP|LIMIT|OFFSET|FOR)\b)[^'\".>]++'"
#: Keywords that are no alias.
CLAUSES = ("WHERE", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "JOIN", "ON", "GROUP", "ORDER", "LIMIT", "OFFSET", "FOR", "SET", "RETURNING", "USING")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def matches(text: Column, pattern: str, *names: str) -> Column:
    """Array of structs, one for each match, with the groups by name; '' where a group is absent.

    The text is searched once; the groups are cut out of the short matches.
    """
    cut = lambda m: F.struct(*[F.regexp_extract(m, pattern, i + 1).alias(name) for i, name in enumerate(names)])
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), cut)


def qualified(schema: Column, name: Column) -> Column:
    return F.when(schema == "", name).otherwise(F.concat(schema, F.lit("."), name))


def table_refs(sql: Column) -> Column:
    """Array of (name, canonical, alias); a null alias where there is none or a clause follows."""
    alias = lambda m: F.when((m["a"] != "") & ~F.upper(m["a"]).isin(list(CLAUSES)), m["a"])
    return F.transform(matches(sql, TABLES, "s", "t", "a"), lambda m: F.struct(m["t"].alias("name"), qualified(m["s"], m["t"]).alias("canonical"), alias(m).alias("alias")))


def table_of(tables: Column, qualifier: Column) -> Column:
    """The table that a qualifier means: the last alias of that name, else the first table of it; null if there is none."""
    aliased = F.filter(tables, lambda t: t["alias"] == qualifier)
    named = F.filter(tables, lambda t: (t["name"] == qualifier) | (t["canonical"] == qualifier))
    return F.coalesce(first(F.reverse(aliased))["canonical"], first(named)["canonical"])


def distinct_tables(tables: Column) -> Column:
    """The tables that some qualifier of the statement means."""
    keys = F.flatten(F.transform(tables, lambda t: F.filter(F.array(t["name"], t["canonical"], t["alias"]), lambda k: k.isNotNull())))
    return F.array_distinct(F.transform(keys, lambda k: table_of(tables, k)))


def where_fragment(sql: Column) -> Column:
    return F.regexp_extract(sql, WHERE, 1)


def order_fragment(sql: Column) -> Column:
    return F.regexp_extract(sql, ORDER, 1)


def _resolved(found: Column, tables: Column) -> Column:
    """(qualifier, table_name, column_name) of matches s, q, c whose qualifier is known, distinct."""
    row = lambda m: F.struct(
        qualified(m["s"], m["q"]).alias("qualifier"),
        F.coalesce(table_of(tables, qualified(m["s"], m["q"])), table_of(tables, m["q"])).alias("table_name"),
        m["c"].alias("column_name"),
    )
    return F.array_distinct(F.filter(F.transform(found, row), lambda r: r["table_name"].isNotNull()))


def column_refs(fragment: Column, tables: Column) -> Column:
    return _resolved(matches(fragment, QUALIFIED, "s", "q", "c"), tables)


def pair(row: Column) -> Column:
    return F.struct(row["table_name"].alias("table_name"), row["column_name"].alias("column_name"))


def json_refs(fragment: Column, tables: Column) -> Column:
    """Distinct (table_name, column_name) under a JSON operator; without a qualifier only if the statement has one table."""
    none = F.array().cast("array<struct<table_name:string,column_name:string>>")
    with_operator = lambda sign, found: F.when(F.contains(fragment, F.lit(sign)), found)
    of = lambda sign, operator: F.coalesce(with_operator(sign, F.transform(_resolved(matches(fragment, QUALIFIED + operator, "s", "q", "c"), tables), pair)), none)
    bare = F.array_distinct(F.concat(*[F.regexp_extract_all(fragment, F.lit(_NAME + operator), F.lit(1)) for operator in (EXTRACTION, CONTAINMENT)]))
    alone = let(distinct_tables(tables), lambda d: F.when(F.size(d) == 1, F.transform(bare, lambda c: F.struct(first(d).alias("table_name"), c.alias("column_name")))).otherwise(none))
    some = F.contains(fragment, F.lit("->")) | F.contains(fragment, F.lit("@>"))
    return F.when(some, F.array_distinct(F.concat(of("->", EXTRACTION), of("@>", CONTAINMENT), alone))).otherwise(none)


def statement_usages(sql: Column) -> Column:
    """Array of (operation, table_name, column_name, where_columns) in the order a statement gives them."""
    none = F.array().cast("array<string>")
    usage = lambda operation, row, context: F.struct(F.lit(operation).alias("operation"), row["table_name"].alias("table_name"), row["column_name"].alias("column_name"), context.alias("where_columns"))

    def build(tables: Column, wheres: Column, json: Column, orders: Column) -> Column:
        plain = F.filter(F.array_distinct(F.transform(wheres, pair)), lambda r: ~F.array_contains(json, r))
        context = lambda qualifier: F.array_distinct(F.transform(F.filter(wheres, lambda w: w["qualifier"] == qualifier), lambda w: w["column_name"]))
        return F.concat(
            F.transform(plain, lambda r: usage("where", r, none)),
            F.transform(json, lambda r: usage("jsonb_where", r, none)),
            F.transform(orders, lambda r: usage("order", r, context(r["qualifier"]))),
        )

    def of(tables: Column) -> Column:
        where = lambda use: let(where_fragment(sql), use)
        return where(lambda w: let(column_refs(w, tables), lambda wheres: let(json_refs(w, tables), lambda json: let(column_refs(order_fragment(sql), tables), lambda orders: build(tables, wheres, json, orders)))))

    usage_type = "array<struct<operation:string,table_name:string,column_name:string,where_columns:array<string>>>"
    return F.when(sql.rlike(r"(?i)\b(WHERE|ORDER)\b"), let(table_refs(sql), of)).otherwise(F.array().cast(usage_type))


def shape(sql: Column) -> Column:
    """`sql` with its literals alike: `statement_usages` of both are equal.

    A number that stands alone, or a list of them, becomes 0, and text between quotes
    'x'.  No name has such a number in it, as names begin with a letter; text stays
    as it is where it holds a dot, a double quote, > or a word that a clause begins
    or ends with, since a match of the patterns above needs one of these.
    """
    texts = F.regexp_replace(sql, TEXT_LITERAL, "'x'")
    return F.regexp_replace(texts, NUMBERS, "0")


def explainable(sql: Column) -> Column:
    """Whether a statement can be planned as it stands: a query without placeholders."""
    text = F.coalesce(sql, F.lit(""))
    return text.rlike(r"(?i)^\s*(SELECT|WITH)(\s|$)") & ~text.rlike(r"\$\d") & ~F.contains(text, F.lit("?"))


def quoted(value: Column, numeric: Column) -> Column:
    """A bind as a literal: null as NULL, a number bare, else text in quotes."""
    return F.when(value.isNull(), F.lit("NULL")).when(numeric, value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))


def literalised(sql: Column, binds: Column) -> Column:
    """`sql` with its binds, an array of (value, numeric), in place of $n or of each ?.

    Numbers are replaced from the highest down, over what came in before; a ?
    without a bind becomes NULL.  Without binds or placeholders, and for null
    statements, nothing changes.
    """
    texts = F.transform(binds, lambda b: quoted(b["value"], b["numeric"]))

    def numbered(values: Column) -> Column:
        places = F.sequence(F.size(values), F.lit(1), F.lit(-1))
        return F.aggregate(places, sql, lambda out, i: F.replace(out, F.concat(F.lit("$"), i.cast("string")), F.get(values, i - 1)))

    def positional(values: Column) -> Column:
        parts = F.split(sql, r"\?")
        return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.coalesce(F.get(values, i), F.lit("NULL")))).otherwise(p)), "")

    changed = F.when(sql.rlike(r"\$\d"), let(texts, numbered)).when(F.contains(sql, F.lit("?")), let(texts, positional)).otherwise(sql)
    return F.when(F.coalesce(F.size(binds) > 0, F.lit(False)), changed).otherwise(sql)


def milliseconds(started: Column, finished: Column) -> Column:
    return F.round((F.unix_micros(finished) - F.unix_micros(started)) / 1000, 2)


def order_words(text: Column) -> Column:
    """The columns of an ORDER string: the first word of each part between commas."""
    return F.filter(F.transform(F.split(text, ","), lambda p: first(F.split(F.trim(p), r"\s+"))), lambda w: w != "")
