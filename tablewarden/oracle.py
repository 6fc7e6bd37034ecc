"""DuckDB twins of the evidence queries.

They share the inputs of `fixtures` and nothing else: statements are cut up into
rows and joined, where the operators look inside arrays.
"""

from __future__ import annotations


from . import fixtures
from .functions import sqltext
from .queries import RULES, SUPPRESS

_RE = {name: pattern.replace("'", "''") for name, pattern in {
    "tables": sqltext.TABLES, "where": sqltext.WHERE, "order": sqltext.ORDER, "column": sqltext.QUALIFIED, "extract": sqltext.QUALIFIED + sqltext.EXTRACTION, "contain": sqltext.QUALIFIED + sqltext.CONTAINMENT,
    "bare_extract": sqltext._NAME + sqltext.EXTRACTION, "bare_contain": sqltext._NAME + sqltext.CONTAINMENT,
}.items()}


def _matches(source: str, text: str, pattern: str, *names: str) -> str:
    """Rows of `source` (seq) with one row for each match: pos and the groups by name."""
    groups = ", ".join(f"regexp_extract_all({text}, '{_RE[pattern]}', {i}) as {n}_" for i, n in enumerate(names, 1))
    return f"select seq, generate_subscripts({names[-1]}_, 1) - 1 as pos, {', '.join(f'''coalesce(unnest({n}_), '') as {n}''' for n in names)} from (select seq, {groups} from {source})"


def _resolved(source: str) -> str:
    """Matches s, q, c whose qualifier is known, once each, with the first place."""
    key = "case when m.s = '' then m.q else m.s || '.' || m.q end"
    return f"""select seq, qualifier, table_name, column_name, min(pos) as pos from (
        select m.seq, pos, {key} as qualifier, coalesce(a.canonical, b.canonical) as table_name, c as column_name from ({source}) m
        left join aliases a on a.seq = m.seq and a.q = {key} left join aliases b on b.seq = m.seq and b.q = m.q) where table_name is not null group by all"""


CTES = {
    "query_log": fixtures.duckdb_sql("query_log"),
    "log": "select * from query_log where name is null or name <> 'SCHEMA'",
    "refs": f"select seq, pos, t as name, case when s = '' then t else s || '.' || t end as canonical, case when a = '' or list_contains({list(sqltext.CLAUSES)!r}, upper(a)) then null else a end as alias from ({_matches('log', 'sql', 'tables', 's', 't', 'a')})",
    "aliases": """select seq, q, coalesce(max(canonical) filter (kind = 1), max(canonical) filter (kind = 2)) as canonical from (
        select seq, alias as q, arg_max(canonical, pos) as canonical, 1 as kind from refs where alias is not null group by all
        union all select seq, q, arg_min(canonical, pos), 2 from (select seq, pos, name as q, canonical from refs union all select seq, pos, canonical, canonical from refs) group by all) group by all""",
    "fragments": f"select seq, regexp_extract(sql, '{_RE['where']}', 1) as w, regexp_extract(sql, '{_RE['order']}', 1) as o, sql, duration_ms, explain_sql from log",
    "wheres": _resolved(_matches("fragments", "w", "column", "s", "q", "c")),
    "orders_": _resolved(_matches("fragments", "o", "column", "s", "q", "c")),
    "alone": "select seq, min(canonical) as table_name from aliases group by seq having count(distinct canonical) = 1",
    "json": f"""select seq, table_name, column_name, min(pos) as pos from (
        select seq, table_name, column_name, pos from ({_resolved(_matches('fragments', 'w', 'extract', 's', 'q', 'c'))})
        union all select seq, table_name, column_name, 1000 + pos from ({_resolved(_matches('fragments', 'w', 'contain', 's', 'q', 'c'))})
        union all select seq, table_name, c, 2000 + pos from ({_matches('fragments', 'w', 'bare_extract', 'c')}) join alone using (seq)
        union all select seq, table_name, c, 3000 + pos from ({_matches('fragments', 'w', 'bare_contain', 'c')}) join alone using (seq)) group by all""",
    "context": "select seq, qualifier, list(column_name order by pos) as cols from (select seq, qualifier, column_name, min(pos) as pos from wheres group by all) group by all",
    "seen": """select seq, 'where' as operation, table_name, column_name, cast([] as varchar[]) as where_columns, 0 as part, min(pos) as pos from wheres w
            where not exists (select 1 from json j where j.seq = w.seq and j.table_name = w.table_name and j.column_name = w.column_name) group by all
        union all select seq, 'jsonb_where', table_name, column_name, cast([] as varchar[]), 1, pos from json
        union all select o.seq, 'order', o.table_name, o.column_name, coalesce(cols, cast([] as varchar[])), 2, o.pos from orders_ o left join context c on c.seq = o.seq and c.qualifier = o.qualifier""",
    "observed": "select seq, row_number() over (partition by seq order by part, pos) - 1 as pos, operation, table_name, column_name, where_columns, sql, duration_ms, explain_sql from seen join fragments using (seq)",
    "runtime": """select cast(min(seq * 1000 + pos) as bigint) as seq, table_name, column_name, operation, array_to_string(where_columns, ',') as where_columns, count(*) as count,
        cast(sum(duration_ms) as double) as total_duration_ms, arg_min(sql, seq * 1000 + pos) as source, arg_min(explain_sql, seq * 1000 + pos) filter (explain_sql is not null) as explain_source from observed group by table_name, column_name, operation, where_columns""",
    "plans": fixtures.duckdb_sql("plans"),
    "roots": "select statement, json_extract(plan_json, '$[0].Plan') as p from plans where json_valid(plan_json)",
    "nodes": """select * from roots_walk""",
    "explained": """select statement, 'postgresql plan: ' || concat_ws(' ', root->>'Node Type', 'using ' || (root->>'Index Name'), 'on ' || (root->>'Relation Name'),
            case when len(rpath) > 0 then 'over ' || concat_ws(' ', rel->>'Node Type', 'using ' || (rel->>'Index Name'), 'on ' || (rel->>'Relation Name')) end, 'rows=' || (root->>'Plan Rows'),
            'cost=' || printf('%.2f', cast(root->>'Startup Cost' as double)) || '..' || printf('%.2f', cast(root->>'Total Cost' as double))) as plan_summary,
        root->>'Node Type' as plan_root_node_type, rel->>'Node Type' as plan_relation_node_type, rel->>'Relation Name' as plan_relation_name, cast(root->>'Plan Rows' as bigint) as plan_rows
        from (select statement, p as root from roots where p is not null) left join (select statement, arg_min(p, path) as rel, min(path) as rpath from walk where p->>'Relation Name' is not null group by statement) using (statement)""",
    "source_usages": fixtures.duckdb_sql("source_usages"),
    "usages": """select 0 as late, cast(seq as bigint) as seq, table_name, column_name, operation, '' as where_columns, 'source' as origin, 1 as count, cast(null as double) as total_duration_ms, source, path, line,
            cast(null as varchar) as plan_summary, cast(null as varchar) as plan_root_node_type, cast(null as varchar) as plan_relation_node_type, cast(null as varchar) as plan_relation_name, cast(null as bigint) as plan_rows from source_usages
        union all select 1, seq, table_name, column_name, operation, where_columns, 'runtime', count, total_duration_ms, source, null, null, plan_summary, plan_root_node_type, plan_relation_node_type, plan_relation_name, plan_rows
        from runtime left join explained on statement = trim(coalesce(explain_source, source)) and regexp_matches(trim(coalesce(explain_source, source)), '(?i)^(SELECT|WITH)(\\s|$)')
            and not regexp_matches(coalesce(explain_source, source), '\\$\\d|\\?')""",
} | {f"c_{name}": fixtures.duckdb_sql(name) for name in ("tables", "columns", "indexes", "foreign_keys", "models", "reflections", "enums", "search_path", "migrations", "names")}
CTES["walk"] = """select statement, cast([] as integer[]) as path, p from roots where p is not null
    union all select statement, list_append(path, cast(i as integer)), json_extract(p, '$.Plans[' || i || ']') from walk, unnest(range(cast(coalesce(json_array_length(p, '$.Plans'), 0) as bigint))) as t(i)"""
del CTES["nodes"]
ORDER = ["query_log", "log", "refs", "aliases", "fragments", "wheres", "orders_", "alone", "json", "context", "seen", "observed", "runtime", "plans", "roots", "walk", "explained", "source_usages", "usages"]
CATALOG = [f"c_{n}" for n in ("tables", "columns", "indexes", "foreign_keys", "models", "reflections", "enums", "search_path", "migrations", "names")]


def _with(last: str, query: str, *catalog: str) -> str:
    """`query` below the steps up to `last` and the catalog relations named."""
    steps = ORDER[: ORDER.index(last) + 1] if last else []
    names = [*(f"c_{c}" for c in catalog), *steps]
    return ("with recursive " + ", ".join(f"{n} as ({CTES[n]})" for n in names) + " " if names else "") + query


_PREFIXED = "exists (select 1 from c_indexes i where i.table_name = {t} and i.columns[1:len({c})] = {c})"
_TABLE = "exists (select 1 from c_tables t where t.table_name = x.table_name)"
_COLUMN = "exists (select 1 from c_columns c where c.table_name = x.table_name and c.column_name = x.{c})"
_LEADING = "(exists (select 1 from c_indexes i where i.table_name = x.table_name and i.columns[1] = x.column_name) or exists (select 1 from c_tables t where t.table_name = x.table_name and t.primary_key = [x.column_name]))"
_NAMED = "model || ' ' || macro || ' ' || name"


def _row(code: str, severity: str, source: str, *, model: str = "null", table: str = "x.table_name", column: str = "null", evidence: str, details: str = "null", more: str = "") -> str:
    return f"select '{code}' as code, {severity} as severity, {model} as model, {table} as table_name, {column} as column_name, {evidence} as evidence, {details} as details{more} from {source}"


_TEXT = """case when origin = 'source' then path || ':' || line || ' ' || source else 'runtime x' || count || coalesce(' ' || printf('%.2f', total_duration_ms) || 'ms total', '') || ': ' || source || coalesce(chr(10) || 'plan: ' || plan_summary, '') end"""
_SCAN = "origin = 'runtime' and plan_relation_node_type = 'Seq Scan' and plan_relation_name = table_name and coalesce(plan_rows, 0) >= 10000"
_SORT = "origin = 'runtime' and plan_root_node_type = 'Sort' and coalesce(plan_rows, 0) >= 10000"
_DETAILS = """'{"planner_confirmed":true,"planner_row_threshold":10000,"plan_root_node_type":' || coalesce('"' || plan_root_node_type || '"', 'null') || ',"plan_relation_node_type":' || coalesce('"' || plan_relation_node_type || '"', 'null')
    || ',"plan_relation_name":' || coalesce('"' || plan_relation_name || '"', 'null') || ',"plan_rows":' || coalesce(cast(plan_rows as varchar), 'null') || '}'"""


def _grouped(source: str, confirmed: str) -> str:
    return f"""(select table_name, column_name, sum(count) as uses, case when bool_or(coalesce({confirmed}, false)) then 'high' else 'medium' end as severity,
        array_to_string(list({_TEXT} order by late, seq)[1:3], chr(10)) as evidence, arg_min({_DETAILS}, late * 1000000000000 + seq) filter (origin = 'runtime' and plan_summary is not null) as details
        from ({source}) where table_name is not null and column_name is not null group by table_name, column_name)"""


_MODEL = "(select arg_min(model, seq) from c_models m where m.table_name = g.table_name)"


def _usage_rule(code: str, source: str, confirmed: str, where: str = "true", model: str = _MODEL, join: str = "") -> str:
    return _row(code, "g.severity", f"{_grouped(source, confirmed)} g {join} where {where}", model=model, table="g.table_name", column="g.column_name", evidence="g.evidence", details="g.details")


_JSON_NORMAL = "translate(regexp_replace(replace({}, '::text', ''), '\\s+', '', 'g'), '()', '')"
_SERVED = f"""exists (select 1 from c_indexes i where i.table_name = x.table_name and (
    (list_contains(i.columns, x.column_name) and lower(i.method) in ('gin', 'gist') and regexp_matches(x.source, '\\b' || x.column_name || '\\b\\s*@>'))
    or exists (select 1 from unnest(regexp_extract_all(x.source, x.column_name || '\\s*(?:->>|->)\\s*''(?:[^'']+)''', 0)) f(f), unnest(i.columns) c(c) where contains({_JSON_NORMAL.format('c')}, {_JSON_NORMAL.format('f')}))))"""
_UNSORTED = f"""select * from usages x where operation = 'order' and {_TABLE} and not {_LEADING} and not exists (select 1 from c_indexes i, unnest(range(2, len(i.columns) + 1)) p(p)
    where i.table_name = x.table_name and i.columns[p] = x.column_name and list_position(i.columns, x.column_name) = p and list_has_all(string_split(x.where_columns, ','), i.columns[1:p - 1]))"""
_CATALOG_RULES = {
    "default_scope": (("models",), _row("default_scope", "'medium'", "c_models x where default_scope_count > 0", model="model", evidence="default_scope_count || ' default scope(s)'")),
    "foreign_key_without_index": (("tables", "indexes", "foreign_keys"), _row("foreign_key_without_index", "'high'", f"c_foreign_keys x where {_TABLE} and not {_PREFIXED.format(t='x.table_name', c='x.columns')}", column="array_to_string(columns, ', ')", evidence="array_to_string(columns, ', ') || ' -> ' || to_table")),
    "table_without_primary_key": (("tables",), _row("table_without_primary_key", "'high'", "c_tables x where primary_key is null", evidence="table_name")),
    "table_without_timestamps": (("tables", "columns"), _row("table_without_timestamps", "'low'", "c_tables x where (select count(distinct column_name) from c_columns c where c.table_name = x.table_name and column_name in ('created_at', 'updated_at')) < 2", evidence="table_name")),
}
_TO = "coalesce(nullif(association_primary_key, ''), 'id')"
_BELONGS = "macro = 'belongs_to' and not coalesce(polymorphic, false) and " + _TABLE + " and " + _COLUMN.format(c="foreign_key")
RULE_SQL = {
    "missing_belongs_to_index": ("", ("tables", "columns", "indexes", "reflections"), _row("missing_belongs_to_index", "'high'", f"c_reflections x where {_BELONGS} and not {_PREFIXED.format(t='x.table_name', c='[x.foreign_key]')}", model="model", column="foreign_key", evidence=_NAMED)),
    "missing_foreign_key_constraint": ("", ("tables", "columns", "foreign_keys", "reflections"), _row(
        "missing_foreign_key_constraint", "'high'",
        f"c_reflections x where {_BELONGS} and not exists (select 1 from c_foreign_keys k where k.table_name = x.table_name and k.columns = [x.foreign_key] and k.to_table = x.target_table and coalesce(k.primary_key, '') = {_TO})",
        model="model", column="foreign_key", evidence=_NAMED,
        more=f", 'add_foreign_key :' || x.table_name || ', :' || target_table || case when foreign_key <> regexp_replace(target_table, 's$', '') || '_id' then ', column: :' || foreign_key else '' end || case when {_TO} <> 'id' then ', primary_key: :' || association_primary_key else '' end as recommendation")),
    "missing_polymorphic_composite_index": ("", ("tables", "columns", "indexes", "reflections"), _row(
        "missing_polymorphic_composite_index", "'high'",
        f"c_reflections x where macro = 'belongs_to' and polymorphic and {_TABLE} and {_COLUMN.format(c='foreign_key')} and {_COLUMN.format(c='foreign_type')} and not {_PREFIXED.format(t='x.table_name', c='[x.foreign_type, x.foreign_key]')} and not {_PREFIXED.format(t='x.table_name', c='[x.foreign_key, x.foreign_type]')}",
        model="model", column="foreign_type || ', ' || foreign_key", evidence=_NAMED + " || ' (polymorphic)'")),
    "broad_dependent_destroy": ("", ("tables", "reflections"), _row(
        "broad_dependent_destroy", "'medium'", "c_reflections x join c_tables t on t.table_name = x.target_table where macro = 'has_many' and options['dependent'] = 'destroy' and t.estimated_row_count >= 10000", model="model",
        evidence=_NAMED + " || ' -> ' || target_table || ', about ' || t.estimated_row_count || ' rows'", details="""'{"estimated_row_count":' || t.estimated_row_count || ',"row_threshold":10000,"evidence_source":"estimate"}'""")),
    "missing_inverse_of": ("", ("reflections",), _row(
        "missing_inverse_of", "'medium'", "c_reflections x where macro = 'has_many' and (options['autosave'] = 'true' or options['dependent'] = 'destroy') and not list_contains(map_keys(options), 'inverse_of') and inverse_name is null", model="model",
        evidence=_NAMED + " || ' (' || array_to_string(list_sort(list_transform(list_filter(map_entries(options), lambda e: e.key in ('autosave', 'dependent')), lambda e: e.key || '=' || e.value)), ', ') || ')'")),
    "recurring_where_without_index": ("usages", ("tables", "indexes", "enums", "models"), _usage_rule(
        "recurring_where_without_index", f"select * from usages x where operation = 'where' and {_TABLE} and not {_LEADING} and not exists (select 1 from c_enums e where e.table_name = x.table_name and e.column_name = x.column_name)", _SCAN, "uses >= 2")),
    "enum_where_without_index": ("usages", ("tables", "indexes", "enums"), _usage_rule("enum_where_without_index", f"select * from usages x where operation = 'where' and {_TABLE} and not {_LEADING}", _SCAN, model="e.model", join="join c_enums e on e.table_name = g.table_name and e.column_name = g.column_name")),
    "jsonb_query_without_index": ("usages", ("tables", "indexes", "models"), _usage_rule(
        "jsonb_query_without_index", f"select * from usages y where operation = 'jsonb_where' and exists (select 1 from usages x where x.operation = 'jsonb_where' and x.table_name = y.table_name and x.column_name = y.column_name and {_TABLE} and not {_SERVED})", _SCAN)),
    "order_without_index": ("usages", ("tables", "indexes", "models"), _usage_rule("order_without_index", _UNSORTED, _SORT)),
    "migration_reference_without_foreign_key": ("", ("tables", "columns", "foreign_keys", "migrations"), _row(
        "migration_reference_without_foreign_key", "'high'", f"c_migrations x where {_TABLE} and {_COLUMN.format(c='column_name')} and not exists (select 1 from c_foreign_keys k where k.table_name = x.table_name and k.columns = [x.column_name])", column="column_name", evidence="path || ':' || line || ' ' || source")),
} | {code: ("", *rest) for code, rest in _CATALOG_RULES.items()}

_CATALOG_FINDINGS = " union all ".join(sql for _, sql in _CATALOG_RULES.values())
_FOUR = ("tables", "columns", "indexes", "foreign_keys", "models")
_RANK = "case severity when 'high' then 3 when 'medium' then 2 else 1 end"
_KNOWN = "c_names known"
_BINDS = "case when seq % 5 <> 0 then case seq % 3 when 0 then [cast(seq as varchar)] when 1 then [cast(seq as varchar), '''it''''s $1'''] else [cast(seq as varchar), 'NULL'] end end"


def _values(rows: list[tuple], names: str) -> str:
    def one(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as t({names})"


def _suppressed(rule: dict) -> str:
    names = {"table": "table_name", "column": "column_name"}
    return "(" + " and ".join(f"coalesce({names.get(k, k)}, '') = '{v}'" for k, v in rule.items()) + ")"


def _used(*kinds: tuple) -> str:
    """Usages in the code of some kinds: (kind, ((line, column, operation, filters, source), ...)); # is the model's number and @ the file's."""
    rows = ", ".join("(" + ", ".join([str(kind), str(line), *("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in rest)]) + ")" for kind, found in kinds for line, *rest in found)
    return f"""select 'lib/u' || c || '.rb' as path, cast(line as integer) as line, 't' || m as table_name, x.c1 as column_name, op as operation, replace(w, 'OPENING', case when m % 3 = 1 then 'c' else 'a' end) as where_columns,
        replace(replace(src, '#', cast(m as varchar)), '@', cast(c as varchar)) as source from (select c_custkey as c, c_custkey % (select count(*) from supplier) as m from customer) join (values {rows}) as x(kind, line, c1, op, w, src) on kind = c % 5"""


_FAULTS = f"""
with docs as (select document, cast(text as json) as j from ({fixtures.duckdb_sql("snapshot_documents")})),
heads as (select *, json_type(j, '$.metadata') is not null as headed, cast(j->>'$.metadata.schema_version' as integer) as version from docs),
head as (select document, case when coalesce(json_type(j, '$.query_usages'), '') <> 'ARRAY' then 'must be an object with an array query_usages' when headed and version not in (1, 2) then 'metadata.schema_version must be one of 1, 2'
    when headed and j->>'$.metadata.generator.name' <> 'tablewarden' then 'metadata.generator.name must be one of tablewarden' when headed and json_type(j, '$.metadata.capture.literalized_binds') <> 'BOOLEAN' then 'metadata.capture.literalized_binds must be true or false' end as message from heads),
asked as (select document, version, i, json_extract(j, '$.queries[' || i || ']') as q from heads, unnest(range(cast(coalesce(json_array_length(j, '$.queries'), 0) as bigint))) as t(i)),
used as (select document, version, headed, i, json_extract(j, '$.query_usages[' || i || ']') as u from heads, unnest(range(cast(case when json_type(j, '$.query_usages') = 'ARRAY' then json_array_length(j, '$.query_usages') else 0 end as bigint))) as t(i)),
every as (
    select document, 0 as section, 0 as i, message from head union all
    select document, 1, i, case when json_type(q, '$.sql') <> 'VARCHAR' or json_type(q, '$.duration_ms') not in ('BIGINT', 'UBIGINT', 'DOUBLE') then 'queries[' || i || '] is invalid'
        when version = 2 and cast(q->>'$.duration_ms' as double) < 0 then 'queries[' || i || '].duration_ms must be 0 or more' end from asked union all
    select document, 2, i, case when json_type(u, '$.plan_rows') not in ('NULL', 'BIGINT', 'UBIGINT') then 'query_usages[' || i || '].plan_rows must be an integer or null'
        when json_type(u, '$.where_columns') not in ('NULL', 'ARRAY') then 'query_usages[' || i || '].where_columns must be an array of strings'
        when coalesce(u->>'$.origin', case when headed then '' else 'runtime' end) <> 'runtime' then 'query_usages[' || i || '].origin must be "runtime"'
        when headed and coalesce(json_type(u, '$.path'), '') <> 'NULL' then 'query_usages[' || i || '].path must be present and null' when headed and coalesce(json_type(u, '$.line'), '') <> 'NULL' then 'query_usages[' || i || '].line must be present and null'
        when version = 2 and cast(u->>'$.count' as bigint) < 1 then 'query_usages[' || i || '].count must be 1 or more' end from used
)
select document, arg_min(message, section * 1000000 + i) filter (message is not null) as message from every group by document
"""
#: A lexer of another make: the file is cut at what the generated code holds, without looking around; what a token is follows from its first letters and the one before.
_CUT = r"=begin\n(?:[^=]|=[^e])*=end|#[^\n]*|<<~SQL|\n  d ->>[^\n]*\nSQL|\n| +|%w\[[^\]]*\]|\"[^\"]*\"|'[^']*'|def [a-z.]+\([a-z]\) =|::|:[a-z]+|[a-z]+:|[a-z]+|[A-Z][A-Za-z]*[0-9]*|[0-9]+|->|=>|<<|.".replace("'", "''")
_TOKENS = f"""
with files as (select path, text from ({fixtures.duckdb_sql("user_files")}) union all select path, text from ({fixtures.duckdb_sql("model_files")})),
cut as (select path, unnest(regexp_extract_all(text, '{_CUT}')) as text, generate_subscripts(regexp_extract_all(text, '{_CUT}'), 1) as i from files),
placed as (
    select path, i, text, coalesce(sum(length(text)) over before, 0) as pos, 1 + coalesce(sum(length(text) - length(replace(text, chr(10), ''))) over before, 0) as line
    from cut window before as (partition by path order by i rows between unbounded preceding and 1 preceding)
)
select path, cast(pos as bigint) as pos, cast(line as integer) as line, case when text[1] = '#' or starts_with(text, '=begin') then 'comment' when text = chr(10) then 'newline' when text[1] = chr(10) then 'heredoc' when text = '<<~SQL' then 'heredoc_start'
    when text[1] in ('"', chr(39)) then 'string' when starts_with(text, '%w') then 'words' when starts_with(text, 'def ') then 'endless' when text[1] = ':' and length(text) > 1 and text <> '::' then 'symbol'
    when regexp_matches(text, '^[a-z]+:$') then 'label' when text in ('class', 'def', 'do', 'end', 'if', 'self') then 'keyword' when regexp_matches(text, '^[A-Z]') then 'constant' when regexp_matches(text, '^[a-z]') then 'name'
    when regexp_matches(text, '^[0-9]') then 'number' else 'mark' end as kind, text from placed where trim(text, ' ') <> ''
"""


def oracle_sql() -> dict[str, str]:
    out = {
        "f01_table_refs": _with("refs", "select seq, cast(pos as integer) as pos, name, canonical, alias from refs"),
        "f03_fragments": _with("fragments", "select seq, w as where_fragment, o as order_fragment from fragments"),
        "f05_column_refs": _with("wheres", "select seq, qualifier, table_name, column_name from wheres"),
        "f06_json_refs": _with("json", "select seq, table_name, column_name from json"),
        "f10_literalised": _with("log", f"""select seq, case when b is null then sql when regexp_matches(sql, '\\$\\d') then replace(replace(sql, case when len(b) >= 2 then '$2' else chr(0) end, coalesce(b[2], '')), '$1', b[1])
            when contains(sql, '?') then (select string_agg(part || case when i < n then coalesce(b[i], 'NULL') else '' end, '' order by i) from (select unnest(string_split(sql, '?')) as part, generate_subscripts(string_split(sql, '?'), 1) as i, len(string_split(sql, '?')) as n))
            else sql end as explain_sql from (select *, {_BINDS} as b from log)"""),
        "p27_explainable": _with("query_log", "select seq, regexp_matches(sql, '(?i)^\\s*(SELECT|WITH)(\\s|$)') and not regexp_matches(sql, '\\$\\d') and not contains(sql, '?') as explainable from query_log"),
        "f14_durations": "select event_id, round(cast(round((event_id % 1000) * 1250) as bigint) / 1000.0, 2) as ms from events",
        "f36_order_words": _with("fragments", "select seq, array_to_string(list_filter(list_transform(string_split(trim(o, ' ' || chr(10)), ','), lambda p: regexp_extract(trim(p), '^\\S*')), lambda w: w <> ''), ',') as words from fragments"),
        "a01_usage_counts": _with("runtime", "select * from runtime"),
        "u01_all_usages": _with("usages", "select origin, operation, count(*) as n, cast(sum(count) as bigint) as uses from usages group by all"),
        "f15_names": _with("", f"""select table_name, case when contains(table_name, '.') then split_part(table_name, '.', 1) end as schema_name, regexp_replace(table_name, '^[^.]*\\.', '') as base,
            coalesce((select min(rank) from c_search_path p where p.schema_name = split_part(table_name, '.', 1) and contains(table_name, '.')), 1000000) as rank from {_KNOWN}""", "search_path", "names"),
        "j18_canonical_names": _with("runtime", f"""select seq, case when contains(table_name, '.') then table_name else coalesce((select case when count(*) = 1 then min(k) else arg_min(k, r) filter (r is not null) end from (
            select known.table_name as k, (select rank from c_search_path p where p.schema_name || '.' || regexp_replace(known.table_name, '^[^.]*\\.', '') = known.table_name) as r from {_KNOWN} where regexp_replace(known.table_name, '^[^.]*\\.', '') = runtime.table_name)), table_name) end as table_name,
            '' as plan_relation_name from runtime""", "search_path", "names"),
        "s01_scanned_tables": _with("", "select table_name from (select table_name from c_tables union select table_name from c_models union select 'analytics.part' union select 'other.nation') where table_name not in ('region', 'part')", "tables", "models"),
        "s02_columns": "select table_name, column_name from information_schema.columns where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')",
        "s05_row_estimates": """select * from (select 'orders' as table_name, (select count(*) from orders) + 9 as estimated_row_count union all select 'part', (select count(*) from part) + 6 union all select 'nation', null
            union all select 'public.orders', (select count(*) from orders) + 6 union all select 'other.nation', (select count(*) from nation) + 5 union all select 'nowhere', null)""",
        "s05_statistics": "select 'orders' as table_name, count(*) as estimated_row_count from orders union all select 'part', count(*) from part union all select 'events', count(*) from events union all select 'nation', null",
        "s08_models": _with("", "select cast(min(seq) as bigint) as seq, model, table_name, arg_min(default_scope_count, seq) as default_scope_count, min(source_location) as source_location from c_models group by model, table_name", "models"),
        "o05_plan_summaries": _with("explained", "select * from explained"),
        "j19_annotated_usages": _with("usages", "select table_name, column_name, operation, where_columns, origin, source, plan_summary, plan_root_node_type, plan_relation_node_type, plan_relation_name, plan_rows from usages"),
        "p09_unindexed_columns": _with("", f"select table_name, column_name from c_columns x where not {_PREFIXED.format(t='x.table_name', c='[x.column_name]')}", "columns", "indexes"),
        "p11_leading_columns": _with("", "select distinct table_name, columns[1] as column_name from c_indexes union select table_name, primary_key[1] from c_tables where len(primary_key) = 1", "tables", "indexes"),
        "p13_unsupported_orders": _with("usages", f"select table_name, column_name, where_columns, count from ({_UNSORTED.replace(_TABLE, 'true')}) where origin = 'runtime'", "tables", "indexes"),
        "p22_unserved_json": _with("observed", f"select seq, table_name, column_name from (select *, sql as source from observed) x where operation = 'jsonb_where' and not {_SERVED}", "indexes"),
        "p23_json_fragments": _with("log", f"select seq, array_to_string(list_transform(regexp_extract_all(sql, 'props\\s*(?:->>|->)\\s*''(?:[^'']+)''', 0), lambda f: {_JSON_NORMAL.format('f')}), ',') as fragments, regexp_matches(sql, '\\bprops\\b\\s*@>') as contained from log"),
        "p29_suppressed": _with("", f"select code, severity, model, table_name, column_name from ({_CATALOG_FINDINGS}) where not ({' or '.join(map(_suppressed, SUPPRESS))})", *_FOUR),
        "o01_report_order": _with("", f"select cast(row_number() over (order by {_RANK} desc, code, coalesce(table_name, ''), coalesce(column_name, ''), coalesce(model, ''), evidence) as integer) as place, severity, code, table_name, column_name from ({_CATALOG_FINDINGS})", *_FOUR),
        "s19_report_text": _with("", f"""select code, table_name, '[' || upper(severity) || '] ' || code || ' - t' || coalesce(chr(10) || 'model: ' || model, '') || coalesce(chr(10) || 'table: ' || table_name, '') || coalesce(chr(10) || 'column: ' || column_name, '')
            || chr(10) || 'problem: p' || chr(10) || '  q' || chr(10) || 'recommendation: r' || chr(10) || 'evidence: ' || evidence as body from ({_CATALOG_FINDINGS})""", *_FOUR),
        "s20_fails": _with("", f"select threshold, exists (select 1 from ({_CATALOG_FINDINGS}) where severity <> 'high' and {_RANK} >= r) as fails from (values ('low', 1), ('medium', 2), ('high', 3)) as t(threshold, r)", *_FOUR),
        "s13_snapshot_usages": _with("runtime", "select table_name, column_name, operation, where_columns, count, total_duration_ms, source, 'runtime' as origin from runtime"),
        "f30_snapshot_faults": _FAULTS,
        "x01_source_usages": _values([
            ("app/models/order.rb", 4, "orders", "o_custkey", "where", ""), ("app/models/order.rb", 4, "orders", "o_orderdate", "order", "o_custkey"), ("app/models/order.rb", 4, "orders", "o_totalprice", "order", "o_custkey"),
            ("lib/report.rb", 1, "events", "props", "jsonb_where", ""), ("lib/report.rb", 1, "events", "user_id", "where", ""), ("lib/report.rb", 1, "events", "ts", "order", "user_id"), ("lib/report.rb", 1, "events", "event_id", "order", "user_id"),
            ("lib/report.rb", 3, "customer", "c_name", "order", ""),
        ], "path, line, table_name, column_name, operation, where_columns") + """
            union all select path, cast(case k when 0 then 2 when 1 then 1 else 1 + n % 3 end as integer), t, c, op, w from (select c_custkey as n, c_custkey % 4 as k, 'gen/' || c_custkey || '.rb' as path from customer)
            join (values (0, 'orders', 'o_custkey', 'where', ''), (1, 'events', 'user_id', 'where', ''), (1, 'events', 'ts', 'order', 'user_id'), (3, 'customer', 'c_name', 'where', ''), (3, 'customer', 'c_acctbal', 'where', ''),
                (3, 'customer', 'c_name', 'order', 'c_name,c_acctbal')) as x(kind, t, c, op, w) on kind = k""",
        "x03_tokens": _TOKENS,
        "x04_local_variables": _used((0, ((1, "a", "where", "", "Gen::M#.where(a: @)"), (3, "b", "order", "a", "rel.order(:b)"))), (1, (
            (2, "a", "where", "", "Gen::M#.where a: 1"), (4, "b", "where", "", "rel.where(b: row)"), (5, "c", "order", "a,b", "rel.order('c DESC, d')"), (5, "d", "order", "a,b", "rel.order('c DESC, d')"), (8, "c", "order", "a", "rel\n    .order(:c)")))),
        "x05_named_scopes": _used((2, ((1, "b", "order", "OPENING,b", "Gen::M#.both.order(:b)"), (2, "d", "order", "d,OPENING", "Gen::M#.short(1).opening.reorder(d: :desc)")))) + """
            union all select 'app/models/m' || m || '.rb', cast(line as integer), 't' || m, c, op, replace(w, 'OPENING', case when m % 3 = 1 then 'c' else 'a' end), replace(source, '@', cast(m as varchar)) from (select s_suppkey as m from supplier)
            join (values (3, 'a', 'where', '', 'where(a: @)', false), (4, 'c', 'order', 'OPENING,b', 'opening.where(b: 1).order(:c)', false), (4, 'b', 'where', '', 'opening.where(b: 1)', false), (7, 'c', 'where', '', 'later(x).where(c: x)', false),
                (11, 'b', 'where', '', 'where(b: y)', false), (18, 'a', 'where', '', 'again.where("a" => 1)', false), (20, 'd', 'where', '', 'where(d: z, gone: 1)', false), (24, 'a', 'where', '', 'where a: @', false),
                (27, 'c', 'where', '', 'where(c: 1)', true)) as x(line, c, op, w, source, more) on not more or m % 3 = 1""",
        "x06_helpers": _used((3, ((1, "b", "order", "b,c", "Gen::M#.named(@).reorder(b: :desc)"),)), (4, ((1, "c", "order", "a", "Gen::M#.where(<<~SQL, @).again.order(:c)"), (1, "d", "jsonb_where", "", "Gen::M#.where(<<~SQL, @)")))),
        "x02_migration_changes": _values([
            ("db/migrate/1.rb", 3, "orders", "customer_id", "add_reference :orders, :customer"), ("db/migrate/1.rb", 6, "nation", "region_id", "add_column :nation, :region_id, :bigint"), ("db/migrate/2.rb", 4, "notes", "author_id", "t.references :author"),
        ], "path, line, table_name, column_name, source") + """
            union all select 'gen/' || p_partkey || '.rb', cast(case p_partkey % 4 when 0 then 2 when 2 then 3 else 1 end as integer), 't' || p_partkey, case p_partkey % 4 when 2 then 'author_id' else 'owner_id' end,
                case p_partkey % 4 when 0 then 'add_reference :t' || p_partkey || ', :owner' when 2 then 't.references :author' else 'add_column :t' || p_partkey || ', :owner_id, :bigint' end from part where p_partkey % 4 <> 1""",
        "s09_model_relations": """select 'M' || k as model, cast(k % 4 as integer) as default_scope_count, case when k % 3 > 0 then 'r' || k end as name, case when k % 3 > 0 then if(k % 2 = 0, 'has_many', 'belongs_to') end as macro,
            case when k % 3 > 0 then 't' || k end as target_table, case when k % 3 > 0 then k % 5 = 0 end as polymorphic, case when k % 7 = 0 then 'state' end as enum from (select c_custkey as k from customer)""",
        "s17_snapshot_round_trip": _with("runtime", "select table_name, column_name, operation, where_columns, count, total_duration_ms, source, explain_source from runtime"),
        "s18_report_findings": _with("", f"""select cast(row_number() over (order by {_RANK} desc, code, coalesce(table_name, ''), coalesce(column_name, ''), coalesce(model, ''), evidence) as integer) as place, severity, code, table_name,
            count(*) over (partition by severity) as of_severity from ({_CATALOG_FINDINGS})""", *_FOUR),
        "st03_stream_usages": _with("runtime", "select table_name, column_name, operation, where_columns, count, total_duration_ms, source, explain_source from runtime"),
    }
    out["st03_running_usages"] = out["st03_stream_usages"]
    out["s15_growing_log"] = out["st03_stream_usages"].replace(", source, explain_source from runtime", ", source from runtime")
    out["st05_session_while_running"] = out["st03_stream_usages"].replace(CTES["log"], "select * from query_log where seq % 2 = 0 and (name is null or name <> 'SCHEMA')")
    every = " union all ".join(sql.replace(", 'add_foreign_key", " --").split(" --")[0] + (" from " + sql.split(" as recommendation from ")[1] if " as recommendation from " in sql else "") for _, _, sql in RULE_SQL.values())
    out["a07_severity_counts"] = _with("usages", f"select severity, count(*) as n from ({every}) group by severity", "tables", "columns", "indexes", "foreign_keys", "models", "reflections", "enums", "migrations")
    for i, code in enumerate(RULES, 1):
        last, catalog, sql = RULE_SQL[code]
        out[f"r{i:02}_{code}"] = _with(last, sql, *catalog)
    return out
