"""Evidence derived from the driver's tables, as SQL that Spark and DuckDB both read.

``list(...)`` is an array and ``dict(list(keys), list(values))`` a map; `spark_sql`
and `duckdb_sql` spell them for either engine.  Only inputs are shared; the
operators and their SQL twins are written apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .evidence import Evidence
from .operators.usages import runtime_usages
from .plans.explain import annotated
from .schemas import SCHEMAS, empty

Q = "chr(39)"
QUERY_LOG = f"""
select event_id as seq,
    case event_type
    when 'view' then case when event_id % 2 = 0
        then 'SELECT "orders".* FROM "orders" WHERE "orders"."o_custkey" = ' || cast(user_id as varchar(20)) || ' ORDER BY "orders"."o_orderdate" DESC LIMIT 10'
        else 'SELECT o.* FROM orders o WHERE o.o_orderstatus = ' || {Q} || 'F' || {Q} || ' AND o.o_custkey = ' || cast(user_id as varchar(20)) || ' ORDER BY o.o_orderdate' end
    when 'click' then case when event_id % 2 = 0
        then 'SELECT l.* FROM lineitem l INNER JOIN orders AS o ON o.o_orderkey = l.l_orderkey WHERE l.l_partkey = ' || cast(user_id as varchar(20)) || ' AND o.o_clerk = 1 LIMIT 5'
        else 'SELECT l.* FROM lineitem AS l WHERE l.l_suppkey = ' || cast(user_id as varchar(20)) || ' AND l.l_shipmode = 2 ORDER BY l.l_shipdate, l.l_suppkey' end
    when 'purchase' then case when event_id % 2 = 0
        then 'UPDATE orders SET o_totalprice = 1 WHERE orders.o_orderkey = ' || cast(user_id as varchar(20))
        else 'UPDATE "customer" SET c_acctbal = 0 WHERE "customer"."c_custkey" = ' || cast(user_id as varchar(20)) || ' AND "customer"."c_mktsegment" = ' || {Q} || 'X' || {Q} end
    when 'error' then case when event_id % 2 = 0
        then 'SELECT * FROM events WHERE props ->> ' || {Q} || 'k' || {Q} || ' = ' || {Q} || cast(event_id % 9 as varchar(20)) || {Q} || ' AND events.user_id = 1 ORDER BY events.ts'
        else 'SELECT * FROM events e WHERE e.props @> ' || {Q} || '{{"k": 5}}' || {Q} || ' AND e.props = 1' end
    else case event_id % 7
        when 0 then 'BEGIN'
        when 1 then 'SELECT * FROM public.orders WHERE public.orders.o_custkey = 1 ORDER BY orders.o_orderdate'
        when 2 then 'SELECT * FROM part JOIN supplier ON supplier.s_suppkey = part.p_partkey WHERE supplier.s_name = 1 AND part.p_size = 2'
        when 3 then 'SELECT * FROM customer c WHERE c.c_nationkey = $1 AND c.c_name = $2'
        when 4 then 'SELECT * FROM part p WHERE p.p_size = ? AND p.p_brand = ?'
        when 5 then 'SELECT * FROM customer a, customer b WHERE a.c_custkey = 1 AND b.c_name = 2 ORDER BY a.c_name'
        else 'SELECT * FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey' || chr(10) || 'WHERE n.n_name = 1 AND n.n_regionkey = 3' || chr(10) || 'order by n.n_regionkey, n.n_name offset 2' end end as sql,
    case when event_id % 10 = 3 then 'SCHEMA' when event_id % 10 = 4 then null else 'Load' end as name,
    cast(cast(round(value * 100) as bigint) as decimal(18,2)) / 100 as duration_ms,
    case when event_type = 'purchase' and event_id % 3 = 0 then 'SELECT 1 FROM orders' end as explain_sql,
    ts
from events
"""

TABLES = """
select 'region' as table_name, list('r_regionkey') as primary_key, (select count(*) from region) as estimated_row_count
union all select 'nation', list('n_nationkey'), (select count(*) from nation)
union all select 'customer', list('c_custkey'), (select count(*) from customer)
union all select 'supplier', list('s_suppkey'), (select count(*) from supplier)
union all select 'part', list('p_partkey'), (select count(*) from part)
union all select 'orders', list('o_orderkey'), (select count(*) from orders)
union all select 'lineitem', list('l_orderkey', 'l_linenumber'), (select count(*) from lineitem)
union all select 'events', null, (select count(*) from events)
union all select 'accounts', list('id'), null
union all select 't' || cast(s_suppkey as varchar(20)), case when s_suppkey % 5 = 0 then null else list('id') end, cast(s_suppkey * 700 as bigint) from supplier
"""
COLUMNS = """
select * from (values ('region', 'r_regionkey'), ('region', 'r_name'), ('nation', 'n_nationkey'), ('nation', 'n_name'), ('nation', 'n_regionkey'), ('customer', 'c_custkey'), ('customer', 'c_name'),
    ('customer', 'c_nationkey'), ('customer', 'c_acctbal'), ('customer', 'c_mktsegment'), ('supplier', 's_suppkey'), ('supplier', 's_name'), ('supplier', 's_nationkey'), ('part', 'p_partkey'), ('part', 'p_size'),
    ('part', 'p_brand'), ('orders', 'o_orderkey'), ('orders', 'o_custkey'), ('orders', 'o_orderstatus'), ('orders', 'o_totalprice'), ('orders', 'o_orderdate'), ('lineitem', 'l_orderkey'), ('lineitem', 'l_partkey'),
    ('lineitem', 'l_suppkey'), ('lineitem', 'l_linenumber'), ('lineitem', 'l_shipdate'), ('events', 'event_id'), ('events', 'user_id'), ('events', 'event_type'), ('events', 'props'), ('events', 'ts'),
    ('accounts', 'id'), ('accounts', 'created_at'), ('accounts', 'updated_at'), ('accounts', 'owner_type'), ('accounts', 'owner_id'), ('part', 'created_at')) as t(table_name, column_name)
union all select 't' || cast(s_suppkey as varchar(20)), c from supplier cross join (values (1, 'id'), (1, 'status'), (1, 'owner_id'), (2, 'owner_type'), (3, 'created_at'), (4, 'updated_at')) as x(k, c) where k = 1 or s_suppkey % k > 0
"""
INDEXES = """
select 'orders' as table_name, 'orders_custkey' as index_name, list('o_custkey') as columns, 'btree' as method
union all select 'orders', 'orders_status_date', list('o_orderstatus', 'o_orderdate'), 'btree'
union all select 'lineitem', 'lineitem_part_supp', list('l_partkey', 'l_suppkey'), 'btree'
union all select 'nation', 'nation_region_name', list('n_regionkey', 'n_name'), null
union all select 'accounts', 'accounts_owner', list('owner_id', 'owner_type'), 'btree'
union all select 'events', 'events_props', list('props'), 'GIN'
union all select 'events', 'events_other', list('(props ->> ''other''::text)'), 'btree'
union all select 't' || cast(s_suppkey as varchar(20)), 'i' || cast(s_suppkey as varchar(20)), case s_suppkey % 4 when 0 then list('owner_id') when 1 then list('owner_type', 'owner_id') else list('status', 'owner_id') end, case when s_suppkey % 3 = 0 then 'btree' end from supplier where s_suppkey % 3 < 2
"""
FOREIGN_KEYS = """
select 'nation' as table_name, 'nation_region' as fk_name, 'region' as to_table, list('n_regionkey') as columns, 'r_regionkey' as primary_key
union all select 'orders', 'orders_customer', 'customer', list('o_custkey'), 'c_custkey'
union all select 'lineitem', 'lineitem_orders', 'orders', list('l_orderkey'), 'o_orderkey'
union all select 'supplier', 'supplier_nation', 'nation', list('s_nationkey'), null
union all select 'lineitem', 'lineitem_pair', 'part', list('l_suppkey', 'l_partkey'), 'p_partkey'
union all select 't' || cast(s_suppkey as varchar(20)), 'k' || cast(s_suppkey as varchar(20)), 't' || cast(s_suppkey + 1 as varchar(20)), list('owner_id'), case when s_suppkey % 4 < 2 then 'id' end from supplier where s_suppkey % 2 = 0
"""
MODELS = """
select * from (values (1, 'Customer', 'customer', 0, 'app/models/customer.rb'), (2, 'Order', 'orders', 1, null), (3, 'LineItem', 'lineitem', 0, null), (4, 'Event', 'events', 2, null),
    (5, 'ArchivedOrder', 'orders', 0, null), (6, 'Account', 'accounts', 0, null), (7, 'Ghost', 'ghosts', 3, null), (8, 'Customer', 'customer', 5, null)) as t(seq, model, table_name, default_scope_count, source_location)
union all select 100 + s_suppkey, 'M' || cast(s_suppkey as varchar(20)), 't' || cast(s_suppkey as varchar(20)), s_suppkey % 3, 'app/models/m' || cast(s_suppkey as varchar(20)) || '.rb' from supplier
"""
REFLECTIONS = """
select 1 as seq, 'Customer' as model, 'customer' as table_name, 'orders' as name, 'has_many' as macro, dict(list('dependent'), list('destroy')) as options, 'o_custkey' as foreign_key, null as foreign_type, 'orders' as target_table, false as polymorphic, 'customer' as inverse_name, null as association_primary_key
union all select 2, 'Order', 'orders', 'customer', 'belongs_to', dict(list('a'), list('b')), 'o_custkey', null, 'customer', false, null, 'c_custkey'
union all select 3, 'LineItem', 'lineitem', 'part', 'belongs_to', dict(list('a'), list('b')), 'l_partkey', null, 'part', false, null, ''
union all select 4, 'LineItem', 'lineitem', 'supplier', 'belongs_to', dict(list('a'), list('b')), 'l_suppkey', null, 'supplier', false, null, 's_suppkey'
union all select 5, 'Event', 'events', 'subject', 'belongs_to', dict(list('polymorphic'), list('true')), 'user_id', 'event_type', null, true, null, null
union all select 6, 'Account', 'accounts', 'owner', 'belongs_to', dict(list('polymorphic'), list('true')), 'owner_id', 'owner_type', null, true, null, null
union all select 7, 'Order', 'orders', 'line_items', 'has_many', dict(list('autosave'), list('true')), 'l_orderkey', null, 'lineitem', false, null, null
union all select 8, 'Customer', 'customer', 'notes', 'has_many', dict(list('dependent', 'inverse_of'), list('destroy', 'x')), 'customer_id', null, 'notes', false, null, null
union all select 9, 'Event', 'events', 'user', 'belongs_to', dict(list('a'), list('b')), 'user_id', null, 'customer', false, null, null
union all select 10, 'Order', 'orders', 'gone', 'belongs_to', dict(list('a'), list('b')), 'gone_id', null, 'customer', false, null, null
union all select 11, 'Customer', 'customer', 'events', 'has_many', dict(list('dependent'), list('destroy')), 'user_id', null, 'events', false, null, null
union all select 100 + s_suppkey, 'M' || cast(s_suppkey as varchar(20)), 't' || cast(s_suppkey as varchar(20)), 'owner', case when s_suppkey % 7 = 6 then 'has_many' else 'belongs_to' end, dict(list('dependent'), list(case when s_suppkey % 2 = 0 then 'destroy' else 'x' end)), 'owner_id',
    case when s_suppkey % 3 = 1 then 'owner_type' end, 't' || cast(s_suppkey + 1 as varchar(20)), s_suppkey % 3 = 1, case when s_suppkey % 5 = 1 then 'm' end, case when s_suppkey % 4 > 1 then 'uuid' else 'id' end from supplier
"""
ENUMS = "select * from (values ('Customer', 'customer', 'c_mktsegment'), ('Order', 'orders', 'o_orderstatus'), ('ArchivedCustomer', 'customer', 'c_mktsegment'), ('Part', 'part', 'p_size')) as t(model, table_name, column_name)"
NAMES = """
select distinct table_name from (
    select * from (values ('analytics.orders'), ('archive.orders'), ('public.orders'), ('archive.lineitem'), ('public.part'), ('analytics.part'), ('x.events'), ('y.events'), ('customer')) as t(table_name)
    union all select case s_suppkey % 4 when 0 then 'public.' when 1 then 'analytics.' when 2 then 's' || cast(s_suppkey as varchar(20)) || '.' else '' end || 't' || cast(s_suppkey % 50 as varchar(20)) from supplier) as n
"""
SEARCH_PATH = "select * from (values (0, 'analytics'), (1, 'public')) as t(rank, schema_name)"
MIGRATIONS = """
select * from (values (1, 'orders', 'o_custkey', 'db/1.rb', 3, 'add_reference :orders, :o_custkey'), (2, 'lineitem', 'l_suppkey', 'db/2.rb', 4, 'add_reference :lineitem, :l_suppkey'), (3, 'ghosts', 'user_id', 'db/3.rb', 5, 'x'),
    (4, 'orders', 'gone_id', 'db/4.rb', 6, 'y'), (5, 'supplier', 's_nationkey', 'db/5.rb', 7, 'z')) as t(seq, table_name, column_name, path, line, source)
union all select 100 + s_suppkey, 't' || cast(s_suppkey * 2 as varchar(20)), case when s_suppkey % 3 = 0 then 'owner_id' else 'status' end, 'db/g' || cast(s_suppkey as varchar(20)) || '.rb', s_suppkey % 40, 'add_reference ' || cast(s_suppkey as varchar(20)) from supplier
"""
SOURCE_USAGES = """
select * from (values (1, 'part', 'p_brand', 'where', 'Part.where(p_brand: 1)', 'app/models/part.rb', 7), (2, 'part', 'p_brand', 'where', 'Part.where(p_brand: 2)', 'app/models/part.rb', 9), (3, 'customer', 'c_mktsegment', 'where', 'x', 'lib/a.rb', 1),
    (4, 'supplier', 's_name', 'order', 'y', 'lib/b.rb', 2), (5, null, 's_name', 'where', 'z', 'lib/c.rb', 3), (6, 'ghosts', 'a', 'where', 'w', 'lib/d.rb', 4)) as t(seq, table_name, column_name, operation, source, path, line)
"""
#: Source files and migrations by rule, one for each customer and each part.
SOURCE_FILES = """
select 'gen/' || cast(c_custkey as varchar(20)) || '.rb' as path, case c_custkey % 4
    when 0 then 'class A' || chr(10) || '  Order.where(o_custkey: ' || cast(c_custkey as varchar(20)) || ', gone: 1)' || chr(10) || 'end'
    when 1 then 'Event.where(user_id: ' || cast(c_custkey as varchar(20)) || ').order("ts DESC")'
    when 2 then '# Order.where(o_custkey: 1)' || chr(10) || 'Ghost.where(a: ' || cast(c_custkey as varchar(20)) || ')'
    else repeat(chr(10), cast(c_custkey % 3 as int)) || 'Customer.where(c_name: 1,' || chr(10) || '  c_acctbal: ' || cast(c_custkey as varchar(20)) || ').reorder(:c_name)' end as text
from customer
"""
MIGRATION_FILES = """
select 'gen/' || cast(p_partkey as varchar(20)) || '.rb' as path, case p_partkey % 4
    when 0 then 'class M' || chr(10) || '  add_reference :t' || cast(p_partkey as varchar(20)) || ', :owner' || chr(10) || 'end'
    when 1 then 'add_reference :t' || cast(p_partkey as varchar(20)) || ', :owner, foreign_key: true'
    when 2 then 'create_table :t' || cast(p_partkey as varchar(20)) || ' do |t|' || chr(10) || '  t.string :name' || chr(10) || '  t.references :author' || chr(10) || 'end'
    else 'add_column :t' || cast(p_partkey as varchar(20)) || ', :owner_id, :bigint' end as text
from part
"""


def _text(template: str, key: str) -> str:
    """A text as an expression: @ stands for the number `key`."""
    quoted = "'" + template.replace("'", "' || chr(39) || '").replace("\n", "' || chr(10) || '").replace("@", f"' || cast({key} as varchar(20)) || '") + "'"
    return quoted.replace(" || '' ||", " ||")


#: An application by rule: a model for each supplier, with scopes and helpers, and code of five kinds that uses them, a file for each customer.
MODEL = """class Gen::M@ < Base
  # scope :hidden, -> { where(c: 1) }
  scope :opening, -> { where(a: @) }
  scope :both, -> { opening.where(b: 1).order(:c) }
  def self.named(x)
    note = %w[where a]
    later(x).where(c: x)
  end

  def self.later(y)
    where(b: y)
  end
=begin
  def self.later(y) = where(a: y)
=end
  class << self
    def again
      again.where("a" => 1)
    end
    def short(z) = where(d: z, gone: 1)
  end
  def helper(other)
    other.order(:a)
    where a: @ if other
  end
"""
CODE = (
    "rel = Gen::M#.where(a: @)\nputs \"rel.where(b: 1) # no\"\nrel.order(:b)\nrel = 5\nrel.order(:a)\n",
    "def run(list)\n  rel = Gen::M#.where a: 1\n  list.each do |row|\n    rel = rel.where(b: row) # where(d: 1)\n    rel.order('c DESC, d')\n  end\n  list.map { |rel| rel.order(:d) }\n  rel\n    .order(:c)\nend\n",
    "Gen::M#.both.order(:b)\nGen::M#.short(1).opening.reorder(d: :desc)\nGhost.both.order(:b)\n",
    "Gen::M#.named(@).reorder(b: :desc)\n",
    "Gen::M#.where(<<~SQL, @).again.order(:c)\n  d ->> 'k' = ?\nSQL\n",
)
MODEL_FILES = f"""
select 'app/models/m' || cast(s_suppkey as varchar(20)) || '.rb' as path, {_text(MODEL, 's_suppkey')} || case when s_suppkey % 3 = 1 then {_text("  scope :opening do", "s_suppkey")} || chr(10) || '    where(c: 1)' || chr(10) || '  end' || chr(10) else '' end || 'end' as text
from supplier
"""
USER_FILES = f"""
select 'lib/u' || cast(c as varchar(20)) || '.rb' as path, c, m, case c % 5 {' '.join(f"when {i} then replace({_text(t, 'c')}, chr(35) || '.', cast(m as varchar(20)) || '.')" for i, t in enumerate(CODE))} end as text
from (select c_custkey as c, c_custkey % n as m from customer cross join (select count(*) as n from supplier) as s) as u
"""
CODE_MODELS = "select s_suppkey as seq, 'Gen::M' || cast(s_suppkey as varchar(20)) as model, 't' || cast(s_suppkey as varchar(20)) as table_name, 'app/models/m' || cast(s_suppkey as varchar(20)) || '.rb' as source_location from supplier"
CODE_COLUMNS = "select k as seq, 't' || cast(s_suppkey as varchar(20)) as table_name, c as column_name, case when c = 'd' then 'jsonb' else 'bigint' end as sql_type from supplier cross join (values (1, 'id'), (2, 'a'), (3, 'b'), (4, 'c'), (5, 'd')) as x(k, c)"
_NODE = '{"Node Type": "%s"%s, "Plan Rows": %d, "Startup Cost": %s, "Total Cost": %s}'
#: Plan documents by a part of the statement that they answer.
PLANS = """
select sql as statement, case
    when sql like '%FROM customer c %' then '[{"Plan": {"Node Type": "Seq Scan", "Relation Name": "customer", "Plan Rows": 50000, "Startup Cost": 0.0, "Total Cost": 12.346}}]'
    when sql like '%"customer"%' then '[{"Plan": {"Node Type": "ModifyTable", "Plan Rows": 20000, "Plans": [{"Node Type": "Result", "Plans": [{"Node Type": "Index Scan", "Index Name": "i"}]}, {"Node Type": "Seq Scan", "Relation Name": "customer", "Plan Rows": 7}]}}]'
    when sql like '%FROM nation n%' then '[{"Plan": {"Node Type": "Sort", "Plan Rows": 10000, "Startup Cost": 1.5, "Total Cost": 2, "Plans": [{"Node Type": "Index Scan", "Index Name": "n_pk", "Relation Name": "nation"}]}}]'
    when sql like '%FROM lineitem AS l%' then '[{"Plan": {"Node Type": "Sort", "Plan Rows": 12000, "Plans": [{"Node Type": "Seq Scan", "Relation Name": "lineitem", "Plan Rows": 12000}]}}]'
    when sql like '%e.props @>%' then '[{"Plan": {"Node Type": "Limit", "Plan Rows": 5, "Total Cost": 3, "Plans": [{"Node Type": "Sort", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "events"}]}]}}]'
    when sql like '%FROM "orders"%' then 'not json'
    when sql like '%FROM public.orders%' then '[]' end as plan_json
from (select distinct sql from query_log) as s
"""
_META = '"metadata": {"schema_version": %s, "generator": {"name": "tablewarden", "version": "1"}, "capture": {"literalized_binds": %s}}, "queries": [%s]'
_USE = '{"table": "t", "column": "c", "operation": "where", "source": "s", "origin": "runtime", "count": 1, "path": null, "line": null%s}'
#: Snapshot documents, valid and with one fault each, by name.
DOCUMENTS = {
    "valid": "{%s, \"query_usages\": [%s]}" % (_META % ("2", "true", '{"sql": "x", "name": null, "duration_ms": 1.5, "explain_sql": null}'), _USE % ""),
    "legacy": '{"query_usages": [{"table": "t", "column": "c", "operation": "where", "source": "s", "count": 1}]}',
    "no_usages": '{"query_usages": 3}',
    "version": "{%s, \"query_usages\": []}" % (_META % ("99", "true", "")),
    "generator": '{"metadata": {"schema_version": 2, "generator": {"name": "other", "version": "1"}, "capture": {"literalized_binds": true}}, "queries": [], "query_usages": []}',
    "flag": "{%s, \"query_usages\": []}" % (_META % ("2", '"no"', "")),
    "query": "{%s, \"query_usages\": []}" % (_META % ("2", "true", '{"sql": "x", "duration_ms": -1}')),
    "query_v1": "{%s, \"query_usages\": []}" % (_META % ("1", "true", '{"sql": "x", "duration_ms": -1}')),
    "shape": "{%s, \"query_usages\": []}" % (_META % ("2", "true", '{"sql": 1, "duration_ms": 1}')),
    "origin": "{%s, \"query_usages\": [%s]}" % (_META % ("2", "true", ""), (_USE % "").replace('"runtime"', '"source"')),
    "where": "{%s, \"query_usages\": [%s]}" % (_META % ("2", "true", ""), _USE % ', "where_columns": "a"'),
    "count": "{%s, \"query_usages\": [%s, %s]}" % (_META % ("2", "true", ""), _USE % "", (_USE % "").replace('"count": 1', '"count": 0')),
    "path": "{%s, \"query_usages\": [%s]}" % (_META % ("2", "true", ""), (_USE % "").replace('"path": null, ', "")),
    "rows": "{%s, \"query_usages\": [%s]}" % (_META % ("2", "true", ""), _USE % ', "plan_rows": 1.5'),
}
#: One for each part, in turn; statements and tables are named by its number, and usages stand as often as it says.
_KIND = " ".join(f"when {i} then {_text(text.replace(chr(34) + 'x' + chr(34), chr(34) + 'x@' + chr(34)).replace(': ' + chr(34) + 't' + chr(34), ': ' + chr(34) + 't@' + chr(34)), 'p_partkey')}" for i, text in enumerate(DOCUMENTS.values()))
SNAPSHOT_DOCUMENTS = f"select p_partkey as document, case p_partkey % {len(DOCUMENTS)} {_KIND} end as text from part"
RELATIONS = {
    "query_log": QUERY_LOG, "tables": TABLES, "columns": COLUMNS, "indexes": INDEXES, "foreign_keys": FOREIGN_KEYS, "models": MODELS, "reflections": REFLECTIONS, "enums": ENUMS,
    "search_path": SEARCH_PATH, "names": NAMES, "migrations": MIGRATIONS, "source_usages": SOURCE_USAGES, "plans": PLANS, "source_files": SOURCE_FILES, "migration_files": MIGRATION_FILES,
    "snapshot_documents": SNAPSHOT_DOCUMENTS, "model_files": MODEL_FILES, "user_files": USER_FILES, "code_models": CODE_MODELS, "code_columns": CODE_COLUMNS,
}


def duckdb_sql(name: str) -> str:
    return re.sub(r"\bdict\(", "map(", re.sub(r"\blist\(", "list_value(", RELATIONS[name]))


def spark_sql(name: str) -> str:
    text = re.sub(r"\bdict\(", "map_from_arrays(", re.sub(r"\blist\(", "array(", RELATIONS[name]))
    return text.replace("''", "\\'") if name == "indexes" else text


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation of RELATIONS, with the columns of its schema; columns that it lacks are null."""
    from pyspark.sql import functions as F

    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(set(re.findall(r"\bfrom (region|nation|customer|supplier|part|orders|lineitem|events)\b", RELATIONS[name])))}
    if "query_log" in RELATIONS[name] and name != "query_log":
        views["query_log"] = relation(spark, sf_dir, "query_log")
    text = spark_sql(name)
    for view in views:
        text = re.sub(rf"\bfrom {view}\b", f"from {{{view}}}", text)
    escaped = re.sub(r"\{(?!(?:" + "|".join(views or ["-"]) + r")\})", "{{", text)
    escaped = re.sub(r"(?<!\{" + r")\}", "}}", escaped) if not views else _close(escaped, tuple(views))
    found = spark.sql(escaped, **views) if views else spark.sql(text)
    if name not in SCHEMAS:
        return found
    target = empty(spark, name).schema
    return found.select(*[(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def _close(text: str, views: tuple[str, ...]) -> str:
    """Closing braces doubled, but for those of view names."""
    return re.sub(r"(\{(?:" + "|".join(views) + r")\})|\}", lambda m: m[1] or "}}", text)


def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source usages, then those of the query log with their plans; counted once, for all that read them."""
    from pyspark.sql import functions as F

    from .operators.usages import all_usages
    from .schemas import columns
    from .workspace import saved

    counted = saved(runtime_usages(relation(spark, sf_dir, "query_log")), "usages")
    runtime = saved(annotated(counted, relation(spark, sf_dir, "plans")), "usages")
    given = relation(spark, sf_dir, "source_usages").withColumns({"origin": F.lit("source"), "count": F.lit(1).cast("bigint"), "where_columns": F.array().cast("array<string>")})
    target = {f.name: f.dataType for f in empty(spark, "usages").schema}
    source = given.select(*[(F.col(c) if c in given.columns else F.lit(None)).cast(target[c]).alias(c) for c in columns("usages")])
    return all_usages(source, runtime)


def evidence(spark: SparkSession, sf_dir: str, *names: str) -> Evidence:
    """Evidence of the relations in `names`; the others are empty."""
    return Evidence.of(spark, **{n: usages(spark, sf_dir) if n == "usages" else relation(spark, sf_dir, n) for n in names})
