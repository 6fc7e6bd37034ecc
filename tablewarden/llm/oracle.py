"""DuckDB twins of those queries that SQL can express, written independently of the operators.

Training, posteriors and forests (1, 3, 6, 10 and the pipeline) have none; tests hold
them against brute-force versions or held-out labels.
"""

from __future__ import annotations

#: Blanks, as DuckDB's trim takes them.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
with recursive words as (
    select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents
), sets as (
    select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [w]
        else list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) end) as s from words
), sizes as (select doc_id, cast(len(s) as bigint) as n from sets),
items as (select doc_id, hash(unnest(s)) as h from sets),
shared as (
    select a.doc_id as x, b.doc_id as y, count(*) as c from items a join items b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2
), links as (
    select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)
), both_ways as (select x, y from links union select y, x from links),
reach as (
    select x, y from both_ways
    union
    select r.x, b.y from reach r join both_ways b on r.y = b.x
), lowest as (select x, min(least(x, y)) as low from reach group by x)
select doc_id, n as n_shingles, coalesce(low, doc_id) as component_id, coalesce(low, doc_id) = doc_id as kept
from sizes left join lowest on x = doc_id
"""

DECONTAMINATION = """
with docs as (select doc_id, row_number() over () as rid, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') as w from documents),
items as (select item_id, w, least(len(w), 5) as k from (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') as w from benchmark) where len(w) > 0),
grams as (select item_id, k, len(w) - k + 1 as m, unnest(list_transform(range(1, len(w) - k + 2), lambda i: hash(w[i:i + k - 1]))) as g from items),
wanted as (select item_id, k, m, g, count(*) as n from grams group by all),
pieces as (select doc_id, rid, k, len(w) - k + 1 as total, unnest(range(0, len(w) - k + 1)) as pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: hash(w[i:i + k - 1]))) as g
    from docs, (select distinct k from items) where len(w) >= k),
starts as (select distinct p.rid, p.doc_id, p.k, item_id, m, least(total, m) as size, s from pieces p join wanted t on t.k = p.k and t.g = p.g, unnest(range(greatest(pos - m + 1, 0), greatest(least(pos, total - m), 0) + 1)) as u(s)),
held as (select s.rid, s.doc_id, item_id, s.k, m, size, s, p.g, count(*) as n from starts s join pieces p on p.rid = s.rid and p.k = s.k and pos >= s and pos < s + m group by all),
sized as (select rid, h.doc_id, h.item_id, h.k, h.m, size, s, sum(least(h.n, t.n)) as shared from held h join wanted t on t.item_id = h.item_id and t.g = h.g group by all),
best as (select doc_id, item_id, arg_max({'s': s, 'size': size, 'k': k, 'm': m, 'shared': shared}, {'like': shared / (size + m - shared), 'late': -s}) as b from sized where 100 * shared >= 80 * (size + m - shared) group by doc_id, item_id)
select doc_id, item_id, cast(b.s as integer) as start_word, cast(b.size + b.k - 1 as integer) as n_words, cast(b.shared as integer) as shared, cast(b.size + b.m - b.shared as integer) as joined from best
"""

_HEADERS = """list_aggregate(list_sort(list_transform(map_entries(h), lambda e: e.key || '=' || e.value)), 'string_agg', ';')"""
REVISITS = f"""
with caps as (
    select page_id * 3 as record_id, 'response' as record_type, url, 1700000000 + page_id * 60 as seen, '"v' || (page_id % 1000) || '"' as tag, cast(page_id as varchar) as modified,
        map {{'etag': '"v' || (page_id % 1000) || '"', 'content-type': 'text/html', 'date': cast(1700000000 + page_id * 60 as varchar), 'last-modified': cast(page_id as varchar)}} as h
    from pages where page_id % 11 <> 0
    union all
    select page_id * 3 + 1, 'revisit', regexp_replace(url, '^http://', 'https://') || case when contains(url, '#') then 'x' else '#again' end, 1700086400 + page_id * 60,
        case when page_id % 7 = 0 then '"w' || page_id || '"' else '"v' || (page_id % 1000) || '"' end, null,
        map {{'etag': case when page_id % 7 = 0 then 'W/"w' || page_id || '"' else 'W/"v' || (page_id % 1000) || '"' end, 'date': cast(1700086400 + page_id * 60 as varchar), 'content-length': '0'}}
    from pages
    union all
    select page_id * 3 + 2, 'revisit', url, 1700172800 + page_id * 60, null, cast(page_id as varchar),
        map {{'last-modified': cast(page_id as varchar), 'expires': cast(1700259200 + page_id * 60 as varchar), 'server': 'a'}}
    from pages
), keyed as (
    select record_id, record_type, seen, tag, modified, h,
        regexp_replace(regexp_replace(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)), '^www\\.', ''), ':(80|443)$', '')
        || regexp_replace(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '/+$', '')
        || coalesce('?' || nullif(list_aggregate(list_sort(list_filter(string_split(regexp_extract(url, '^[^#]*?\\?([^#]*)', 1), '&'),
            lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), 'string_agg', '&'), ''), '') as url
    from caps
), met as (
    select k.*, (select max(struct_pack(seen := r.seen, id := r.record_id, tag := r.tag, modified := r.modified, h := r.h)) from keyed r
        where r.record_type = 'response' and k.record_type = 'revisit' and r.url = k.url and r.seen < k.seen) as r
    from keyed k
), judged as (
    select *, case when record_type = 'response' then 'full' when r is null then 'no_response'
        when coalesce(tag = r.tag, modified = r.modified, true) then 'resolved' else 'mismatch' end as status from met
), merged as (
    select *, map_from_entries(list_filter(map_entries(h), lambda e: list_contains(['cache-control', 'content-location', 'date', 'etag', 'expires', 'last-modified', 'vary', 'warning'], e.key))) as up from judged
)
select record_id, record_type, url, case when status = 'resolved' then r.id end as response_id, status,
    case when status = 'resolved' then list_aggregate(list_sort(list_transform(list_concat(
        list_filter(map_entries(r.h), lambda e: not list_contains(map_keys(up), e.key)), map_entries(up)), lambda e: e.key || '=' || e.value)), 'string_agg', ';')
    else {_HEADERS} end as headers
from merged
"""

URL_FILTER = f"""
with u as (
    select page_id, coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
), rules(key, h, p, v) as (
    values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
        ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), parts as (
    select distinct host as h, regexp_extract(path, '^/[^/]+/') as p from u where regexp_extract(path, '^/[^/]+/') <> ''
), listed as (
    select h, p from parts where substr(md5(h || p), 1, 1) in ('0', '1', '2', '3')
    union all select a || '.example.' || b, '' from (values ('cheap-pills'), ('spam-farm')) as x(a), (values ('com'), ('net'), ('org')) as y(b)
), best as (
    select page_id, arg_max(key, length(key)) as rule, arg_max(v, length(key)) as v from u join rules
        on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
), blocked as (select distinct page_id, true as b from u join listed on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, case when b then 'block' else 'allow' end) as verdict
from u left join best using (page_id) left join blocked using (page_id)
"""

SOURCE_MIX = """
with sizes as (
    select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
        cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) as place from documents
), sources as (select source, cast(sum(size) as bigint) as source_size from sizes group by source),
weighed as (select *, [3, 1, 2][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as bigint)] as weight from sources),
levels as (
    select *, (cast(sum(source_size) over () as double) * 1.5 - 2 * coalesce(cast(sum(source_size) over before as double), 0))
        / cast(sum(weight) over () - coalesce(sum(weight) over before, 0) as double) as level, row_number() over (order by source_size / weight, source nulls last) as rank
    from weighed window before as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), shared as (select arg_min(level, rank) as shared from levels where not level * weight > 2.0 * source_size),
goals as (select source, source_size, case when level * weight > 2.0 * source_size then 2.0 * source_size else shared * weight end as target from levels left join shared on true),
run as (
    select doc_id, s.source, size, source_size, cast(target as double) as target, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as passes,
        sum(size) over (partition by s.source order by place range between unbounded preceding and current row) as upto
    from sizes s join goals g on s.source is not distinct from g.source
)
select doc_id, size, source_size, target, cast(size * (passes + case when upto <= target - passes * source_size then 1 else 0 end) as bigint) as taken, source from run
"""

LINE_DEDUP = f"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), keyed as (select *, {LOWER.format(f"trim(line, {BLANKS})")} as key from lines),
repeated as (select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.*, last is not null and doc_id is distinct from last as gone from keyed k left join repeated using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


HARD_NEGATIVES = """
with own as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
    where vec_id is not null and label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) is distinct from false
), scores as (
    select a.vec_id as anchor, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score from own a join own b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
    select anchor, other as positive, score as p from scores where same qualify row_number() over (partition by anchor order by score desc, other) <= 5
), ranked as (
    select anchor, positive, p, other, score, row_number() over (partition by anchor, positive order by score desc, other) as rank
    from positives join scores using (anchor) where not same and 80 * p <= 100 * score and 100 * score <= 100 * p
)
select anchor as anchor_id, positive as positive_id, cast(rank as integer) as rank, other as negative_id, p as positive_score, score as negative_score from ranked where rank <= 5
"""

CONVERSATION_REPAIR = """
with recursive bits as (select i, i as c, 0 as n from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n + 1 from bits where n < 8),
crcs as (select list(c order by i) as crc from bits where n = 8),
faulty as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(
        list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ord(x) as bigint)),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as f from conversations, crcs
), hurt as (
    select conv_id, turn, case f when 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from faulty, range(case f when 0 then 0 when 3 then 2 else 1 end)
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, right(rtrim(text, BLANKS), 1) as last, left(role, 1) as initial from hurt
), marked as (select * exclude again, case when last = '' then 'b' when again then 'd' when last not in ('.', '!', '?') then 't' else '' end as fault, lag(initial) over (partition by conv_id order by i) || initial as pair
    from (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again from placed)),
counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
        count(*) filter (fault = 't') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from marked group by conv_id
), moves as (select * from (values ('', 's'), ('', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) t(q, next)),
added as (
    select * from (values ('', '', '', []), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []), ('', 'u', 'I', ['user:']), ('', 'a', 'II', ['user:', 'assistant:']),
        ('s', 'u', 'I', ['user:']), ('s', 'a', 'II', ['user:', 'assistant:']), ('a', 'u', 'I', ['user:']), ('u', 'a', 'I', ['assistant:'])) t(q, next, letters, lines)
), edits as (
    select conv_id, i, 'D' as letter, 2 as cost, null as to_role, cast([] as varchar[]) as line from marked
    union all select conv_id, i, 'K', case fault when 't' then 5 else 0 end, initial, [role || ':' || text] from marked where fault not in ('b', 'd')
    union all select conv_id, i, 'R', case fault when 't' then 6 else 1 end, left(r, 1), [r || ':' || text] from marked, (values ('user'), ('assistant')) t(r) where fault not in ('b', 'd')
), ways as (
    select conv_id, cast(0 as bigint) as i, next as q, cast(5 * length(letters) as bigint) as cost, letters as audit, cast(lines as varchar[]) as lines
    from (select distinct conv_id from conversations), added where q = ''
    union all
    select conv_id, i, q, min(way).cost, min(way).audit, min(way).lines from (
        select w.conv_id, e.i, a.next as q, {'cost': w.cost + e.cost + 5 * length(a.letters), 'audit': w.audit || e.letter || a.letters, 'lines': w.lines || e.line || cast(a.lines as varchar[])} as way
        from ways w join edits e on e.conv_id is not distinct from w.conv_id and e.i = w.i + 1
        left join moves m on m.q = w.q and m.next = e.to_role join added a on a.q = case when e.letter = 'D' then w.q else m.next end
    ) group by conv_id, i, q
), ends as (
    select conv_id, arg_max(best, i) as best from (select conv_id, i, min({'cost': cost, 'audit': audit, 'lines': lines}) as best from ways where q in ('', 'a') group by conv_id, i) group by conv_id
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    best.cost as cost, best.audit as audit, sha256(array_to_string(best.lines, chr(10))) as repaired_sha256
from ends e left join counts c on c.conv_id is not distinct from e.conv_id
""".replace("BLANKS", BLANKS)


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_near_dedup": NEAR_DUPLICATES,
        "op4_benchmark_decontamination": DECONTAMINATION,
        "op5_warc_revisits": REVISITS,
        "op7_url_filter": URL_FILTER,
        "op8_source_mix": SOURCE_MIX,
        "op9_line_dedup": LINE_DEDUP,
        "op11_hard_negatives": HARD_NEGATIVES,
        "op13_conversation_repair": CONVERSATION_REPAIR,
    }
