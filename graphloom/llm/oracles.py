"""DuckDB SQL for results of the training-data queries that SQL can express."""

from __future__ import annotations

from .url_filter import verdict_sql

#: Every 100-byte string by its place; what an earlier place has goes. Strings are told apart by 64-bit hashes.
REPEATS = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
q as (select doc_id, j, substr(x, 2 * j + 1, 1198) as x, least(500, n - 99 - j) as m from (select doc_id, x, n, unnest(range(0, n - 99, 500)) as j from h where n >= 100)),
p as (select doc_id, j + i as i, hash(substr(x, 2 * i + 1, 200)) as k from (select doc_id, j, x, unnest(range(0, m)) as i from q)),
f as (select k, min(doc_id * 4294967296 + i) as m from p group by 1),
g as (select p.doc_id, p.i, case when p.i - lag(p.i) over (partition by p.doc_id order by p.i) <= 100 then 0 else 1 end as fresh from p join f on f.k = p.k where p.doc_id * 4294967296 + p.i > f.m),
r as (select doc_id, run, min(i) as a, max(i) + 100 as b from (select *, sum(fresh) over (partition by doc_id order by i) as run from g) group by 1, 2),
s as (select doc_id, count(*) as spans, sum(b - a) as removed, max(b) as last from r group by 1),
c as (select r.doc_id, string_agg(substr(h.x, 2 * r.pb + 1, 2 * (r.a - r.pb)), '' order by r.a) as kept from (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as pb from r) r join h on h.doc_id = r.doc_id group by 1)
select h.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(c.kept, '') || substr(h.x, 2 * coalesce(s.last, 0) + 1))) as kept_sha256
from h left join s on s.doc_id = h.doc_id left join c on c.doc_id = h.doc_id"""

#: All pairs that share a shingle, counted; links then spread the least id by rounds.
NEAR = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, hash(w[i], w[i + 1], w[i + 2]) as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)
  union all select doc_id, hash(array_to_string(w, ' '), len(w)) from w where len(w) between 1 and 2),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
adj as (select x as src, y as dst from l union all select y, x from l),
lab(id, c) using key (id) as (select doc_id, doc_id from documents union (select a.dst, min(l.c) from lab l join adj a on a.src = l.id left join recurring.lab o on o.id = a.dst where l.c < o.c group by 1))
select lab.id as doc_id, coalesce(n.n, 0) as n_shingles, c as component_id, c = id as kept from lab left join n on n.doc_id = lab.id"""

#: For pages whose main text is one marked article without boilerplate inside, as in the shared table.
MAIN_TEXT = """
with a as (select page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<!--.*?-->', '', 'gs'), '<br[^>]*>', ' ', 'g') as body from pages),
b as (select page_id, url, list_transform(regexp_split_to_array(body, '</?(h1|h2|h3|p|div|ul|ol|li|section|blockquote|pre|table|tr)(\\s[^>]*)?>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) as parts from a),
c as (select page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', chr(169)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda x: x <> '') as parts from b)
select page_id, url, array_to_string(parts, chr(10) || chr(10)) as text, cast(length(array_to_string(parts, chr(10) || chr(10))) as bigint) as n_chars from c"""

#: Ordinary messages: the shared conversations hold no calls and no results.
MESSAGES = """
select conv_id, cast(turn as bigint) as turn, cast(-1 as int) as place, 'message' as kind, cast(null as varchar) as call_id, cast(null as varchar) as name, false as linked, true as valid,
  '' as errors, cast(0 as int) as topo_level, cast(to_json({'content': text, 'role': role}) as varchar) as canonical
from conversations"""

ORACLE = {"op1_url_filter": verdict_sql(), "op2_suffix_dedup": REPEATS, "op4_tool_calls": MESSAGES, "op5_minhash_near_dedup": NEAR, "op9_html_extraction": MAIN_TEXT}
