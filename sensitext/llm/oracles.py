"""DuckDB statements with the same rows as the registered queries."""

from __future__ import annotations

from .quality import CLASSES, Limits

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _in_class(members: str) -> str:
    return "length(t) - length(regexp_replace(t, '[" + members.replace("'", "''") + "]', '', 'g'))"


_FIRST = [_in_class(members) for _, members in CLASSES]
_COUNTS = "[" + ", ".join(_FIRST) + ", length(t) - (" + " + ".join(_FIRST) + ")]"


def _js(p: str, q: str) -> str:
    part = "case when {a} > 0 then {a} * log2({a} / (({p} + {q}) / 2)) else 0 end"
    return f"sqrt(greatest(sum({part.format(a=p, p=p, q=q)} + {part.format(a=q, p=p, q=q)}) / 2, 0))"


def quality_sql(limits: Limits = Limits(), table: str = "documents") -> str:
    """Base counts, references over all documents and both distances; the nearest language decides."""
    n_classes = len(CLASSES) + 1
    return f"""
with d as (
  select row_number() over () as id, doc_id, lang, coalesce(text, '') as t, {_WORDS} as w from {table}),
tok as (select id, lang, unnest(w) as word, generate_subscripts(w, 1) as i from d),
tri as (
  select id, i, word || ' ' || lead(word) over s || ' ' || lead(word, 2) over s as g from tok
  window s as (partition by id order by i)),
hit as (
  select id, i, count(*) over (partition by id, g) as n from tri where g is not null),
rep as (
  select id, count(distinct i + k) as n from hit, (values (0), (1), (2)) v(k) where n > 1 group by id),
lin as (select id, unnest(string_split(t, chr(10))) as line from d),
dup as (
  select id, count(*) - count(distinct line) as n from lin
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by id),
base as (
  select d.id, d.doc_id, d.lang, t, len(w) as n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    {_in_class('#*$%&|<>')} as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
    {_COUNTS} as classes
  from d left join dup using (id) left join rep using (id)),
lw as (select lang, word, count(*) as n from tok group by all),
lt as (select lang, sum(n) as total from lw group by 1 order by total desc, lang limit {limits.languages}),
top as (
  select lw.lang, word, n, total from lw join lt on lw.lang is not distinct from lt.lang
  where n >= {limits.common_share} * total
  qualify row_number() over (partition by lw.lang order by n desc, word) <= {limits.common_words}),
wref as (
  select lang, word, n / total as q from top
  union all
  select lang, null, 1 - sum(n) / any_value(total) from top group by lang),
cref as (
  select lt.lang, k, sum(classes[k]) / sum(length(t)) as q
  from base join lt on base.lang is not distinct from lt.lang, range(1, {n_classes + 1}) r(k) group by all),
dw as (select id, word, count(*) as n from tok group by all),
own as (
  select dw.id, top.lang, top.word, dw.n from dw join top on dw.word = top.word),
rest as (
  select b.id, lt.lang, null as word, b.n_words - coalesce(o.n, 0) as n
  from base b cross join lt left join (select id, lang, sum(n) as n from own group by all) o
    on o.id = b.id and o.lang is not distinct from lt.lang where b.n_words > 0),
pw as (select * from own union all select * from rest),
wd as (
  select id, min(far) as far from (
    select b.id, wref.lang, {_js('(coalesce(pw.n, 0) / b.n_words)', 'wref.q')} as far
    from base b cross join wref left join pw on pw.id = b.id and pw.lang is not distinct from wref.lang
      and pw.word is not distinct from wref.word
    where b.n_words > 0 group by b.id, wref.lang) group by id),
cd as (
  select id, min(far) as far from (
    select b.id, cref.lang, {_js('(b.classes[cref.k] / length(b.t))', 'cref.q')} as far
    from base b cross join cref where length(b.t) > 0 group by b.id, cref.lang) group by id),
v as (
  select base.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    length(t) >= {limits.min_chars} and round(coalesce(cd.far, 0), 9) > {limits.max_class_distance}
    or n_words >= {limits.min_words} and round(coalesce(wd.far, 0), 9) > {limits.max_word_distance} as strange
  from base left join cd using (id) left join wd using (id))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not strange as kept
from v
"""


QUALITY = quality_sql()


def near_duplicates_sql(table: str = "documents") -> str:
    """Links by a join on shingles, components by reachability."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with recursive d as (
  select doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') as w from {table}),
sh as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
sz as (select d.doc_id, count(s) as n from d left join sh using (doc_id) group by 1),
pair as (
  select a.doc_id as x, b.doc_id as y, count(*) as n from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (
  select x, y from pair join sz a on a.doc_id = x join sz b on b.doc_id = y
  where 100 * pair.n >= 75 * (a.n + b.n - pair.n)),
both_ways as (select x, y from link union all select y, x from link),
reach as (
  select doc_id, doc_id as other from sz
  union
  select reach.doc_id, both_ways.y from reach join both_ways on both_ways.x = reach.other),
comp as (select doc_id, min(other) as component_id from reach group by 1)
select doc_id, n::bigint as n_shingles, component_id, doc_id = component_id as kept from sz join comp using (doc_id)
"""


NEAR_DUPLICATES = near_duplicates_sql()


def url_verdicts_sql(rules: list[tuple[str, str]], table: str = "pages") -> str:
    """The longest fitting rule, else what the aliases say, else allow."""
    listed = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in rules)
    return f"""
with recursive rules as (
  select verdict, rule, substr(rule, 1, instr(rule, '/') - 1) as rhost, substr(rule, instr(rule, '/')) as rpath
  from (values {listed}) v(verdict, rule)),
p as (
  select row_number() over () as id, page_id, url, html, case when contains(url, '://') then split_part(url, '#', 1) end as address from {table}),
link as (
  select id, url, address, unnest([
    regexp_extract(regexp_extract(html, '(?i)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)]) as target
  from p where address is not null),
edge as (
  select distinct address as a, split_part(case
    when contains(t, '://') then t
    when starts_with(t, '//') then split_part(url, ':', 1) || ':' || t
    when starts_with(t, '/') then regexp_extract(url, '^(.*?://[^/?#]*)', 1) || t
    else regexp_extract(url, '^(.*?://[^/?#]*)', 1) || case when folder = '' then '/' else folder end || t end, '#', 1) as b
  from (select *, replace(target, '&amp;', '&') as t, regexp_replace(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') as folder
        from link where target != '')),
both_ways as (select a, b from edge union select b, a from edge),
reach as (select a as node, a as other from both_ways union select r.node, e.b from reach r join both_ways e on e.a = r.other),
place as (
  select address as u from p where address is not null union select node from reach),
parts as (
  select u, lower(regexp_extract(u, '^.*?://([^/?#]*)', 1)) as host, regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1) as path from place),
own as (
  select u, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from parts join rules
    on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by u),
shared as (select r.node, min(own.verdict) as verdict from reach r join own on own.u = r.other group by 1)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(own.verdict, shared.verdict, 'allow') as verdict
from p left join parts on parts.u = p.address left join own on own.u = p.address left join shared on shared.node = p.address
"""


def chat_sql(table: str = "conversations") -> str:
    """Turns in order, digests of what the template must give back, and the template's length."""
    escaped = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"
    marks = len("<|im_start|>") + len("\n") + len("<|im_end|>\n")
    return f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from {table}
  union all
  select -1, turn, role, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) v(turn, role)),
shown as (select *, length({escaped.format('text')}) + length(replace({escaped.format('role')}, chr(10), '\\' || chr(10))) + {marks} as chars from said)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from shown group by conv_id
"""


CHAT = chat_sql()


def warc_sql(least_revisit: int = 100, table: str = "pages") -> str:
    return f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from {table}),
d as (
  select page_id, octet_length(payload) as n, sha256(payload) as digest,
    first_value(page_id) over (partition by payload order by page_id) as first from p)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when n >= {least_revisit} and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= {least_revisit} and page_id <> first then first end as refers_to
from d
"""


def manifest_sql(table: str = "documents") -> str:
    """All levels of every language's tree and of the tree over them; proofs and folds level by level."""
    crc_table = (
        "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), "
        "lambda c, _: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end))"
    )
    bytes_of = "list_transform(range(1, length(s) + 1), lambda k: ord(s[k])::bigint)"
    shown = "coalesce(octet_length(encode({0}))::varchar || ':' || {0}, '-')"
    fields = " || ".join(shown.format(c) for c in ("doc_id::varchar", "source", "lang", "{0}::varchar", "text"))
    return f"""
with recursive crc as (select {crc_table} as t),
d as (select row_number() over () as id, doc_id, lang, source, n_chars, text, doc_id::varchar as s from {table}),
c as (
  select id, xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
  from d, crc),
l as (
  select d.*, sha256({fields.format("n_chars")}) as leaf,
    sha256(case when crc % 7 = 0 then {fields.format("(n_chars::hugeint + 1)")} else {fields.format("n_chars")} end) as shown
  from d left join c using (id)),
r as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from l),
tree as (
  select lang, 0 as lvl, i, leaf as h, n from r
  union all
  select lang, lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from tree where n > 1 group by lang, lvl, i // 2, n),
subroot as (
  select lang, h, lvl as deep, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from tree where n = 1),
top as (
  select 0 as lvl, i, h, n from subroot
  union all
  select lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from top where n > 1 group by lvl, i // 2, n),
step as (
  select r.id, tree.lvl, r.i >> tree.lvl & 1 = 1 as is_right, o.h as sibling
  from r join tree on tree.lang is not distinct from r.lang and tree.i = r.i >> tree.lvl and tree.n > 1
  left join tree o on o.lang is not distinct from r.lang and o.lvl = tree.lvl and o.i = xor(tree.i, 1)
  union all
  select r.id, s.deep + top.lvl, s.i >> top.lvl & 1 = 1, o.h
  from r join subroot s on s.lang is not distinct from r.lang join top on top.i = s.i >> top.lvl and top.n > 1
  left join top o on o.lvl = top.lvl and o.i = xor(top.i, 1)),
proof as (select id, sha256(string_agg(coalesce(sibling, ''), '' order by lvl)) as proof_sha256 from step group by id),
fold as (
  select id, 0 as lvl, shown as h from r
  union all
  select fold.id, fold.lvl + 1, sha256(case when is_right then coalesce(sibling, '') || h else h || coalesce(sibling, '') end)
  from fold join step on step.id = fold.id and step.lvl = fold.lvl),
folded as (select id, arg_max(h, lvl) as folded_root from fold group by id)
select doc_id, leaf, subroot.h as subroot, top.h as root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = top.h as verified
from r join subroot on subroot.lang is not distinct from r.lang join top on top.n = 1
join folded using (id) left join proof using (id)
"""


MANIFEST = manifest_sql()
