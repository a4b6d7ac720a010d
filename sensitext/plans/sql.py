"""Building blocks of the DuckDB oracles."""

from __future__ import annotations

from ..functions.rules import Rules


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(source: str, key: str, rules: Rules, text: str = "text") -> str:
    """CTE list defining raw(key, ord, start, stop, type, value): every match of every active rule."""
    parts = [
        f"select {key}, {i} as ord, {quote(rule.type)} as type, regexp_extract_all({text}, {quote(rule.pattern)}) as v, "
        f"string_split_regex({text}, {quote(rule.pattern)}) as g from src where regexp_matches({text}, {quote(rule.pattern)})"
        for i, rule in enumerate(rules.active)
    ]
    return f"""src as ({source}),
per_rule as ({' union all '.join(parts)}),
pieces as (select {key}, ord, type, unnest(v) as value, unnest(g[1:len(v)]) as gap, unnest(range(len(v))) as i from per_rule),
raw as (select {key}, ord, type, value,
  cast(sum(length(gap) + length(value)) over (partition by {key}, ord order by i) as integer) as stop,
  cast(stop - length(value) as integer) as start from pieces)"""


def found(source: str, key: str, rules: Rules = Rules(), text: str = "text") -> str:
    """CTE list ending in found(key, start, stop, type, value): matches after overlap removal."""
    return matches(source, key, rules, text) + f""",
lists as (select {key}, list({{'s': start, 'e': stop, 'kept': [{{'start': start, 'stop': stop, 'type': type, 'value': value}}]}}
  order by start, stop desc, ord) as l from raw group by {key}),
folded as (select {key}, list_reduce(l, lambda acc, x: case when x.s >= acc.e
  then {{'s': x.s, 'e': x.e, 'kept': acc.kept || x.kept}} else acc end) as r from lists),
found as (select {key}, m.start as start, m.stop as stop, m.type as type, m.value as value
  from (select {key}, unnest(r.kept) as m from folded))"""


def tokens(key: str, scope: str) -> str:
    """CTE list continuing ``found`` with tokens(scope, value, type, ordinal, token) and put(key, ..., token)."""
    return f"""firsts as (select {scope}, value, arg_min(type, ({key}, start)) as type, min(({key}, start)) as pos
  from found group by {scope}, value),
tokens as (select {scope}, value, type, cast(row_number() over (partition by {scope}, type order by pos) as integer) as ordinal,
  concat('[', type, '_', cast(row_number() over (partition by {scope}, type order by pos) as string), ']') as token from firsts),
put as (select f.*, t.token from found f join tokens t on f.{scope} = t.{scope} and f.value = t.value)"""


def redacted(key: str, text: str = "text") -> str:
    """CTE list continuing ``put`` with red(key, redacted, items, types)."""
    return f"""cuts as (select p.{key}, p.start, p.stop, p.type, p.token, s.{text} as body,
  lag(p.stop, 1, 0) over (partition by p.{key} order by p.start) as prev from put p join src s on s.{key} = p.{key}),
joined as (select {key}, concat(string_agg(concat(substr(body, prev + 1, start - prev), token), '' order by start),
    substr(any_value(body), max(stop) + 1)) as redacted, count(*) as items from cuts group by {key}),
kinds as (select {key}, string_agg(type, ',' order by pos) as types
  from (select {key}, type, min(start) as pos from put group by {key}, type) group by {key}),
red as (select s.{key}, coalesce(j.redacted, s.{text}) as redacted, cast(coalesce(j.items, 0) as integer) as items,
  coalesce(k.types, '') as types from src s left join joined j on j.{key} = s.{key} left join kinds k on k.{key} = s.{key})"""


def admissions(source: str, user: str, window: int, limit: str) -> str:
    """CTE list ending in passed(id): requests of src(user, us, id, limit) that a sliding limit admits."""
    return f"""asked as ({source}),
lines as (select {user}, any_value({limit}) as lim, list({{'t': us, 'recent': [us], 'ok': [id]}} order by us, id) as l
  from asked where {limit} > 0 group by {user}),
ran as (select {user}, list_reduce(l, lambda acc, x: case
    when len(list_filter(acc.recent, lambda a: a > x.t - {window})) < lim
    then {{'t': x.t, 'recent': list_filter(acc.recent, lambda a: a > x.t - {window}) || x.recent, 'ok': acc.ok || x.ok}}
    else {{'t': x.t, 'recent': list_filter(acc.recent, lambda a: a > x.t - {window}), 'ok': acc.ok}} end) as r from lines),
passed as (select unnest(r.ok) as id from ran union all select id from asked where coalesce({limit}, 0) <= 0)"""


def lifetimes(source: str, lifetime: int) -> str:
    """CTE list ending in stores(key, us, id): src(key, us, id, ok) requests that store anew."""
    return f"""looked as ({source}),
able as (select key, list({{'t': us, 'kept': [{{'us': us, 'id': id}}]}} order by us, id) as l from looked where ok group by key),
chain as (select key, list_reduce(l, lambda acc, x: case when x.t - acc.t > {lifetime}
  then {{'t': x.t, 'kept': acc.kept || x.kept}} else acc end) as r from able),
stores as (select key, m.us as us, m.id as id from (select key, unnest(r.kept) as m from chain)),
served as (select l.key, l.us, l.id, max((s.us, s.id)) as st from looked l
  left join stores s on s.key = l.key and (s.us, s.id) <= (l.us, l.id) and l.us - s.us <= {lifetime} group by l.key, l.us, l.id)"""
