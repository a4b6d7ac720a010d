"""Registered queries over request, response and attempt logs and the key registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats
from ..functions.rules import Rules
from ..operators import access, attempts, audit, gateway, registry, reuse, spend
from ..operators.base import with_once
from ..operators.policy import Policy
from ..settings import Settings
from ..sources import catalog as provider_catalog
from . import inputs, sql
from .inputs import table
from .registered import query

# ── Registry ─────────────────────────────────────────────────────────────────────────────────────

_KEYS = f"""select concat('id', cast(c_custkey as string)) as user_id, concat('user', cast(c_custkey as string)) as user_name,
  c_mktsegment as seg, {inputs.LIMIT} as rate_limit, {inputs.KEY_FIELDS}, j
  from (select *, unnest([0, 1]) as j from customer)"""
_EXPIRES = "strftime(expires_at, '%Y-%m-%d %H:%M:%S') as expires"


def _expires(column: str = "expires_at"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias("expires")


@query(
    "flatten_registry",
    f"""with k as ({_KEYS}) select user_id, user_name as "user", seg as "group", rate_limit, cast(j as integer) as position,
    token_key, 'api-key' as label, {_EXPIRES}, revoked from k""",
)
def flatten_registry(spark, sf_dir):
    flat = registry.flatten_registry(inputs.registry(spark, sf_dir))
    return flat.select(
        "user_id", "user", "group", "rate_limit", "position", "token_key", "label", _expires(), "revoked"
    )


@query(
    "active_tokens",
    f"""with k as ({_KEYS}) select token_key, user_id, user_name as "user", seg as "group", rate_limit, {_EXPIRES}
    from k where not revoked""",
)
def active_tokens(spark, sf_dir):
    live = registry.active_tokens(inputs.registry(spark, sf_dir))
    return live.select("token_key", "user_id", "user", "group", "rate_limit", _expires())


@query(
    "registry_users",
    f"""with k as ({_KEYS}) select user_id as id, any_value(user_name) as name, any_value(seg) as "group",
    any_value(rate_limit) as rate_limit, cast(count_if(not revoked) as integer) as live_keys from k group by user_id""",
)
def registry_users(spark, sf_dir):
    return registry.users(inputs.registry(spark, sf_dir)).select("id", "name", "group", "rate_limit", "live_keys")


@query(
    "user_by_id",
    """select concat('id', cast(c_custkey as string)) as id, concat('user', cast(c_custkey as string)) as name, c_mktsegment as "group"
    from customer where c_custkey = 7""",
)
def user_by_id(spark, sf_dir):
    return registry.user_by_id(inputs.registry(spark, sf_dir), "id7").select("id", "name", "group")


@query(
    "token_preview",
    f"""with k as ({_KEYS}) select user_id, label, concat(substr(token_key, 1, 8), '...', right(token_key, 4)) as preview
    from (select *, 'api-key' as label from k) where not revoked""",
)
def token_preview(spark, sf_dir):
    return registry.token_preview(inputs.registry(spark, sf_dir)).select("user_id", "label", "preview")


@query(
    "registry_from_keys",
    """with e as (select concat('cfg-', cast(c_custkey % 500 as string)) as key, concat('user', cast(c_custkey as string)) as name,
      c_mktsegment as "group", row_number() over (partition by c_custkey % 500 order by c_custkey desc) as n from customer)
    select key, name, "group", 'config' as label from e where n = 1""",
)
def registry_from_keys(spark, sf_dir):
    entries = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cfg-"), (F.col("c_custkey") % 500).cast("string")).alias("key"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("user"),
        F.col("c_mktsegment").alias("group"), F.lit(0).alias("rate_limit"), F.col("c_custkey").alias("position"),
    )
    users = registry.registry_from_keys(entries, F.lit("2024-01-01"))
    return users.select(
        F.get("tokens", F.lit(0))["key"].alias("key"), "name", "group", F.get("tokens", F.lit(0))["label"].alias("label")
    )


_CHANGES = """select event_id as seq, ts, case event_type when 'signup' then 'create_user' when 'error' then 'delete_user'
    when 'view' then 'revoke_token' else 'add_token' end as op,
  concat('id', cast(user_id * 3 as string)) as user_id,
  case when event_id % 23 = 0 then '' else concat('made', cast(event_id as string)) end as name,
  '' as seg, case when event_type = 'view' then
      case when event_id % 2 = 0 then concat('key-user', cast(user_id * 3 as string), '-0') else concat('new-', cast(user_id as string)) end
    when event_type in ('click', 'purchase') then
      case when event_type = 'click' then concat('new-', cast(user_id as string), '-', cast(event_id as string)) else concat('new-', cast(user_id as string)) end
    end as token_key,
  case when event_id % 3 = 0 then 'mine' else '' end as label, cast(event_id % 4 as int) as expires_in_hours
  from events"""


def _changes(spark, sf_dir):
    made = inputs._derived(spark, sf_dir, "events", _CHANGES)
    return made.select(
        "seq", F.col("ts").cast("timestamp").alias("ts"), "op", "user_id", "name",
        F.lit(None).cast("string").alias("email"), F.col("seg").alias("group"), F.lit(5).alias("rate_limit"),
        "token_key", "label", "expires_in_hours",
    )


# The oracle looks up the state before each change with correlated subqueries instead of windows.
_JUDGED = f"""ch as ({_CHANGES}),
keyed as ({_KEYS}),
marks as (select seq, user_id, op from ch where op = 'delete_user' or (op = 'create_user' and name <> '')),
placed as (select c.*, (select count(*) from marks m where m.user_id = c.user_id and m.seq < c.seq) as era,
  coalesce((select arg_max(m.op, m.seq) = 'create_user' from marks m where m.user_id = c.user_id and m.seq < c.seq),
           c.user_id in (select user_id from keyed)) as here from ch c),
judged as (select p.*, case
  when op = 'create_user' then case when name = '' then 'Name is required' end
  when not here then concat('user not found: ', user_id)
  when op = 'revoke_token' and not (
      (era = 0 and exists (select 1 from keyed k where k.user_id = p.user_id and k.token_key = p.token_key))
      or exists (select 1 from placed a where a.op = 'add_token' and a.here and a.user_id = p.user_id and a.era = p.era
                 and a.token_key = p.token_key and a.seq < p.seq)) then 'token not found' end as error from placed p)"""


@query("registry_rejected_changes", f"with {_JUDGED} select seq, op, user_id, error from judged where error is not null")
def registry_rejected_changes(spark, sf_dir):
    _, rejected = registry.apply_registry_changes(inputs.registry(spark, sf_dir), _changes(spark, sf_dir))
    return rejected.select("seq", "op", "user_id", "error")


@query(
    "registry_after_changes",
    f"""with {_JUDGED},
    ends as (select user_id, count(*) as eras, arg_max(op, seq) as last_op, max(seq) as last_seq from marks
      where user_id in (select user_id from judged where error is null and op in ('create_user', 'delete_user')) group by user_id),
    good as (select * from judged where error is null),
    resets as (select user_id, max(seq) as rs, arg_max(op, seq) as rop, arg_max(name, seq) as rname, max(era) + 1 as era
      from good where op in ('create_user', 'delete_user') group by user_id),
    people as (select distinct k.user_id, k.user_name as name, k.seg as "group", 0 as era from keyed k
        where k.user_id not in (select user_id from resets)
      union all select user_id, rname, 'default', era from resets where rop = 'create_user'),
    toks as (select user_id, 0 as era, token_key, 'api-key' as label, revoked, true as forever from keyed
        where user_id not in (select user_id from resets)
      union all select user_id, era, token_key, case when label = '' then 'api-key' else label end, false, expires_in_hours = 0
        from good where op = 'add_token'),
    cut as (select distinct user_id, era, token_key from good where op = 'revoke_token'),
    marked as (select t.*, t.revoked or c.user_id is not null as gone from toks t
      left join cut c on c.user_id = t.user_id and c.era = t.era and c.token_key = t.token_key)
    select p.user_id as id, p.name, p."group", cast(count(m.token_key) as integer) as keys,
      cast(coalesce(count_if(not m.gone), 0) as integer) as live_keys, cast(coalesce(count_if(m.label = 'mine'), 0) as integer) as own_label,
      cast(coalesce(count_if(m.forever), 0) as integer) as forever
    from people p left join marked m on m.user_id = p.user_id and m.era = p.era group by p.user_id, p.name, p."group" """,
)
def registry_after_changes(spark, sf_dir):
    after, _ = registry.apply_registry_changes(inputs.registry(spark, sf_dir), _changes(spark, sf_dir))

    def count(test):
        return F.size(F.filter("tokens", test))

    # Tokens of the original registry may expire by date; only added ones count as limited here.
    fixed = F.lit("2024-01-10").cast("timestamp")
    return after.select(
        "id", "name", "group", F.size("tokens").alias("keys"), count(lambda t: ~t["revoked"]).alias("live_keys"),
        count(lambda t: t["label"] == "mine").alias("own_label"),
        count(lambda t: t["expires_at"].isNull() | (t["expires_at"] == fixed)).alias("forever"),
    )


# ── Authentication and rate limit ────────────────────────────────────────────────────────────────

_AUTH = f"""req as ({inputs.REQUESTS}),
keyed as ({_KEYS}),
held as (select r.*, case when starts_with("authorization", 'Bearer ') or starts_with("authorization", 'bearer ')
    then substr("authorization", 8) end as given from req r),
judged as (select h.*, case when given is null then 'missing or invalid Authorization header'
    when k.token_key is null then 'invalid API key' when h.ts > k.expires_at then 'token expired' end as auth_error,
  k.user_id as uid, k.user_name, k.seg, k.rate_limit from held h left join keyed k on k.token_key = h.given and not k.revoked),
auth as (select * exclude (uid, user_name, seg, rate_limit), case when auth_error is null then uid end as user_id,
  case when auth_error is null then user_name end as user_name, case when auth_error is null then seg end as seg,
  case when auth_error is null then rate_limit end as rate_limit from judged)"""


def _authenticated(spark, sf_dir):
    return access.authenticate(inputs.requests(spark, sf_dir), inputs.registry(spark, sf_dir))


@query(
    "authenticate",
    f"""with {_AUTH} select request_id, user_id, user_name as "user", seg as "group", rate_limit, auth_error from auth""",
)
def authenticate(spark, sf_dir):
    return _authenticated(spark, sf_dir).select("request_id", "user_id", "user", "group", "rate_limit", "auth_error")


_AS_OF = """select event_id as request_id, ts, case when event_id % 29 = 3 then null
    when event_id % 3 = 1 then concat('Bearer new-', cast(user_id as string))
    when event_id % 3 = 2 then concat('Bearer key-user', cast(user_id * 3 as string), '-0')
    else concat('bearer key-user', cast(user_id * 3 as string), '-1') end as authorization from events"""


# The oracle looks for every request at all grants of its key and takes the latest one that holds.
@query(
    "authenticate_as_of",
    f"""with {_JUDGED}, req as ({_AS_OF}),
    good as (select * from judged where error is null),
    grants as (select user_id, 0 as era, token_key, -1 as seq, null::timestamp as since, timestamp '2023-01-01' as created, expires_at,
        user_name as name, seg, rate_limit from keyed where not revoked
      union all select a.user_id, a.era, a.token_key, a.seq, a.ts, a.ts,
        case when expires_in_hours > 0 then a.ts + to_hours(expires_in_hours) end,
        coalesce((select c.name from good c where c.user_id = a.user_id and c.op = 'create_user' and c.era = a.era - 1),
          (select any_value(k.user_name) from keyed k where k.user_id = a.user_id)),
        case when a.era = 0 then (select any_value(k.seg) from keyed k where k.user_id = a.user_id) else 'default' end,
        case when a.era = 0 then (select any_value(k.rate_limit) from keyed k where k.user_id = a.user_id) else 5 end
      from good a where a.op = 'add_token'),
    ends as (select g.*, (select min(e.ts) from good e where e.user_id = g.user_id and e.era = g.era and e.seq > g.seq
        and (e.op in ('create_user', 'delete_user') or e.op = 'revoke_token' and e.token_key = g.token_key)) as until from grants g),
    met as (select r.request_id, r.ts, r."authorization" as header, arg_max(e, (e.created, e.seq)) filter (e.token_key is not null) as g
      from req r left join ends e on e.token_key = substr(r."authorization", 8) and (since is null or since <= r.ts) and (until is null or r.ts < until)
      group by all),
    said as (select *, case when header is null then '{access.MISSING}' when g is null then '{access.INVALID}'
      when ts > g.expires_at then '{access.EXPIRED}' end as auth_error from met)
    select request_id, auth_error, case when auth_error is null then g.user_id end as user_id, case when auth_error is null then g.name end as "user",
      case when auth_error is null then g.seg end as "group", case when auth_error is null then g.rate_limit end as rate_limit from said""",
)
def authenticate_as_of(spark, sf_dir):
    """Keys are granted, revoked and lost with their users while the log goes on."""
    asked = inputs._derived(spark, sf_dir, "events", _AS_OF)
    judged = access.authenticate_as_of(asked, inputs.registry(spark, sf_dir), _changes(spark, sf_dir))
    return judged.select("request_id", "auth_error", "user_id", "user", "group", "rate_limit")


@query("auth_fail_reasons", f"with {_AUTH} select auth_error, count(*) as requests from auth group by auth_error")
def auth_fail_reasons(spark, sf_dir):
    return _authenticated(spark, sf_dir).groupBy("auth_error").agg(F.count("*").alias("requests"))


@query(
    "authenticate_open_registry",
    "select event_id as request_id, 'anonymous' as \"user\", 'default' as \"group\" from events",
)
def authenticate_open_registry(spark, sf_dir):
    nobody = inputs.registry(spark, sf_dir).withColumn(
        "tokens", F.transform("tokens", lambda t: t.withField("revoked", F.lit(True)))
    )
    rows = access.authenticate(inputs.requests(spark, sf_dir), nobody, open_if_empty=True)
    return rows.filter("auth_error is null").select("request_id", "user", "group")


@query(
    "requests_by_user",
    f"""with {_AUTH} select user_name as "user", count(*) as requests from auth where auth_error is null group by user_name""",
)
def requests_by_user(spark, sf_dir):
    return access.requests_by_user(_authenticated(spark, sf_dir).filter("auth_error is null"))


_SIX_HOURS = 6 * 3600
_LIMIT_LOG = "select event_id as id, user_id, epoch_us(ts) as us, {limit} as lim0 from events"


@query(
    "rate_limit_admitted",
    f"""with {sql.admissions(_LIMIT_LOG.format(limit=3), 'user_id', _SIX_HOURS * 1_000_000, 'lim0')}
    select e.event_id as request_id, p.id is not null as admitted from events e left join passed p on p.id = e.event_id""",
)
def rate_limit_admitted(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "ts", "user_id")
    limited = access.rate_limit(log.withColumn("rate_limit", F.lit(3)), window_seconds=_SIX_HOURS)
    return limited.select("request_id", "admitted")


# Times cut to the hour: many requests share an instant, and the window boundary is hit exactly.
@query(
    "rate_limit_same_instant",
    f"""with {sql.admissions("select event_id as id, user_id % 10 as user_id, epoch_us(date_trunc('hour', ts)) as us, 1 + user_id % 4 as lim0 from events".replace('1 + user_id % 4', '1 + (user_id % 10) % 4'), 'user_id', 3 * 3600 * 1_000_000, 'lim0')}
    select e.event_id as request_id, p.id is not null as admitted from events e left join passed p on p.id = e.event_id""",
)
def rate_limit_same_instant(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.date_trunc("hour", "ts").alias("ts"),
        (F.col("user_id") % 10).alias("user_id"), (1 + F.col("user_id") % 10 % 4).cast("int").alias("rate_limit"),
    )
    return access.rate_limit(log, window_seconds=3 * 3600).select("request_id", "admitted")


# ── Spend ────────────────────────────────────────────────────────────────────────────────────────

_COST = "({i} / 1e6 * 3.0 + {o} / 1e6 * 15.0)"
_USAGE = f"used as ({inputs.USAGE}), segs as ({inputs.SEGMENTS})"
_SPEND = f"""{_USAGE}, per_user as (select user_name, cast(sum(input_tokens) as bigint) as i, cast(sum(output_tokens) as bigint) as o
  from used group by user_name)"""


def _usage(spark, sf_dir):
    # Bodies are read next to the source; only the counts are shuffled.
    return inputs.usage_log(spark, sf_dir, spend.parse_usage(inputs.responses(spark, sf_dir)).drop("body"))


@query("usage_parse", f"with {_USAGE} select request_id, input_tokens, output_tokens from used")
def usage_parse(spark, sf_dir):
    return spend.parse_usage(inputs.responses(spark, sf_dir)).select("request_id", "input_tokens", "output_tokens")


# One body per way of writing usage, with the counts that come of it (null: the response is ignored).
_USAGE_FORMS = """select event_id as request_id, case event_id % 10
    when 0 then concat('{"usage":{"prompt_tokens":', cast(event_id as string), ',"completion_tokens":7}}')
    when 1 then concat('{"Usage":{"Prompt_Tokens":', cast(event_id as string), ',"COMPLETION_TOKENS":7}}')
    when 2 then concat('{"usage":{"prompt_tokens":"', cast(event_id as string), '","completion_tokens":7}}')
    when 3 then concat('{"usage":{"prompt_tokens":', cast(event_id as string), '.0,"completion_tokens":7}}')
    when 4 then concat('{"usage":{"prompt_tokens":', cast(event_id as string), ',"completion_tokens":null}}')
    when 5 then concat('{"usage":{"prompt_tokens":', cast(event_id as string), ',"total_tokens":"x"}}')
    when 6 then concat('{"usage":{"prompt_tokens":', cast(event_id as string), ',"total_tokens":99999999999999999999}}')
    when 7 then concat('[{"usage":{"prompt_tokens":', cast(event_id as string), '}}]')
    when 8 then concat('{"usage":{"completion_tokens":-', cast(event_id as string), ',"PROMPT_tokens":1,"prompt_tokens":2}}')
    else concat('{"usage":{"prompt_tokens":1e3,"completion_tokens":', cast(event_id as string), '}}') end as body from events"""


@query(
    "usage_parse_forms",
    """select event_id as request_id, case event_id % 10 when 8 then 2 else event_id end as input_tokens,
      case event_id % 10 when 4 then 0 when 8 then -event_id else 7 end as output_tokens
    from events where event_id % 10 in (0, 1, 4, 8) and (event_id <> 0 or event_id % 10 <> 4)""",
)
def usage_parse_forms(spark, sf_dir):
    asked = inputs._derived(spark, sf_dir, "events", _USAGE_FORMS)
    return spend.parse_usage(asked).select("request_id", "input_tokens", "output_tokens")


@query(
    "usage_cost",
    f"with {_USAGE} select request_id, round({_COST.format(i='input_tokens', o='output_tokens')}, 9) as cost_usd from used",
)
def usage_cost(spark, sf_dir):
    usage = spend.with_cost(spend.parse_usage(inputs.responses(spark, sf_dir)))
    return usage.select("request_id", F.round("cost_usd", 9).alias("cost_usd"))


@query(
    "spend_by_user",
    f"""with {_SPEND} select user_name as "user", i as input_tokens, o as output_tokens, round({_COST.format(i='i', o='o')}, 9) as estimated_usd
    from per_user""",
)
def spend_by_user(spark, sf_dir):
    totals = spend.spend_by_user(_usage(spark, sf_dir))
    return totals.withColumn("estimated_usd", F.round("estimated_usd", 9))


@query(
    "spend_totals",
    f"""with {_SPEND} select cast(sum(i) as bigint) as total_input, cast(sum(o) as bigint) as total_output,
    round({_COST.format(i='sum(i)', o='sum(o)')}, 9) as total_usd from per_user""",
)
def spend_totals(spark, sf_dir):
    totals = spend.spend_totals(spend.parse_usage(inputs.responses(spark, sf_dir)))
    return totals.withColumn("total_usd", F.round("total_usd", 9))


@query(
    "spend_table",
    f"""with {_SPEND}, t as (select *, i + o as n, {_COST.format(i='i', o='o')} as usd from per_user)
    select user_name as "user", case when n >= 1000000 then concat(format('{{:.1f}}', n / 1000000 + case when n % 500000 = 250000 then 0.01 else 0 end), 'M')
      when n >= 1000 then concat(format('{{:.1f}}', n / 1000 + case when n % 500 = 250 then 0.01 else 0 end), 'K')
      else cast(n as string) end as tokens from t""",
)
def spend_table(spark, sf_dir):
    totals = spend.spend_by_user(_usage(spark, sf_dir))
    return totals.select(
        "user", formats.format_tokens(F.col("input_tokens") + F.col("output_tokens")).alias("tokens")
    )


@query(
    "user_group",
    """select cast(user_id as string) as "user", arg_max(event_type, (ts, event_id)) as "group" from events group by user_id""",
)
def user_group(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("group"), "ts",
        F.col("event_id").alias("request_id"),
    )
    return spend.user_group(log)


_BUDGET = "case seg when 'BUILDING' then 0.5 when 'MACHINERY' then 1.0 end"


def _groups(spark, sf_dir):
    return spend.user_group(inputs.usage_log(spark, sf_dir))


@query(
    "budget_status",
    f"""with {_SPEND}, s as (select p.user_name, g.seg, {_COST.format(i='i', o='o')} as spent, {_BUDGET} as budget
      from per_user p left join segs g on g.user_name = p.user_name)
    select user_name as "user", seg as "group", round(spent, 9) as spent_usd, budget as budget_usd,
      coalesce(spent >= budget, false) as exceeded,
      case when spent >= budget then concat('budget exceeded for group ', seg, ': $', format('{{:.2f}}', spent), ' / $', format('{{:.2f}}', budget)) end as message
    from s""",
)
def budget_status(spark, sf_dir):
    totals = spend.spend_by_user(_usage(spark, sf_dir))
    status = spend.budget_status(totals, _groups(spark, sf_dir), inputs.BUDGETS)
    return status.withColumn("spent_usd", F.round("spent_usd", 9))


@query(
    "budget_status_by_group",
    f"""with {_SPEND}, s as (select g.seg, {_COST.format(i='sum(i)', o='sum(o)')} as spent
      from per_user p join segs g on g.user_name = p.user_name group by g.seg)
    select seg as "group", round(spent, 9) as spent_usd, {_BUDGET} as budget_usd, coalesce(spent >= {_BUDGET}, false) as exceeded from s""",
)
def budget_status_by_group(spark, sf_dir):
    totals = spend.spend_by_user(_usage(spark, sf_dir))
    status = spend.budget_status(totals, _groups(spark, sf_dir), inputs.BUDGETS, scope="group")
    return status.select("group", F.round("spent_usd", 9).alias("spent_usd"), "budget_usd", "exceeded")


_GATE = f"""with {_USAGE}, log as (select e.event_id as request_id, e.ts, concat('user', cast(e.user_id as string)) as user_name,
    u.input_tokens as i, u.output_tokens as o from events e left join used u on u.request_id = e.event_id),
  run as (select l.request_id, g.seg,
    coalesce(sum(l.i) over w, 0) as i, coalesce(sum(l.o) over w, 0) as o from log l left join segs g on g.user_name = l.user_name
    window w as (partition by {{part}} order by l.ts, l.request_id rows between unbounded preceding and 1 preceding)),
  s as (select request_id, seg, {_COST.format(i='i', o='o')} as spent, {_BUDGET} as budget from run)
  select request_id, round(spent, 9) as spent_before, coalesce(spent >= budget, false) as refused from s"""


def _gate(spark, sf_dir, scope):
    counted = with_once(inputs.responses(spark, sf_dir), _u=spend.usage_of(F.col("body")))
    log = inputs.usage_log(spark, sf_dir, counted.select("request_id", "status", "_u.*"))
    gated = spend.budget_gate(log, inputs.BUDGETS, scope=scope)
    return gated.select(
        "request_id", F.round("spent_before", 9).alias("spent_before"), F.col("budget_error").isNotNull().alias("refused")
    )


@query("budget_gate", _GATE.format(part="l.user_name"))
def budget_gate(spark, sf_dir):
    return _gate(spark, sf_dir, "user")


@query("budget_gate_by_group", _GATE.format(part="g.seg"))
def budget_gate_by_group(spark, sf_dir):
    return _gate(spark, sf_dir, "group")


# ── Repeats and reuse ────────────────────────────────────────────────────────────────────────────


@query("content_keys", "select doc_id, sha256(text) as content_key from documents")
def content_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", reuse.content_key(F.col("text")).alias("content_key"))


@query("content_repeats", "select sha256(text) as content_key, count(*) as requests from documents group by 1")
def content_repeats(spark, sf_dir):
    return reuse.content_repeats(table(spark, sf_dir, "documents"), "text")


_TTL = 6 * 3600
_LOOKUPS = """select sha256(props) as key, event_id as id, epoch_us(ts) as us,
  event_type not in ('error', 'signup') as ok from events"""
_SERVED = sql.lifetimes(_LOOKUPS, _TTL * 1_000_000)


def _replayed(spark, sf_dir, ttl=_TTL):
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), "ts", reuse.content_key(F.col("props")).alias("content_key"),
        F.when(F.col("event_type").isin("error", "signup"), 503).otherwise(200).alias("status"),
    )
    return reuse.ttl_cache_hits(log, ttl_seconds=ttl)


@query(
    "ttl_cache_hits",
    f"""with {_SERVED} select id as request_id, coalesce(st[2] <> id, false) as hit, coalesce(st[2] = id, false) as stored, st[2] as source_id
    from served""",
)
def ttl_cache_hits(spark, sf_dir):
    return _replayed(spark, sf_dir).select("request_id", "hit", "stored", "source_id")


@query(
    "cache_stats",
    f"""with {_SERVED}, last as (select key, arg_max(st[2] is not null, (us, id)) as held from served group by key),
    n as (select count(*) as total, count_if(st[2] <> id) as hits from served)
    select hits, total - hits as misses, (select count_if(held) from last) as entries, cast(1000 as bigint) as max_entries,
      cast(floor(hits * 100.0 / total + 0.5) as bigint) as hit_rate from n""",
)
def cache_stats(spark, sf_dir):
    return reuse.cache_stats(_replayed(spark, sf_dir))


@query(
    "reuse_responses",
    f"""with {_SERVED}, answers as ({inputs.RESPONSES}) select s.id as request_id, s.st[2] as source_id, a.status, a.body
    from served s join answers a on a.request_id = s.st[2] where s.st[2] <> s.id""",
)
def reuse_responses(spark, sf_dir):
    return reuse.reuse_responses(_replayed(spark, sf_dir), inputs.responses(spark, sf_dir))


# ── Attempts ─────────────────────────────────────────────────────────────────────────────────────

_TRIES = f"""tries as ({inputs.ATTEMPTS_DUCK}),
marked as (select *, status is null or status in (429, 500, 502, 503, 504) as again,
  cast(case when attempt = 0 then 0 else 500 * (1 << (attempt - 1)) end as bigint) as wait from tries),
firsts as (select request_id, min((target_ord, attempt)) as pos from marked where not again group by request_id)"""


@query(
    "attempt_outcome",
    f"""with {_TRIES}, kept as (select m.*, f.pos from marked m left join firsts f on f.request_id = m.request_id
      where f.pos is null or (m.target_ord, m.attempt) <= f.pos)
    select request_id, any_value(pos) is not null as answered, max(case when not again then target end) as target,
      max(case when not again then status end) as status, cast(count(*) as integer) as attempts, cast(sum(wait) as bigint) as waited_ms,
      case when any_value(pos) is null then concat('all targets failed: max retries exhausted: ',
        arg_max(coalesce(concat('HTTP ', cast(status as string)), error, ''), (target_ord, attempt))) end as error
    from kept group by request_id""".replace("concat('HTTP ', cast(status as string))", "'HTTP ' || cast(status as string)"),
)
def attempt_outcome(spark, sf_dir):
    return attempts.attempt_outcome(inputs.attempts(spark, sf_dir))


@query(
    "fallback_usage",
    f"""with {_TRIES}, per_request as (
      select m.target, m.target_ord, m.request_id, count(*) as attempts, bool_or(not m.again) as answered
      from marked m left join firsts f on f.request_id = m.request_id
      where f.pos is null or (m.target_ord, m.attempt) <= f.pos group by m.target, m.target_ord, m.request_id)
    select target, count(*) as requests, cast(sum(attempts) as bigint) as attempts, count_if(answered) as answered,
      bool_or(target_ord > 0) as is_fallback from per_request group by target""",
)
def fallback_usage(spark, sf_dir):
    return attempts.fallback_usage(inputs.attempts(spark, sf_dir))


@query(
    "retry_waits",
    f"""with {_TRIES} select again as retryable, attempt, count(*) as tries, cast(sum(wait) as bigint) as wait_ms
    from marked group by again, attempt""",
)
def retry_waits(spark, sf_dir):
    rows = inputs.attempts(spark, sf_dir).withColumn("wait", attempts.backoff_ms(F.col("attempt")))
    return rows.groupBy(attempts.is_retryable(F.col("status")).alias("retryable"), "attempt").agg(
        F.count("*").alias("tries"), F.sum("wait").alias("wait_ms")
    )


# ── Providers ────────────────────────────────────────────────────────────────────────────────────

_PROVIDER = """case target when 'https://api.openai.com' then 'openai' when 'https://api.groq.com/openai' then 'groq'
  when 'http://localhost:11434' then 'ollama' else 'custom' end"""
_CATEGORY = """case target when 'https://api.openai.com' then 'foundation' when 'https://api.groq.com/openai' then 'infra'
  when 'http://localhost:11434' then 'local' else 'custom' end"""


@query(
    "with_provider",
    f"with req as ({inputs.REQUESTS}) select request_id, {_PROVIDER} as provider, {_CATEGORY} as provider_category from req",
)
def with_provider(spark, sf_dir):
    named = provider_catalog.with_provider(inputs.requests(spark, sf_dir))
    return named.select("request_id", "provider", "provider_category")


@query(
    "provider_search_usage",
    f"""with req as ({inputs.REQUESTS}) select {_PROVIDER} as provider, count(*) as requests from req
    where target in ('https://api.openai.com') group by 1""",
)
def provider_search_usage(spark, sf_dir):
    named = provider_catalog.with_provider(inputs.requests(spark, sf_dir))
    wanted = provider_catalog.search_providers(provider_catalog.providers(spark), " OpenAI ")
    kept = named.join(F.broadcast(wanted.select(F.col("id").alias("provider"))), "provider", "left_semi")
    return kept.groupBy("provider").agg(F.count("*").alias("requests"))


# ── Whole pipeline, audit, dashboard ─────────────────────────────────────────────────────────────

_SETTINGS = Settings(budgets=inputs.BUDGETS, rate_window_seconds=_SIX_HOURS, cache_ttl_seconds=_TTL)
_POLICY = Policy({"ssn": "block"})
_BODY = f"select request_id, body as text from ({inputs.REQUESTS})"
_DECIDED = f"""{_AUTH},
{sql.found(_BODY, 'request_id')},
kinds as (select request_id, type, min(start) as pos, count(*) as n from found group by request_id, type),
facts as (select request_id, cast(sum(n) as integer) as items, string_agg(type, ',' order by pos) as types,
  bool_or(type = 'SSN') as barred from kinds group by request_id),
base as (select a.*, epoch_us(a.ts) as us, coalesce(f.items, 0) as items, coalesce(f.types, '') as types,
  coalesce(f.barred, false) as barred from auth a left join facts f on f.request_id = a.request_id),
{sql.admissions("select request_id as id, user_id, us, rate_limit as lim0 from base where auth_error is null",
                'user_id', _SIX_HOURS * 1_000_000, 'lim0')},
entered as (select b.*, b.auth_error is null and p.id is null as limited from base b left join passed p on p.id = b.request_id),
used as ({inputs.USAGE}),
costed as (select e.*, case when auth_error is null and not limited and not barred then u.input_tokens end as i,
  case when auth_error is null and not limited and not barred then u.output_tokens end as o
  from entered e left join used u on u.request_id = e.request_id),
gated as (select *, coalesce(sum(i) over w, 0) as ib, coalesce(sum(o) over w, 0) as ob from costed
  window w as (partition by user_name order by ts, request_id rows between unbounded preceding and 1 preceding)),
budgeted as (select *, coalesce({_COST.format(i='ib', o='ob')} >= {_BUDGET}, false) as over_budget from gated),
answers as ({inputs.RESPONSES}),
{sql.lifetimes("select sha256(b.body) as key, b.request_id as id, b.us, a.status between 200 and 299 as ok "
               "from budgeted b join answers a on a.request_id = b.request_id "
               "where b.auth_error is null and not b.limited and not b.over_budget and not b.barred",
               _TTL * 1_000_000)},
decided as (select b.*, a.status, s.st[2] as src_id, case when b.auth_error is not null then 'auth_fail' when b.limited then 'rate_limited'
    when b.over_budget then 'over_budget' when b.barred then 'blocked'
    when coalesce(s.st[2] <> b.request_id, false) then 'cache_hit' else 'forwarded' end as outcome,
  strlen(a.body) + case when b.types like 'EMAIL%' and a.body like '%[EMAIL_1]%'
    then strlen(concat('user', substr(b.user_id0, 1), '@example.com')) - 9 else 0 end as sent
  from (select b.*, cast(e.user_id as string) as user_id0 from budgeted b join events e on e.event_id = b.request_id) b
  join answers a on a.request_id = b.request_id left join served s on s.id = b.request_id)"""


def _decisions(spark, sf_dir):
    return gateway.gateway_decisions(
        inputs.requests(spark, sf_dir), inputs.responses(spark, sf_dir), inputs.registry(spark, sf_dir),
        policy=_POLICY, rules=Rules().in_batches(), settings=_SETTINGS,
    )


@query(
    "gateway_decisions",
    f"""with {_DECIDED} select request_id, user_name as "user", outcome,
      cast(case outcome when 'auth_fail' then 401 when 'rate_limited' then 429 when 'over_budget' then 402 when 'blocked' then 403
        when 'cache_hit' then 200 else status end as integer) as code, items, types, src_id as source_id,
      case when outcome = 'forwarded' then sent end as sent_bytes from decided""",
)
def gateway_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir).select(
        "request_id", "user", "outcome", "code", "items", F.array_join("types", ",").alias("types"), "source_id",
        F.col("sent_bytes").cast("bigint").alias("sent_bytes"),
    )


@query("gateway_outcomes", f"with {_DECIDED} select outcome, count(*) as requests from decided group by outcome")
def gateway_outcomes(spark, sf_dir):
    return _decisions(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("requests"))


_EVENTS = f"""{_DECIDED}, ev as (select request_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as ts,
  case when outcome = 'auth_fail' then 'auth_fail' when outcome = 'blocked' then 'dlp_block' when items > 0 then 'redact' else 'pass' end as event,
  case when outcome = 'forwarded' and items > 0 then items end as items,
  case when outcome = 'blocked' then 'SSN' when outcome = 'forwarded' and items > 0 then types end as types, method, path, source as src,
  case when outcome = 'auth_fail' then auth_error when outcome = 'blocked' then 'Request blocked by DLP policy: contains SSN' end as msg
  from decided where outcome in ('auth_fail', 'blocked', 'forwarded'))"""


@query("audit_events", f"with {_EVENTS} select * from ev")
def audit_events(spark, sf_dir):
    events = audit.audit_events(_decisions(spark, sf_dir))
    return events.withColumn("types", F.array_join("types", ","))


@query(
    "audit_rollup_hourly",
    f"""with {_EVENTS} select substr(ts, 1, 13) as hour, event, count(*) as events, cast(coalesce(sum(items), 0) as bigint) as items
    from ev group by 1, 2""",
)
def audit_rollup_hourly(spark, sf_dir):
    rolled = audit.audit_rollup(audit.audit_events(_decisions(spark, sf_dir)), ["event"])
    return rolled.withColumn("hour", F.date_format("bucket", "yyyy-MM-dd'T'HH")).drop("bucket")


@query(
    "audit_rollup_by_type",
    f"""with {_EVENTS}, t as (select event, items, unnest(string_split(types, ',')) as type from ev where types is not null
      union all select event, items, null from ev where types is null)
    select event, type, count(*) as events, cast(coalesce(sum(items), 0) as bigint) as items from t group by event, type""",
)
def audit_rollup_by_type(spark, sf_dir):
    return audit.audit_rollup(audit.audit_events(_decisions(spark, sf_dir)), ["event", "type"], bucket=None)


@query(
    "live_totals",
    f"""with {_DECIDED} select count(*) as requests,
    cast(coalesce(sum(case when outcome = 'forwarded' then items end), 0) as bigint) as redacted from decided""",
)
def live_totals(spark, sf_dir):
    return audit.live_totals(_decisions(spark, sf_dir))


_ACTIVITY = f"""{_DECIDED}, acts as (
  select request_id, ts, 0 as step, case outcome when 'auth_fail' then 'AUTH' when 'rate_limited' then 'RATE' when 'over_budget' then 'BUDGET'
      when 'blocked' then 'DLP' when 'cache_hit' then 'CACHE' else 'REDACT' end as type,
    case outcome when 'auth_fail' then 'Rejected: ' || auth_error when 'rate_limited' then 'Rate limited: ' || user_name
      when 'over_budget' then 'Budget exceeded: ' || user_name when 'blocked' then 'Request blocked by DLP policy: contains SSN'
      when 'cache_hit' then concat('Cache hit for ', method, ' ', path) else concat('Redacted ', items, ' PII item(s)') end as message
  from decided where outcome <> 'forwarded' or items > 0
  union all select request_id, ts, 1, case when items > 0 then 'RESTORE' else 'PASS' end,
    case when items > 0 then concat('Restored ', items, ' token(s) in response (', sent, ' bytes)')
      else concat('Proxied ', method, ' ', path, ' (', sent, ' bytes)') end from decided where outcome = 'forwarded')"""


@query("activity", f"with {_ACTIVITY} select request_id, step, type, message from acts")
def activity(spark, sf_dir):
    return audit.activity(_decisions(spark, sf_dir)).select("request_id", "step", "type", "message")


@query(
    "recent_activity",
    f"with {_ACTIVITY} select request_id, step, type, message from acts order by ts desc, request_id desc, step desc limit 50",
)
def recent_activity(spark, sf_dir):
    return audit.recent_activity(_decisions(spark, sf_dir)).select("request_id", "step", "type", "message")


@query(
    "dashboard",
    f"""with {_DECIDED}, sent_on as (select request_id as id, body, outcome, ts, src_id from decided where outcome in ('cache_hit', 'forwarded')),
    last as (select body, arg_max(src_id is not null, (ts, id)) as held from sent_on group by body),
    s as (select cast(sum(u.input_tokens) as bigint) as i, cast(sum(u.output_tokens) as bigint) as o from decided d
      join used u on u.request_id = d.request_id where d.outcome = 'forwarded')
    select (select count(*) from decided) as requests,
      (select cast(sum(items) as bigint) from decided where outcome = 'forwarded') as redacted,
      (select count(*) from decided where outcome = 'rate_limited') as blocked_by_rate,
      (select count(*) from sent_on where outcome = 'cache_hit') as hits, (select count(*) from sent_on where outcome = 'forwarded') as misses,
      (select count(*) from last where held) as entries, i as total_input, o as total_output,
      format('${{:.4f}}', {_COST.format(i='i', o='o')}) as spend_text from s""",
)
def dashboard(spark, sf_dir):
    return audit.dashboard(_decisions(spark, sf_dir), _SETTINGS).select(
        "requests", "redacted", "blocked_by_rate", "hits", "misses", "entries", "total_input", "total_output", "spend_text"
    )


@query(
    "error_payloads",
    f"""with {_DECIDED} select request_id, concat('{{"error":{{"code":', case outcome when 'auth_fail' then 401 when 'rate_limited' then 429
      when 'over_budget' then 402 else 403 end, ',"message":"', case outcome when 'auth_fail' then auth_error
      when 'rate_limited' then concat('rate limit exceeded: ', rate_limit, ' requests/min for user ', user_id)
      when 'over_budget' then concat('budget exceeded for group ', seg, ': $', format('{{:.2f}}', {_COST.format(i='ib', o='ob')}), ' / $', format('{{:.2f}}', {_BUDGET}))
      else 'Request blocked by DLP policy: contains SSN' end, '","type":"gateway_error"}}}}') as payload
    from decided where outcome not in ('forwarded', 'cache_hit')""",
)
def error_payloads(spark, sf_dir):
    refused = _decisions(spark, sf_dir).filter(~F.col("outcome").isin("forwarded", "cache_hit"))
    return refused.select("request_id", formats.error_payload(F.col("code"), F.col("message")).alias("payload"))


@query(
    "time_since_previous",
    """with g as (select event_id, cast(floor((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1000000) as bigint) as s from events)
    select event_id, case when s < 60 then concat(s, 's') when s < 3600 then concat(s // 60, 'm ', s % 60, 's')
      else concat(s // 3600, 'h ', (s % 3600) // 60, 'm') end as gap from g where s is not null""",
)
def time_since_previous(spark, sf_dir):
    from pyspark.sql import Window

    log = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    micros = F.unix_micros("ts") - F.unix_micros(before)
    rows = log.withColumn("s", F.floor(micros / 1_000_000)).filter("s is not null")
    return rows.select("event_id", formats.format_duration(F.col("s")).alias("gap"))
