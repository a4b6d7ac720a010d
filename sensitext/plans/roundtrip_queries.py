"""Registered queries that write logs and registries and read them back, and cases the other tables do not hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.rules import BUILTIN, Rule, Rules
from ..operators import access, detect, registry
from ..settings import scratch_folder
from ..sources import tables
from . import inputs, sql
from .inputs import table
from .log_queries import _EXPIRES, _KEYS, _expires
from .registered import query
from .text_queries import SPANS


def _folder(spark, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "registry_roundtrip",
    f"""with k as ({_KEYS}) select user_id, user_name as "user", seg as "group", rate_limit, cast(j as integer) as position,
    token_key, 'api-key' as label, {_EXPIRES}, revoked from k""",
)
def registry_roundtrip(spark, sf_dir):
    """The whole registry, every token of it, as it comes back from a snapshot."""
    folder = _folder(spark, "registry")
    tables.write_registry(inputs.registry(spark, sf_dir), folder)
    flat = registry.flatten_registry(tables.read_registry(spark, folder, multi_line=False))
    return flat.select("user_id", "user", "group", "rate_limit", "position", "token_key", "label", _expires(), "revoked")


@query(
    "registry_replaced",
    f"""with k as ({_KEYS}) select user_id, user_name as "user", token_key, revoked or substr(user_id, 3)::int % 10 = 3 as revoked from k""",
)
def registry_replaced(spark, sf_dir):
    """Two versions of the registry in one folder and a third whose writer died before it came into force: the second counts."""
    folder = _folder(spark, "registry")
    first = inputs.registry(spark, sf_dir)
    tables.publish_registry(first, folder)
    gone = F.substring("id", 3, 20).cast("int") % 10 == 3
    second = first.withColumn("tokens", F.transform("tokens", lambda t: t.withField("revoked", t["revoked"] | gone)))
    tables.publish_registry(second, folder)
    tables.write_registry(first.withColumn("name", F.lit("never")), f"{folder}/snapshot-died")
    flat = registry.flatten_registry(tables.current_registry(spark, folder))
    return flat.select("user_id", "user", "token_key", "revoked")


@query(
    "requests_roundtrip",
    f"""select request_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at, method, path, source, "authorization", target, body
    from ({inputs.REQUESTS})""",
)
def requests_roundtrip(spark, sf_dir):
    folder = _folder(spark, "requests")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    inputs.requests(spark, sf_dir).withColumn("ts", text).write.json(folder)
    read = tables.read_requests(spark, folder).filter(F.col(tables.CORRUPT).isNull())
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")
    return read.select("request_id", at, "method", "path", "source", "authorization", "target", "body")


@query("responses_roundtrip", f"select request_id, status, body from ({inputs.RESPONSES})")
def responses_roundtrip(spark, sf_dir):
    """Gzip-compressed lines are read as they are."""
    folder = _folder(spark, "responses")
    inputs.responses(spark, sf_dir).write.option("compression", "gzip").json(folder)
    return tables.read_responses(spark, folder).select("request_id", "status", "body")


_EVENTS = """select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as ts, event_type as event, cast(user_id % 3 as int) as items,
  case when user_id % 4 = 0 then 'SSN,EMAIL' when user_id % 4 = 1 then '' else 'SSN' end as types, props as msg from events"""


@query(
    "audit_roundtrip",
    f"""select ts, event, case when items <> 0 then items end as items, case when types <> '' then types end as types,
    'POST' as method, cast(null as varchar) as src, msg from ({_EVENTS})""",
)
def audit_roundtrip(spark, sf_dir):
    """Events as JSON Lines and back: empty fields are left out, so they come back null."""
    folder = _folder(spark, "audit")
    rows = table(spark, sf_dir, "events")
    listed = F.when(F.col("user_id") % 4 == 0, F.array(F.lit("SSN"), F.lit("EMAIL"))).when(
        F.col("user_id") % 4 == 1, F.array().cast("array<string>")
    ).otherwise(F.array(F.lit("SSN")))
    events = rows.select(
        tables.rfc3339(F.col("ts")).alias("ts"), F.col("event_type").alias("event"), (F.col("user_id") % 3).cast("int").alias("items"),
        listed.alias("types"), F.lit("POST").alias("method"), F.lit("").alias("path"), F.lit("").alias("src"), F.col("props").alias("msg"),
    )
    tables.write_audit(events, folder)
    read = tables.read_audit(spark, folder)
    return read.select("ts", "event", "items", F.array_join("types", ",").alias("types"), "method", "src", "msg")


_CHANGING = "select event_id as id, user_id % 20 as user_id, epoch_us(ts) as us, 1 + event_id % 3 as lim0 from events"


@query(
    "rate_limit_changing_limit",
    f"""with asked as ({_CHANGING}),
    lines as (select user_id, list({{'t': us, 'recent': [us], 'ok': [id], 'lim': lim0}} order by us, id) as l from asked group by user_id),
    ran as (select user_id, list_reduce(l, lambda acc, x: case
        when len(list_filter(acc.recent, lambda a: a > x.t - 3600000000)) < x.lim
        then {{'t': x.t, 'recent': list_filter(acc.recent, lambda a: a > x.t - 3600000000) || x.recent, 'ok': acc.ok || x.ok, 'lim': x.lim}}
        else {{'t': x.t, 'recent': list_filter(acc.recent, lambda a: a > x.t - 3600000000), 'ok': acc.ok, 'lim': x.lim}} end) as r from lines),
    passed as (select unnest(r.ok) as id from ran)
    select e.event_id as request_id, p.id is not null as admitted from events e left join passed p on p.id = e.event_id""",
)
def rate_limit_changing_limit(spark, sf_dir):
    """Every request carries the limit that held when it came."""
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), "ts", (F.col("user_id") % 20).alias("user_id"),
        (1 + F.col("event_id") % 3).cast("int").alias("rate_limit"),
    )
    return access.rate_limit(log, window_seconds=3600).select("request_id", "admitted")


_OPTIONAL = Rules(rules=(*BUILTIN, Rule("ORDER_ID", r"\b(?:555-)?\d{4}\b")))


@query(
    "custom_rule_optional_prefix",
    f"with {sql.found(inputs.CUSTOMERS, 'c_custkey', _OPTIONAL)} select c_custkey, {SPANS} from found",
)
def custom_rule_optional_prefix(spark, sf_dir):
    """A word boundary before a group that may be missing."""
    rules = Rules().add("ORDER_ID", r"\b(?:555-)?\d{4}\b", spark)
    return detect.findings(inputs.customers(spark, sf_dir), ["c_custkey"], rules=rules.in_batches())
