"""What a gateway decides about each request of a log, step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import empty_array
from ..functions.rules import Rules
from ..functions.spans import ANY_PLACEHOLDER, match_types
from ..settings import DEFAULTS, Settings, cut_lineage
from .access import authenticate, rate_limit
from .base import with_once, with_tokens
from .policy import Policy, policy_result
from .reuse import content_key, ttl_cache_hits
from .spend import budget_gate, usage_of

OUTCOMES = ("auth_fail", "rate_limited", "over_budget", "blocked", "cache_hit", "forwarded", "failed")
_GROWTH = "struct<token:string,bytes:int>"


def request_facts(requests: DataFrame, policy: Policy, rules: Rules, key_columns: tuple[str, ...]) -> DataFrame:
    """Everything later steps need from a body, as narrow columns; the body itself goes no further."""
    text = F.col("body")
    numbered = with_tokens(requests, "body", rules, "_t")
    growth = F.array_distinct(
        F.transform(
            "_t",
            lambda m: F.struct(
                m["token"].alias("token"),
                (F.octet_length(m["value"]) - F.octet_length(m["token"])).alias("bytes"),
            ),
        )
    )
    return numbered.select(
        "request_id", "ts", "method", "path", "source", "authorization",
        content_key(text, *[F.col(c) for c in key_columns]).alias("content_key"),
        F.size("_t").alias("items"), match_types(F.col("_t")).alias("types"),
        policy_result(F.col("_t"), policy).alias("policy"), growth.alias("growth"),
    )


def response_facts(responses: DataFrame) -> DataFrame:
    body = F.col("body")
    # Values alone, without places: one run of the pattern, and none over a text without brackets.
    tokens = F.when(body.contains("["), F.regexp_extract_all(body, F.lit(ANY_PLACEHOLDER), F.lit(0))).otherwise(empty_array("string"))
    rows = with_once(responses.select("request_id", "status", "body"), _u=usage_of(body), placeholders=tokens)
    return rows.select(
        "request_id", "status", F.octet_length(body).alias("response_bytes"), "placeholders",
        F.col("_u.input_tokens").alias("input_tokens"), F.col("_u.output_tokens").alias("output_tokens"),
    )


def gateway_decisions(
    requests: DataFrame,
    responses: DataFrame,
    users: DataFrame | None = None,
    policy: Policy = Policy(),
    rules: Rules = Rules(),
    settings: Settings = DEFAULTS,
    use_cache: bool = True,
    key_columns: tuple[str, ...] = (),
    open_if_empty: bool = False,
) -> DataFrame:
    """One row per request with its outcome; the first failing step decides.

    Steps: authentication (401), rate limit (429), budget (402), policy (403), cache, forwarding (the
    response's status, or 502 without a response). ``responses`` holds what upstream answered; a log in
    which cache hits have no response replays exactly. In a what-if replay where every request has one,
    the budget also counts the usage of requests the cache would have served.

    Bodies are read once, next to the source. What is known of a request is written once to the scratch folder,
    without its header; the replay steps, which read their input several times, work on a few narrow columns of it,
    and their verdicts are joined back by ``request_id``, which must be unique.
    """
    facts = request_facts(requests, policy, rules, key_columns).join(
        response_facts(responses), "request_id", "left"
    )
    if users is not None:
        facts = authenticate(facts, users, open_if_empty=open_if_empty).drop("authorization")
    else:
        facts = facts.drop("authorization").withColumns(
            {
                "user_id": F.lit(None).cast("string"), "user": F.lit("anonymous"),
                "group": F.lit("default"), "auth_error": F.lit(None).cast("string"),
                "rate_limit": F.lit(None).cast("int"),
            }
        )
    facts = cut_lineage(facts, "facts")
    steps = facts.select(
        "request_id", "ts", "user_id", "user", "group", "rate_limit", "auth_error", "content_key", "status",
        F.col("policy.blocked").alias("blocked"), "input_tokens", "output_tokens",
    )
    if users is not None:
        steps = rate_limit(steps, window_seconds=settings.rate_window_seconds)
    else:
        steps = steps.withColumn("rate_error", F.lit(None).cast("string"))
    entered = F.col("auth_error").isNull() & F.col("rate_error").isNull()
    upstream = entered & ~F.col("blocked")
    if users is not None and settings.budgets:
        steps = steps.withColumns(
            {
                "input_tokens": F.when(upstream, F.col("input_tokens")),
                "output_tokens": F.when(upstream, F.col("output_tokens")),
                # Requests let in without a key have no budget.
                "_group": F.when(F.col("user_id").isNotNull(), F.col("group")),
            }
        )
        steps = budget_gate(
            steps, settings.budgets, group="_group", price_in=settings.price_in, price_out=settings.price_out
        )
    else:
        steps = steps.withColumn("budget_error", F.lit(None).cast("string"))
    asked = F.when(upstream & F.col("budget_error").isNull(), F.col("content_key"))
    steps = steps.select("request_id", "ts", "status", "rate_error", "budget_error", asked.alias("asked"))
    if use_cache:
        steps = ttl_cache_hits(cut_lineage(steps, "budgeted"), key="asked", ttl_seconds=settings.cache_ttl_seconds)
    else:
        steps = steps.withColumns(
            {"hit": F.lit(False), "stored": F.lit(False), "source_id": F.lit(None).cast("bigint"),
             "source_status": F.lit(None).cast("int")}
        )
    rows = facts.join(steps.drop("ts", "status", "asked"), "request_id")
    upstream = F.col("auth_error").isNull() & F.col("rate_error").isNull() & ~F.col("policy.blocked")
    rows = rows.withColumns(
        {
            "input_tokens": F.when(upstream, F.col("input_tokens")),
            "output_tokens": F.when(upstream, F.col("output_tokens")),
        }
    )
    outcome = (
        F.when(F.col("auth_error").isNotNull(), "auth_fail")
        .when(F.col("rate_error").isNotNull(), "rate_limited")
        .when(F.col("budget_error").isNotNull(), "over_budget")
        .when(F.col("policy.blocked"), "blocked")
        .when(F.col("hit"), "cache_hit")
        .when(F.col("status").isNotNull(), "forwarded")
        .otherwise("failed")
    )
    code = (
        F.when(F.col("outcome") == "auth_fail", 401)
        .when(F.col("outcome") == "rate_limited", 429)
        .when(F.col("outcome") == "over_budget", 402)
        .when(F.col("outcome") == "blocked", 403)
        .when(F.col("outcome") == "failed", 502)
        .when(F.col("outcome") == "cache_hit", F.col("source_status"))
        .otherwise(F.col("status"))
    )
    message = F.coalesce("auth_error", "rate_error", "budget_error", F.col("policy.message"))
    grown = F.aggregate(
        F.transform(
            F.coalesce("placeholders", empty_array("string")),
            lambda p: F.coalesce(
                F.get(F.filter("growth", lambda g: g["token"] == p), F.lit(0))["bytes"], F.lit(0)
            ),
        ),
        F.lit(0),
        lambda total, n: total + n,
    )
    out = rows.withColumn("outcome", outcome)
    return out.select(
        "request_id", "ts", "method", "path", "source", "user_id", "user", "group", "outcome",
        code.cast("int").alias("code"), message.alias("message"), "content_key", "hit", "stored", "source_id",
        "items", "types", F.col("policy.blocked_types").alias("blocked_types"),
        F.when(F.col("outcome") == "forwarded", F.col("input_tokens")).alias("input_tokens"),
        F.when(F.col("outcome") == "forwarded", F.col("output_tokens")).alias("output_tokens"),
        F.when(F.col("outcome") == "forwarded", F.col("response_bytes") + grown).alias("sent_bytes"),
    )
