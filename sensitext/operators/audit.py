"""Audit events, activity and dashboard figures, from gateway decisions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import format_tokens, format_usd, percent
from ..settings import DEFAULTS
from .base import explode_rows, with_once
from .spend import cost_usd, spend_by_user

EVENT = (
    "ts string, event string, items int, types array<string>, method string, path string, src string, msg string"
)
UPSTREAM_FAILED = "Upstream failed: "


def rfc3339(ts: Column) -> Column:
    """Whole seconds in UTC, whatever the session's time zone."""
    utc = F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _event(name: str, items=None, types=None, src=None, msg=None) -> Column:
    nothing = F.lit(None)
    return F.struct(
        F.lit(name).alias("event"),
        (nothing if items is None else items).cast("int").alias("items"),
        (nothing if types is None else types).cast("array<string>").alias("types"),
        (nothing if src is None else src).cast("string").alias("src"),
        (nothing if msg is None else msg).cast("string").alias("msg"),
    )


def audit_events(decisions: DataFrame, error: str | None = None) -> DataFrame:
    """The events of each decision: auth_fail, dlp_block, redact or pass, and error where upstream failed.

    Rate-limited, over-budget and cache-served requests leave no event. Only types and counts are
    recorded, never values. ``error`` names a column with the upstream error text.
    """
    outcome, src = F.col("outcome"), F.col("source")
    cause = F.col(error) if error else F.lit("no response")
    sent = outcome.isin("forwarded", "failed")
    listed = F.array_compact(
        F.array(
            F.when(outcome == "auth_fail", _event("auth_fail", src=src, msg=F.col("message"))),
            F.when(
                outcome == "blocked",
                _event("dlp_block", types=F.col("blocked_types"), src=src, msg=F.col("message")),
            ),
            F.when(
                sent & (F.col("items") > 0),
                _event("redact", items=F.col("items"), types=F.col("types"), src=src),
            ),
            F.when(sent & (F.col("items") == 0), _event("pass", src=src)),
            F.when(
                outcome == "failed", _event("error", msg=F.concat(F.lit(UPSTREAM_FAILED), cause))
            ),
        )
    )
    rows = explode_rows(
        with_once(decisions.withColumn("_ts", rfc3339(F.col("ts"))), _e=listed),
        ["request_id", "_ts", "method", "path"], "_e", "event",
    )
    return rows.select(
        "request_id", F.col("_ts").alias("ts"), "event", "items", "types", "method", "path", "src", "msg"
    )


def audit_rollup(events: DataFrame, by: list[str], bucket: str | None = "1 hour") -> DataFrame:
    """Events and redacted items per time bucket and per ``by`` (event, type, path, src ...).

    ``type`` counts an event once for each type in it.
    """
    rows = events.withColumn("_at", F.to_timestamp("ts"))
    if "type" in by:
        rows = rows.withColumn("type", F.explode_outer("types"))
    keys = [F.col(c) for c in by]
    if bucket:
        keys.insert(0, F.window("_at", bucket).getField("start").alias("bucket"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("events"), F.coalesce(F.sum("items"), F.lit(0)).alias("items")
    )


def live_totals(decisions: DataFrame) -> DataFrame:
    """One row: requests seen and items redacted in requests that were sent on."""
    sent = F.col("outcome").isin("forwarded", "failed")
    return decisions.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum(F.when(sent, F.col("items"))), F.lit(0)).alias("redacted"),
    )


def activity(decisions: DataFrame, error: str | None = None) -> DataFrame:
    """The activity lines of each decision: request_id, ts, step, type, message."""
    outcome = F.col("outcome")
    cause = F.col(error) if error else F.lit("no response")
    sent = outcome.isin("forwarded", "failed")

    def line(step: int, kind: str, text: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("type"), text.alias("message"))

    def fmt(pattern: str, *args: str) -> Column:
        return F.format_string(pattern, *[F.col(a) for a in args])

    listed = F.array_compact(
        F.array(
            F.when(outcome == "auth_fail", line(0, "AUTH", fmt("Rejected: %s", "message"))),
            F.when(outcome == "rate_limited", line(0, "RATE", fmt("Rate limited: %s", "user"))),
            F.when(outcome == "over_budget", line(0, "BUDGET", fmt("Budget exceeded: %s", "user"))),
            F.when(outcome == "blocked", line(0, "DLP", F.col("message"))),
            F.when(outcome == "cache_hit", line(0, "CACHE", fmt("Cache hit for %s %s", "method", "path"))),
            F.when(sent & (F.col("items") > 0), line(0, "REDACT", fmt("Redacted %d PII item(s)", "items"))),
            F.when(outcome == "failed", line(1, "ERROR", F.concat(F.lit(UPSTREAM_FAILED), cause))),
            F.when(
                (outcome == "forwarded") & (F.col("items") > 0),
                line(1, "RESTORE", fmt("Restored %d token(s) in response (%d bytes)", "items", "sent_bytes")),
            ),
            F.when(
                (outcome == "forwarded") & (F.col("items") == 0),
                line(1, "PASS", fmt("Proxied %s %s (%d bytes)", "method", "path", "sent_bytes")),
            ),
        )
    )
    return explode_rows(with_once(decisions, _l=listed), ["request_id", "ts"], "_l", "type")


def recent_activity(decisions: DataFrame, last: int = DEFAULTS.recent_activity, error: str | None = None):
    """The last lines of activity, oldest first."""
    newest = activity(decisions, error).orderBy(F.desc("ts"), F.desc("request_id"), F.desc("step")).limit(last)
    return newest.orderBy("ts", "request_id", "step")


def dashboard(
    decisions: DataFrame, settings=DEFAULTS, features: Mapping[str, bool] | None = None
) -> DataFrame:
    """One row with totals, cache and spend figures, in one pass over the decisions.

    ``features`` (auth, cache, retry, spend, dlp: on or off) is carried along as ``feature_*`` columns.

    Everything is summed per content key first, because the number of stored responses needs each key's
    last request; requests that never reached the cache share the null key.
    """
    outcome = F.col("outcome")
    asked = outcome.isin("cache_hit", "forwarded", "failed")
    key = F.when(asked, F.col("content_key"))
    held = F.struct("ts", "request_id", (F.col("hit") | F.col("stored")).alias("held"))
    per_key = decisions.groupBy(key.alias("key")).agg(
        F.count("*").alias("requests"),
        F.sum(F.when(outcome.isin("forwarded", "failed"), F.col("items"))).alias("redacted"),
        F.count_if(outcome.isin("blocked", "cache_hit", "forwarded", "failed")).alias("accepted"),
        F.count_if(outcome == "rate_limited").alias("blocked_by_rate"),
        F.count_if(outcome == "cache_hit").alias("hits"),
        F.count_if(outcome.isin("forwarded", "failed")).alias("misses"),
        F.max(F.when(asked, held)).alias("last"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0).cast("bigint"))

    figures = per_key.agg(
        *[total(c).alias(c) for c in ("requests", "redacted", "accepted", "blocked_by_rate", "hits", "misses")],
        F.count_if("last.held").alias("entries"),
        F.lit(settings.cache_max_entries).cast("bigint").alias("max_entries"),
        total("input_tokens").alias("total_input"),
        total("output_tokens").alias("total_output"),
    )
    spent = cost_usd(F.col("total_input"), F.col("total_output"), settings.price_in, settings.price_out)
    return figures.withColumns(
        {"hit_rate": percent(F.col("hits"), F.col("hits") + F.col("misses")), "total_usd": spent}
    ).withColumns(
        {
            "spend_text": format_usd(F.col("total_usd")),
            "input_text": format_tokens(F.col("total_input")),
            "output_text": format_tokens(F.col("total_output")),
            **{f"feature_{name}": F.lit(on) for name, on in (features or {}).items()},
        }
    )


def spend_table(decisions: DataFrame, settings=DEFAULTS) -> DataFrame:
    """Per user: tokens and cost as the dashboard shows them."""
    used = decisions.filter("input_tokens is not null or output_tokens is not null")
    return spend_by_user(used, "user", settings.price_in, settings.price_out).select(
        "user", format_tokens(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        format_usd(F.col("estimated_usd")).alias("cost"),
    )
