"""Outcomes of retried and re-routed requests, from an attempt log.

attempts: request_id, target_ord, target, attempt (from 0), status (null = transport error), error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS

# Statuses worth another attempt.
RETRYABLE = (429, 500, 502, 503, 504)


def is_retryable(status: Column) -> Column:
    """True for these statuses and for a transport error (null status)."""
    return status.isNull() | status.isin(*RETRYABLE)


def backoff_ms(attempt: Column, base: int = DEFAULTS.backoff_ms) -> Column:
    """Wait before attempt k of a target: nothing before the first, then doubling from ``base``."""
    base = base if base > 0 else DEFAULTS.backoff_ms
    doubled = F.lit(base).cast("bigint") * F.pow(F.lit(2), attempt - 1).cast("bigint")
    return F.when(attempt > 0, doubled).otherwise(F.lit(0).cast("bigint"))


def _within(attempts: DataFrame, max_retries: int | None) -> DataFrame:
    if max_retries is None:
        return attempts
    allowed = max_retries if max_retries > 0 else DEFAULTS.max_retries
    return attempts.filter(F.col("attempt") <= allowed)


def attempt_outcome(
    attempts: DataFrame, max_retries: int | None = None, base: int = DEFAULTS.backoff_ms
) -> DataFrame:
    """One row per request: the first final answer in (target, attempt) order, or that all targets failed.

    Attempts after that answer do not count. Every logged attempt takes part; ``max_retries`` asks what would
    have come out had each target been tried again so many times at most.
    """
    place = [F.col("target_ord"), F.col("attempt")]
    final = F.struct(*place, F.col("target"), F.col("status"))
    last = F.struct(*place, F.col("status"), F.col("error"))
    rows = _within(attempts, max_retries).withColumn(
        "_final", F.when(~is_retryable(F.col("status")), final)
    )
    # The set of places is bounded by targets x (retries + 1), so one partial aggregate carries it.
    out = rows.groupBy("request_id").agg(
        F.min("_final").alias("_f"),
        F.max(last).alias("_l"),
        F.collect_set(F.struct(*place, backoff_ms(F.col("attempt"), base).alias("wait"))).alias("_tries"),
    )
    counted = F.filter(
        "_tries",
        lambda t: F.col("_f").isNull()
        | (F.struct(t["target_ord"], t["attempt"]) <= F.struct(F.col("_f.target_ord"), F.col("_f.attempt"))),
    )
    cause = F.coalesce(
        F.concat(F.lit("HTTP "), F.col("_l.status").cast("string")), F.col("_l.error"), F.lit("transport error")
    )
    failed = F.concat(F.lit("all targets failed: max retries exhausted: "), cause)
    return out.withColumn("_c", counted).select(
        "request_id",
        F.col("_f").isNotNull().alias("answered"),
        F.col("_f.target").alias("target"),
        F.col("_f.status").alias("status"),
        F.size("_c").alias("attempts"),
        F.aggregate("_c", F.lit(0).cast("bigint"), lambda acc, t: acc + t["wait"]).alias("waited_ms"),
        F.when(F.col("_f").isNull(), failed).alias("error"),
    )


def fallback_usage(attempts: DataFrame, max_retries: int | None = None) -> DataFrame:
    """Per target: requests that tried it, attempts made, requests it answered.

    Attempts after a request's first final answer do not count, as in ``attempt_outcome``.
    """
    place = F.struct("target_ord", "attempt")
    final = ~is_retryable(F.col("status"))
    tries = F.struct("target_ord", "attempt", "target", final.alias("final"))
    # As many as targets x tries, so a request's attempts fit into one row.
    whole = _within(attempts, max_retries).groupBy("request_id").agg(
        F.min(F.when(final, place)).alias("_f"), F.collect_list(tries).alias("_tries")
    )
    counted = F.filter(
        "_tries",
        lambda t: F.col("_f").isNull() | (F.struct(t["target_ord"], t["attempt"]) <= F.struct(F.col("_f.target_ord"), F.col("_f.attempt"))),
    )
    made = whole.select("request_id", F.inline(counted))
    per_request = made.groupBy("target", "target_ord", "request_id").agg(
        F.count("*").alias("attempts"), F.max("final").alias("answered")
    )
    return per_request.groupBy("target").agg(
        F.count("*").alias("requests"), F.sum("attempts").alias("attempts"),
        F.count_if("answered").alias("answered"), F.max(F.col("target_ord") > 0).alias("is_fallback"),
    )
