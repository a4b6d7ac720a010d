"""Authentication and rate limits replayed over a request log."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, cut_lineage
from .base import run_splitter
from .registry import active_tokens, token_history

MISSING = "missing or invalid Authorization header"
INVALID = "invalid API key"
EXPIRED = "token expired"
ANONYMOUS, DEFAULT_GROUP = "anonymous", "default"


def bearer_token(header: Column) -> Column:
    """The key of a ``Bearer``/``bearer`` header; null for any other header."""
    return F.when(header.rlike(r"\A[Bb]earer "), F.substring(header, F.lit(8), F.length(header)))


def _marked(keys: DataFrame) -> DataFrame:
    return keys.select(*[F.col(c).alias(f"_{c}") for c in keys.columns])


def _judged(joined: DataFrame, ts: str) -> tuple[DataFrame, dict[str, Column]]:
    """Requests beside the key they gave: with ``auth_error``, and what the accepted ones are identified by."""
    error = (
        F.when(F.col("_key").isNull(), F.lit(MISSING))
        .when(F.col("_user_id").isNull(), F.lit(INVALID))
        .when(F.col(ts).cast("timestamp") > F.col("_expires_at"), F.lit(EXPIRED))
    )
    accepted = F.col("auth_error").isNull()
    identity = {c: F.when(accepted, F.col(f"_{c}")) for c in ("user_id", "user", "group", "rate_limit")}
    return joined.withColumn("auth_error", error), identity


def authenticate_as_of(
    requests: DataFrame, registry: DataFrame, changes: DataFrame, header: str = "authorization", ts: str = "ts"
) -> DataFrame:
    """``authenticate`` by the registry as it stood when each request came: ``registry`` at first, then with ``changes``.

    A key that was not yet granted, or no longer, is an invalid key; a change holds for requests of its own instant.
    Keys carry the intervals in which they hold (``token_history``), which do not overlap, so a request meets at most
    one. The join is an equi-join on the key with the interval as a condition: a key that sends most of the requests
    is split like any skewed key. Requests without a time match no interval with a beginning or an end.
    """
    k = _marked(token_history(registry, changes))
    at = F.col(ts).cast("timestamp")
    begun = F.col("_valid_from").isNull() | (F.col("_valid_from") <= at)
    holds = (F.col("_key") == F.col("_token_key")) & begun & (F.col("_valid_until").isNull() | (at < F.col("_valid_until")))
    out, identity = _judged(requests.withColumn("_key", bearer_token(F.col(header))).join(k, holds, "left"), ts)
    return out.withColumns(identity).drop("_key", *k.columns)


def authenticate(
    requests: DataFrame, users: DataFrame, header: str = "authorization", ts: str = "ts",
    open_if_empty: bool = False,
) -> DataFrame:
    """Adds user_id, user, group, rate_limit and ``auth_error`` (null = accepted), judged at request time.

    The key join is a plain equi-join: Spark broadcasts the registry if it measures small, and splits a
    hot key otherwise. With ``open_if_empty`` a registry without live keys lets everybody in as anonymous.
    """
    keys = active_tokens(users)
    k = _marked(keys)
    key = bearer_token(F.col(header))
    joined = requests.withColumn("_key", key).join(k, F.col("_key") == F.col("_token_key"), "left")
    out, identity = _judged(joined, ts)
    if open_if_empty:
        closed = keys.agg((F.count("*") > 0).alias("n")).scalar()
        out = out.withColumn("_closed", closed)
        out = out.withColumn("auth_error", F.when(F.col("_closed"), F.col("auth_error")))
        identity["user"] = F.when(F.col("_closed"), identity["user"]).otherwise(F.lit(ANONYMOUS))
        identity["group"] = F.when(F.col("_closed"), identity["group"]).otherwise(F.lit(DEFAULT_GROUP))
    return out.withColumns(identity).drop("_closed", "_key", *k.columns)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _admissions(window: int):
    """Fold over instants ordered by (user, stretch, time): how many requests of each are admitted.

    While the limit is used up, the fold jumps to the instant at which the oldest admission expires, so
    its steps are bounded by the admitted requests, not by all of them.
    """

    runs = run_splitter()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, admitted, held = None, deque(), 0
        for batch in batches:
            times, counts = batch["_us"].to_numpy(), batch["_n"].to_numpy()
            limits = batch["_limit"].to_numpy()
            passed = np.zeros(len(batch), dtype="int64")
            for key, i, end in runs(batch, ["_user", "_stretch"]):
                if key != current:
                    current, admitted, held = key, deque(), 0
                while i < end:
                    now, limit = int(times[i]), int(limits[i])
                    while admitted and admitted[0][0] <= now - window:
                        held -= admitted.popleft()[1]
                    if held >= limit:
                        if not admitted:  # cannot be: a limit is at least 1
                            i += 1
                            continue
                        same = np.flatnonzero(limits[i:end] != limit)
                        until = i + int(same[0]) if len(same) else end
                        i = min(until, i + max(1, int(np.searchsorted(times[i:end], admitted[0][0] + window))))
                        continue
                    n = min(int(counts[i]), limit - held)
                    passed[i] = n
                    admitted.append((now, n))
                    held += n
                    i += 1
            batch["_passed"] = passed
            yield batch.loc[passed < counts, ["_user", "_us", "_limit", "_passed"]]

    return fold


def rate_limit(
    requests: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    order: str = "request_id",
    limit: str = "rate_limit",
    window_seconds: int = DEFAULTS.rate_window_seconds,
) -> DataFrame:
    """Adds ``admitted`` and ``rate_error``: at most ``limit`` admitted requests in the trailing window.

    Rejected requests do not count; a limit of 0 or null means unlimited. ``order`` (unique) breaks ties. Of one
    user's requests at one instant with different limits, those with one limit go together, by their first.

    Only (user, instant) counts take part, aggregated before the shuffle. Minutes whose raw count together
    with the minute before stays within the limit admit everything; the sequential fold runs on the
    stretches between them, each streamed through one task with at most ``limit`` times in memory. The
    fold runs when this function is called; its rejections, which are read twice, go to the scratch folder.
    """
    window = window_seconds * 1_000_000
    rows = requests.withColumn("_us", _micros(ts))
    limited = rows.filter((F.col(limit) > 0) & F.col(user).isNotNull()).select(
        F.col(user).alias("_user"), "_us", F.col(limit).cast("bigint").alias("_limit"),
        F.col(order).alias("_order"),
    )
    # A user's limit may change: each request is judged by the limit it carries.
    instants = limited.groupBy("_user", "_us", "_limit").agg(
        F.count("*").alias("_n"), F.min("_order").alias("_first")
    ).withColumn("_cell", F.expr(f"_us div {window}"))

    by_cell = Window.partitionBy("_user").orderBy("_cell")
    cells = instants.groupBy("_user", "_cell").agg(F.sum("_n").alias("_n"), F.min("_limit").alias("_limit"))
    previous = F.when(F.lag("_cell").over(by_cell) == F.col("_cell") - 1, F.lag("_n").over(by_cell))
    cells = cells.withColumn("_before", F.coalesce(previous, F.lit(0)))
    cells = cells.withColumn("_calm", F.col("_before") + F.col("_n") <= F.col("_limit"))
    starts = F.when(F.col("_calm") | (F.col("_before") == 0), F.col("_cell"))
    cells = cells.withColumn(
        "_stretch", F.last(starts, ignorenulls=True).over(by_cell.rowsBetween(Window.unboundedPreceding, 0))
    )
    # A stretch needs the fold if it goes beyond its first cell: the rest are not calm. A first cell can
    # be over the limit by itself where nothing precedes it.
    cells = cells.withColumn("_start", starts)
    goes_on = F.lead("_cell").over(by_cell).isNotNull() & F.lead("_start").over(by_cell).isNull()
    busy = cells.withColumn("_busy", ~F.col("_calm") | goes_on).filter("_busy")

    stretch_rows = instants.join(busy.select("_user", "_cell", "_stretch"), ["_user", "_cell"]).select(
        "_user", "_stretch", "_us", "_first", "_n", "_limit"
    )
    user_type = dict(limited.dtypes)["_user"]
    cut = cut_lineage(
        stretch_rows.repartition("_user", "_stretch")
        .sortWithinPartitions("_user", "_stretch", "_us", "_first")
        .mapInPandas(_admissions(window), f"_user {user_type}, _us bigint, _limit bigint, _passed bigint"),
        "rejections",
    )
    # Where an instant is admitted in part, find the last admitted request of it.
    in_instant = Window.partitionBy("_user", "_us", "_limit").orderBy("_order")
    last = (
        limited.join(cut.filter("_passed > 0"), ["_user", "_us", "_limit"])
        .withColumn("_rank", F.row_number().over(in_instant))
        .filter("_rank = _passed")
        .select("_user", "_us", "_limit", F.col("_order").alias("_last"))
    )
    cut = cut.join(last, ["_user", "_us", "_limit"], "left").select(
        F.col("_user").alias("_cut_user"), F.col("_us").alias("_cut_us"), F.col("_limit").alias("_cut_limit"), "_last"
    )
    on = (F.col(user) == F.col("_cut_user")) & (F.col("_us") == F.col("_cut_us"))
    joined = rows.join(cut, on & (F.col(limit).cast("bigint") == F.col("_cut_limit")), "left")
    admitted = F.col("_cut_user").isNull() | F.coalesce(F.col(order) <= F.col("_last"), F.lit(False))
    message = F.format_string(
        "rate limit exceeded: %d requests/min for user %s", F.col(limit), F.col(user).cast("string")
    )
    return (
        joined.withColumn("admitted", admitted)
        .withColumn("rate_error", F.when(~F.col("admitted"), message))
        .drop("_us", "_cut_user", "_cut_us", "_cut_limit", "_last")
    )


def requests_by_user(requests: DataFrame, user: str = "user") -> DataFrame:
    """Requests per user, the busiest first."""
    return requests.groupBy(user).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), user)
