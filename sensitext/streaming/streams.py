"""Structured Streaming forms of the operators.

The stateless ones reuse the batch operators. Stateful ones need a checkpoint location on their sink
and, where noted, the RocksDB state store.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..functions.rules import Rules
from ..operators.policy import Policy, classify
from ..operators.reuse import content_key
from ..operators.spend import cost_usd, parse_usage
from ..operators.tokens import redact
from ..settings import DEFAULTS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_redact(
    stream: DataFrame, text: str = "text", rules: Rules = Rules(), with_map: bool = False
) -> DataFrame:
    """Stateless: redacts each row by itself; any output mode."""
    return redact(stream, text, rules, with_map=with_map)


def stream_policy(
    stream: DataFrame, policy: Policy, clean_path: str, quarantine_path: str, text: str = "text",
    rules: Rules = Rules(), format: str = "parquet",
) -> DataStreamWriter:
    """A writer (to be started by the caller) that splits each micro-batch into two file sinks.

    A batch may be written again after a failure. Each batch goes to its own folder, which is replaced,
    so a repeated batch leaves no duplicates.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = classify(batch, policy, text, rules).persist()
        try:
            blocked = rows.filter("blocked").drop("redacted", "items", "types", "ambiguous")
            clean = rows.filter("not blocked").drop("blocked", "blocked_types", "message", text)
            clean.write.mode("overwrite").format(format).save(f"{clean_path}/batch={epoch}")
            blocked.write.mode("overwrite").format(format).save(f"{quarantine_path}/batch={epoch}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write)


def stream_audit_rollup(
    events: DataFrame, by: list[str], bucket: str = "1 hour", lateness: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Events and items per tumbling bucket; append mode emits a bucket once the watermark has passed it."""
    rows = events.withColumn("_at", F.to_timestamp(ts)).withWatermark("_at", lateness)
    if "type" in by:
        rows = rows.withColumn("type", F.explode_outer("types"))
    bucket_start = F.window("_at", bucket).alias("_w")
    grouped = rows.groupBy(bucket_start, *by).agg(
        F.count("*").alias("events"), F.coalesce(F.sum("items"), F.lit(0)).alias("items")
    )
    return grouped.select(F.col("_w.start").alias("bucket"), *by, "events", "items")


def stream_spend(
    responses: DataFrame, user: str = "user", price_in: float = DEFAULTS.price_in,
    price_out: float = DEFAULTS.price_out,
) -> DataFrame:
    """Running tokens and cost per user; update or complete mode. State: two counters per user."""
    totals = parse_usage(responses).groupBy(user).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    cost = cost_usd(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out)
    return totals.withColumn("estimated_usd", cost)


def _spender(price_in: float, price_out: float) -> StatefulProcessor:
    class Spender(StatefulProcessor):
        """Per user: the tokens used so far, in two counters."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("used", "input bigint, output bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            used_in, used_out = tuple(self.state.get()) if self.state.exists() else (0, 0)
            batch = _in_order(rows, ["us", "request_id", "input_tokens", "output_tokens", "budget_usd"])
            before_in = used_in + batch["input_tokens"].cumsum() - batch["input_tokens"]
            before_out = used_out + batch["output_tokens"].cumsum() - batch["output_tokens"]
            spent = before_in / 1e6 * price_in + before_out / 1e6 * price_out
            self.state.update((int(used_in + batch["input_tokens"].sum()), int(used_out + batch["output_tokens"].sum())))
            yield pd.DataFrame(
                {
                    "request_id": batch["request_id"], "user": key[0], "us": batch["us"], "spent_before": spent,
                    "refused": spent >= batch["budget_usd"],
                }
            )

        def close(self) -> None:
            pass

    return Spender()


def stream_budget_gate(
    requests: DataFrame, budget: str = "budget_usd", user: str = "user", ts: str = "ts", order: str = "request_id",
    price_in: float = DEFAULTS.price_in, price_out: float = DEFAULTS.price_out,
) -> DataFrame:
    """(request_id, user, us, spent_before, refused) as requests with input_tokens/output_tokens arrive.

    A request is refused if the user's spend before it has reached ``budget`` (see ``spend.budget_of``). Requests
    without a user or a budget are never refused and leave no state. Rows of a micro-batch are taken in time order.
    Needs the RocksDB state store; state: two counters per user.
    """
    rows = requests.select(
        F.col(order).cast("bigint").alias("request_id"), F.col(user).cast("string").alias("user"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(budget).cast("double").alias("budget_usd"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens")],
    )
    judged = F.col("user").isNotNull() & F.col("budget_usd").isNotNull()
    free = rows.filter(~judged).select(
        "request_id", "user", "us", F.lit(None).cast("double").alias("spent_before"), F.lit(False).alias("refused")
    )
    return free.union(rows.filter(judged).groupBy("user").transformWithStateInPandas(
        statefulProcessor=_spender(price_in, price_out),
        outputStructType="request_id bigint, user string, us bigint, spent_before double, refused boolean",
        outputMode="Append",
        timeMode="None",
    ))


def stream_repeat_filter(
    requests: DataFrame, body: str = "body", ts: str = "ts", lateness: str = "5 minutes",
    more: tuple[str, ...] = (),
) -> DataFrame:
    """Keeps the first request of each content key within the watermark; append mode."""
    keyed = requests.withColumn("content_key", content_key(F.col(body), *[F.col(c) for c in more]))
    return keyed.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["content_key"])


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> dict[str, np.ndarray]:
    """The named columns of a key's rows in this micro-batch, in the order of time and request.

    The rows may come in several pieces and in any order; only these columns of them are held."""
    pieces = [[piece[c].to_numpy() for c in columns] for piece in rows]
    held = dict(zip(columns, map(np.concatenate, zip(*pieces))))
    order = np.lexsort((held["request_id"], held["us"]))
    return {c: x[order] for c, x in held.items()}


def _after(us: int) -> int:
    """The first millisecond that is later than a time in microseconds."""
    return us // 1000 + 1


def _rate_limiter(window: int) -> StatefulProcessor:
    # The class is local so that it travels to the Python workers by value.
    class RateLimiter(StatefulProcessor):
        """Per user: the times of the admitted requests still inside the window (at most ``limit``), and the time of
        the one timer that will clear them."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("admitted", "times array<bigint>, timer bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            times, timer = tuple(self.state.get()) if self.state.exists() else ((), None)
            times = deque(times)
            batch = _in_order(rows, ["us", "request_id", "rate_limit"])
            passed = np.zeros(len(batch["us"]), bool)
            for k, (now, limit) in enumerate(zip(batch["us"].tolist(), batch["rate_limit"].tolist())):
                while times and times[0] <= now - window:
                    times.popleft()
                if limit <= 0 or len(times) < limit:
                    passed[k] = True
                    if limit > 0:
                        times.append(now)
            if times and timer is None:
                timer = _after(max(times) + window)
                self.handle.registerTimer(timer)
            if times or timer is not None:
                self.state.update((list(times), timer))
            yield pd.DataFrame(
                {"request_id": batch["request_id"], "user_id": key[0], "us": batch["us"], "admitted": passed}
            )

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            seen = timerValues.getCurrentWatermarkInMs()
            times = [t for t in self.state.get()[0] if _after(t + window) > seen] if self.state.exists() else []
            if times:
                timer = _after(max(times) + window)
                self.handle.registerTimer(timer)
                self.state.update((times, timer))
            else:
                self.state.clear()
            return iter([])

        def close(self) -> None:
            pass

    return RateLimiter()


def _watched(rows: DataFrame, lateness: str) -> DataFrame:
    """``rows`` under a watermark on ``at`` that moves timers; the column itself goes, so no row is dropped as late."""
    return rows.withWatermark("at", lateness).drop("at")


def stream_rate_limit(
    requests: DataFrame, user: str = "user_id", ts: str = "ts", order: str = "request_id",
    limit: str = "rate_limit", window_seconds: int = DEFAULTS.rate_window_seconds, lateness: str = "10 minutes",
) -> DataFrame:
    """(request_id, user_id, us, admitted) as requests arrive. Needs the RocksDB state store.

    Requests without a user or without a limit are admitted and leave no state, as in the batch form.
    Rows of one micro-batch are taken in time order; a row older than an earlier batch is judged against
    the state it finds, as a live gateway would, and none is dropped for being late. A user's state is gone once
    the watermark, ``lateness`` behind the latest request, has passed the window of the last one admitted.
    """
    rows = requests.select(
        F.col(order).cast("bigint").alias("request_id"), F.col(user).cast("string").alias("user_id"),
        F.col(ts).cast("timestamp").alias("at"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.coalesce(F.col(limit), F.lit(0)).cast("bigint").alias("rate_limit"),
    )
    judged = F.col("user_id").isNotNull() & (F.col("rate_limit") > 0)
    free = rows.filter(~judged).select("request_id", "user_id", "us", F.lit(True).alias("admitted"))
    limited = _watched(rows.filter(judged), lateness)
    return free.union(limited.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_rate_limiter(window_seconds * 1_000_000),
        outputStructType="request_id bigint, user_id string, us bigint, admitted boolean",
        outputMode="Append",
        timeMode="EventTime",
    ))


def _response_store(lifetime: int) -> StatefulProcessor:
    class ResponseStore(StatefulProcessor):
        """Per content key: when its response was stored, for which request, and the time of the timer that clears it."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("stored", "us bigint, request_id bigint, timer bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            *held, timer = tuple(self.state.get()) if self.state.exists() else (None, None, None)
            stored = None if held[0] is None else tuple(held)
            batch = _in_order(rows, ["us", "request_id", "status"])
            hits, sources = [], []
            for now, request, status in zip(*(x.tolist() for x in batch.values())):
                hit = stored is not None and now - stored[0] <= lifetime
                if not hit:
                    stored = (now, request) if 200 <= status <= 299 else None
                hits.append(hit)
                sources.append(stored[1] if stored else None)
            if stored and timer is None:
                timer = _after(stored[0] + lifetime)
                self.handle.registerTimer(timer)
            if stored or timer is not None:
                self.state.update((*(stored or (None, None)), timer))
            yield pd.DataFrame(
                {
                    "request_id": batch["request_id"], "content_key": key[0], "hit": hits,
                    "source_id": pd.array(sources, dtype="Int64"),
                }
            )

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            us, request, _ = tuple(self.state.get()) if self.state.exists() else (None, None, None)
            if us is not None and _after(us + lifetime) > timerValues.getCurrentWatermarkInMs():
                timer = _after(us + lifetime)
                self.handle.registerTimer(timer)
                self.state.update((us, request, timer))
            else:
                self.state.clear()
            return iter([])

        def close(self) -> None:
            pass

    return ResponseStore()


def stream_cache_hits(
    requests: DataFrame, key: str = "content_key", ts: str = "ts", order: str = "request_id",
    status: str = "status", ttl_seconds: int = DEFAULTS.cache_ttl_seconds, lateness: str = "10 minutes",
) -> DataFrame:
    """(request_id, content_key, hit, source_id) as requests arrive. Needs the RocksDB state store.

    Requests without a key are never hits and are never stored, as in the batch form. A key's state is gone once the
    watermark, ``lateness`` behind the latest request, has passed the end of its response's life.
    """
    rows = requests.select(
        F.col(order).cast("bigint").alias("request_id"), F.col(key).alias("content_key"),
        F.col(ts).cast("timestamp").alias("at"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.coalesce(F.col(status), F.lit(0)).cast("bigint").alias("status"),
    )
    lifetime = (ttl_seconds if ttl_seconds > 0 else DEFAULTS.cache_ttl_seconds) * 1_000_000
    nothing = F.lit(None).cast("bigint").alias("source_id")
    without = rows.filter("content_key is null").select("request_id", "content_key", F.lit(False).alias("hit"), nothing)
    keyed = _watched(rows.filter("content_key is not null"), lateness)
    return without.union(keyed.groupBy("content_key").transformWithStateInPandas(
        statefulProcessor=_response_store(lifetime),
        outputStructType="request_id bigint, content_key string, hit boolean, source_id bigint",
        outputMode="Append",
        timeMode="EventTime",
    ))
