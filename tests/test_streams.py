"""Streaming forms over several micro-batches, compared with the batch operators on the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensitext.operators import access, policy, reuse, spend, tokens
from sensitext.operators.audit import EVENT
from sensitext.sources import tables
from sensitext.streaming import streams

T0 = datetime(2024, 1, 1)


def _files(spark, df, path, parts):
    """Writes the rows as ``parts`` files that a file stream picks up in order."""
    import os
    import time

    for i in range(parts):
        df.filter(F.col("part") == i).coalesce(1).write.mode("append").parquet(path)
        now = time.time() - 1000 + 10 * i
        for name in os.listdir(path):
            file = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(file) > time.time() - 500:
                os.utime(file, (now, now))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream, tmp_path, mode="append"):
    spark = stream.sparkSession
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    running = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", log).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert len([p for p in running.recentProgress if p.numInputRows]) > 1
    return spark.read.schema(stream.schema).parquet(out)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = []
    times = sorted(rng.randint(0, 900) for _ in range(500))
    for i, s in enumerate(times):
        rows.append((i, T0 + timedelta(seconds=s), rng.choice("aab"), rng.choice([0, 4, 4]) and 4, f"k{rng.randint(0, 3)}",
                     rng.choice([200, 200, 500]), i * 4 // 500))
    return spark.createDataFrame(
        rows, "request_id long, ts timestamp, user_id string, rate_limit int, content_key string, status int, part int"
    ).withColumn("rate_limit", F.lit(4))


def test_rate_limit_stream_equals_batch(spark, log, tmp_path):
    stream = streams.stream_rate_limit(_files(spark, log, str(tmp_path / "in"), 4))
    got = {r.request_id: r.admitted for r in _run(stream, tmp_path).collect()}
    assert got == {r.request_id: r.admitted for r in access.rate_limit(log).collect()}
    assert len(got) == 500 and 0 < sum(got.values()) < 500


def test_cache_stream_equals_batch(spark, log, tmp_path):
    stream = streams.stream_cache_hits(_files(spark, log, str(tmp_path / "in"), 4), ttl_seconds=30)
    got = {r.request_id: (r.hit, r.source_id) for r in _run(stream, tmp_path).collect()}
    want = reuse.ttl_cache_hits(log, ttl_seconds=30).collect()
    assert got == {r.request_id: (r.hit, r.source_id) for r in want}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"u{i % 5}@x.com and 123-45-000{i % 10} [{i}]", i // 10) for i in range(30)]
    return spark.createDataFrame(rows, "id long, text string, part int")


def test_redact_stream_equals_batch(spark, texts, tmp_path):
    stream = streams.stream_redact(_files(spark, texts, str(tmp_path / "in"), 3))
    got = {r.id: r.redacted for r in _run(stream, tmp_path).collect()}
    assert got == {r.id: r.redacted for r in tokens.redact(texts).collect()}


def test_policy_stream_splits_and_repeats_safely(spark, texts, tmp_path):
    rules = policy.Policy({"SSN": "block"})
    source = _files(spark, texts.withColumn("text", F.when(F.col("id") < 15, F.col("text")).otherwise(F.lit("a@b.com"))),
                    str(tmp_path / "in"), 3)
    clean, quarantine = str(tmp_path / "clean"), str(tmp_path / "quarantine")
    for attempt in range(2):  # a second run from an empty log repeats every batch
        writer = streams.stream_policy(source, rules, clean, quarantine)
        writer.option("checkpointLocation", str(tmp_path / f"log{attempt}")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(clean).count() == 15 and spark.read.parquet(quarantine).count() == 15
    assert {r.redacted for r in spark.read.parquet(clean).collect()} == {"[EMAIL_1]"}


def test_audit_rollup_drops_late_rows(spark, tmp_path):
    rows = [(0, "2024-01-01T00:10:00Z", "pass", 0), (0, "2024-01-01T00:50:00Z", "redact", 2), (1, "2024-01-01T03:00:00Z", "pass", 0),
            (2, "2024-01-01T03:10:00Z", "pass", 0), (3, "2024-01-01T00:20:00Z", "pass", 0), (4, "2024-01-01T05:00:00Z", "pass", 0)]
    events = spark.createDataFrame(rows, "part int, ts string, event string, items int")
    stream = streams.stream_audit_rollup(_files(spark, events, str(tmp_path / "in"), 5), ["event"], lateness="10 minutes")
    got = {(r.bucket.hour, r.event): (r.events, r["items"]) for r in _run(stream, tmp_path).collect()}
    assert got == {(0, "pass"): (1, 0), (0, "redact"): (1, 2), (3, "pass"): (2, 0)}


def test_spend_stream_equals_batch(spark, tmp_path):
    rows = [(f"u{i % 3}", '{"usage":{"prompt_tokens":%d,"completion_tokens":%d}}' % (i, i % 4), i // 10) for i in range(30)]
    df = spark.createDataFrame(rows, "user string, body string, part int")
    seen = {}

    def keep(batch, epoch):
        seen.update({r.user: tuple(r) for r in batch.collect()})

    stream = streams.stream_spend(_files(spark, df, str(tmp_path / "in"), 3))
    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert seen == {r.user: tuple(r) for r in spend.spend_by_user(spend.parse_usage(df)).collect()}


def test_repeat_filter(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=i), f"body{i % 4}", i // 5) for i in range(15)]
    df = spark.createDataFrame(rows, "ts timestamp, body string, part int")
    stream = streams.stream_repeat_filter(_files(spark, df, str(tmp_path / "in"), 3))
    assert _run(stream.select("content_key"), tmp_path).count() == 4


def test_audit_sink(spark, tmp_path):
    rows = [(i // 2, "2024-01-01T00:00:0%dZ" % i, "pass", 0, None, "GET", "/v1", "", None) for i in range(4)]
    events = spark.createDataFrame(rows, "part int, " + EVENT)
    writer = tables.stream_audit(_files(spark, events, str(tmp_path / "in"), 2), str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines[0] == '{"ts":"2024-01-01T00:00:00Z","event":"pass","method":"GET","path":"/v1"}' and len(lines) == 4


def test_budget_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, T0 + timedelta(seconds=i), rng.choice(["ann", "bob", None]), rng.choice(["g", "g", "h"]) and "g", rng.randint(0, 9) * 1000,
             rng.randint(0, 9) * 1000, i // 25) for i in range(100)]
    log = spark.createDataFrame(rows, "request_id long, ts timestamp, user string, group string, input_tokens long, output_tokens long, part int")
    budgets = {"g": 1.0}
    log = log.withColumn("budget_usd", F.when(F.col("user").isNotNull(), spend.budget_of(F.col("group"), budgets)))
    got = {r.request_id: r.refused for r in _run(streams.stream_budget_gate(_files(spark, log, str(tmp_path / "in"), 4)), tmp_path).collect()}
    want = spend.budget_gate(log.filter("user is not null"), budgets).collect()
    assert {r.request_id: got[r.request_id] for r in want} == {r.request_id: r.budget_error is not None for r in want}
    assert len(got) == 100 and 0 < sum(got.values()) < 100 and not any(got[i] for i, r in enumerate(rows) if r[2] is None)


def test_streams_without_keys(spark, log, tmp_path):
    nameless = log.withColumns({"user_id": F.lit(None).cast("string"), "content_key": F.lit(None).cast("string")})
    limited = _run(streams.stream_rate_limit(_files(spark, nameless, str(tmp_path / "in"), 4)), tmp_path)
    assert limited.count() == limited.filter("admitted").count() == 500
    hits = _run(streams.stream_cache_hits(_files(spark, nameless, str(tmp_path / "in2"), 4)), tmp_path / "2")
    assert hits.count() == 500 and hits.filter("hit").count() == 0


def test_state_of_idle_users_and_expired_keys_goes(spark, tmp_path):
    """Thirty users and keys in the first micro-batch, one of each hours later: only those are left in the state."""
    rows = [(i, T0 + timedelta(seconds=i), f"u{i % 30}", f"k{i % 30}", 2, 200, 0) for i in range(300)]
    rows += [(1000 + k, T0 + timedelta(hours=k), "late", "late", 2, 200, k) for k in range(1, 5)]
    log = spark.createDataFrame(rows, "request_id long, ts timestamp, user_id string, content_key string, rate_limit int, status int, part int")
    for name, stream in (
        ("admitted", lambda df: streams.stream_rate_limit(df, lateness="1 minute")),
        ("stored", lambda df: streams.stream_cache_hits(df, lateness="1 minute")),
    ):
        folder = tmp_path / name
        assert _run(stream(_files(spark, log, str(folder / "in"), 5)), folder).count() == len(rows)
        logs = [p for p in folder.iterdir() if (p / "state").exists()]
        left = spark.read.format("statestore").option("stateVarName", name).load(str(logs[0]))
        assert [r.key[0] for r in left.select("key").collect()] == ["late"]


def test_late_requests_are_judged_not_dropped(spark, tmp_path):
    rows = [(1, T0 + timedelta(hours=5), "u", 1, 0), (2, T0, "u", 1, 1), (3, T0 + timedelta(hours=5), "u", 1, 2)]
    log = spark.createDataFrame(rows, "request_id long, ts timestamp, user_id string, rate_limit int, part int")
    got = _run(streams.stream_rate_limit(_files(spark, log, str(tmp_path / "in"), 3), lateness="1 second"), tmp_path).collect()
    assert {r.request_id for r in got} == {1, 2, 3}
