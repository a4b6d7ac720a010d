"""Access control, spend, reuse, attempts and audit: stated cases and plain-loop comparisons."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sensitext.functions import formats
from sensitext.operators import access, attempts, audit, gateway, registry, reuse, spend
from sensitext.operators.policy import Policy
from sensitext.settings import Settings
from sensitext.sources import catalog, tables

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def user(id_, tokens, name=None, group="g", limit=0):
    return (id_, name or id_, None, group, limit, T0, tokens)


def key(k, expires=None, revoked=False):
    return (k, "api-key", T0, expires, revoked)


# ── Authentication ───────────────────────────────────────────────────────────────────────────────


def test_authenticate_cases(spark):
    users = spark.createDataFrame(
        [user("u1", [key("k"), key("old", revoked=True)]), user("u2", [key("short", at(10))]), user("u3", [])],
        registry.USERS,
    )
    cases = [
        (None, 0, access.MISSING), ("Basic x", 0, access.MISSING), ("BEARER k", 0, access.MISSING),
        ("Bearer nope", 0, access.INVALID), ("Bearer old", 0, access.INVALID), ("Bearer ", 0, access.INVALID),
        ("Bearer  k", 0, access.INVALID), ("Bearer short", 10, None), ("Bearer short", 11, access.EXPIRED),
        ("bearer k", 99, None), ("Bearer k", 0, None), ("x Bearer k", 0, access.MISSING),
    ]
    rows = spark.createDataFrame(
        [(i, at(s), h) for i, (h, s, _) in enumerate(cases)], "request_id long, ts timestamp, authorization string"
    )
    got = access.authenticate(rows, users).orderBy("request_id").collect()
    assert [r.auth_error for r in got] == [c[2] for c in cases]
    assert got[10].user_id == "u1" and got[10].group == "g" and got[3].user_id is None


def test_open_registry(spark):
    rows = spark.createDataFrame([(1, T0, None)], "request_id long, ts timestamp, authorization string")
    nobody = spark.createDataFrame([user("u", [key("k", revoked=True)])], registry.USERS)
    assert access.authenticate(rows, nobody).head().auth_error == access.MISSING
    row = access.authenticate(rows, nobody, open_if_empty=True).head()
    assert (row.auth_error, row.user, row.group) == (None, "anonymous", "default")
    somebody = spark.createDataFrame([user("u", [key("k")])], registry.USERS)
    assert access.authenticate(rows, somebody, open_if_empty=True).head().auth_error == access.MISSING


# ── Rate limit ───────────────────────────────────────────────────────────────────────────────────


def _loop_admitted(rows, window):
    state, out = {}, {}
    for id_, us, who, limit in sorted(rows, key=lambda r: (r[1], r[0])):
        if not limit or limit <= 0 or who is None:
            out[id_] = True
            continue
        live = [t for t in state.get(who, []) if t > us - window]
        out[id_] = len(live) < limit
        state[who] = live + [us] if out[id_] else live
    return out


def _limited(spark, rows, **kw):
    df = spark.createDataFrame(
        [(i, T0 + timedelta(microseconds=us), w, n) for i, us, w, n in rows],
        "request_id long, ts timestamp, user_id string, rate_limit int",
    )
    return access.rate_limit(df.repartition(4), **kw)


def test_rate_limit_stated_case(spark):
    rows = [(i, s * 10**6, "u", 2) for i, s in enumerate([0, 10, 20, 60, 61, 70])]
    got = {r.request_id: (r.admitted, r.rate_error) for r in _limited(spark, rows).collect()}
    assert [got[i][0] for i in range(6)] == [True, True, False, True, False, True]
    assert got[2][1] == "rate limit exceeded: 2 requests/min for user u" and got[0][1] is None


@pytest.mark.parametrize("seed", range(4))
def test_rate_limit_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, id_ = [], 0
    for who, limit, span, n in [("hot", 5, 1200, 900), ("burst", 3, 40, 300), ("calm", 50, 4000, 60), ("free", 0, 50, 80),
                                (None, 4, 50, 20), ("one", 1, 5000, 90), ("same", 2, 0, 30)]:
        step = 10**6 if seed % 2 else 1
        for _ in range(n):
            us = rng.randint(0, span * 10**6) // step * step
            rows.append((id_, us, who, limit))
            id_ += 1
    # Boundaries: exactly one window apart, to the microsecond.
    for k, us in enumerate([0, 59_999_999, 60_000_000, 60_000_001, 119_999_999, 120_000_000, 120_000_001]):
        rows += [(id_ + 2 * k, us, "edge", 1), (id_ + 2 * k + 1, us, "edge", 1)]
    rng.shuffle(rows)
    got = {r.request_id: r.admitted for r in _limited(spark, rows).collect()}
    assert got == _loop_admitted(rows, 60 * 10**6)


def test_rate_limit_carries_state_over_arrow_batches(spark):
    rows = [(i, i * 100_000, "hot", 7) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.request_id: r.admitted for r in _limited(spark, rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _loop_admitted(rows, 60 * 10**6) and not all(got.values())


# ── Reuse ────────────────────────────────────────────────────────────────────────────────────────


def _loop_cache(rows, ttl):
    stored, out = {}, {}
    for id_, us, k, status in sorted(rows, key=lambda r: (r[1], r[0])):
        if k is None:
            out[id_] = (False, False, None)
            continue
        entry = stored.get(k)
        if entry and us - entry[0] <= ttl:
            out[id_] = (True, False, entry[1])
            continue
        stored.pop(k, None)
        if status is not None and 200 <= status <= 299:
            stored[k] = (us, id_)
            out[id_] = (False, True, id_)
        else:
            out[id_] = (False, False, None)
    return out, len(stored)


def _replayed(spark, rows, ttl):
    df = spark.createDataFrame(
        [(i, T0 + timedelta(microseconds=us), k, s) for i, us, k, s in rows],
        "request_id long, ts timestamp, content_key string, status int",
    )
    return reuse.ttl_cache_hits(df.repartition(4), ttl_seconds=ttl)


def test_cache_stated_case(spark):
    rows = [(i, s * 10**6, "k", 200) for i, s in enumerate([0, 300, 301, 500])]
    got = _replayed(spark, rows, 300).orderBy("request_id").collect()
    assert [r.hit for r in got] == [False, True, False, True]
    assert [r.source_id for r in got] == [0, 0, 2, 2]
    failed = _replayed(spark, [(0, 0, "k", 500), (1, 1, "k", 200), (2, 2, "k", 500)], 300)
    assert [(r.hit, r.stored) for r in failed.orderBy("request_id").collect()] == [(False, False), (False, True), (True, False)]


@pytest.mark.parametrize("seed", range(3))
def test_cache_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, id_ = [], 0
    for k, span, n in [("hot", 3000, 700), ("b", 500, 40), ("c", 20000, 60), (None, 100, 10), ("same", 0, 9)]:
        for _ in range(n):
            us = rng.randint(0, span * 10**6) // (10**6 if seed else 1) * (10**6 if seed else 1)
            rows.append((id_, us, k, rng.choice([200, 204, 500, 404, None, 200])))
            id_ += 1
    replayed = _replayed(spark, rows, 60)
    got = {r.request_id: (r.hit, r.stored, r.source_id) for r in replayed.collect()}
    want, entries = _loop_cache(rows, 60 * 10**6)
    assert got == want
    stats = reuse.cache_stats(replayed).head()
    hits = sum(h for h, _, _ in want.values())
    asked = sum(r[2] is not None for r in rows)
    assert (stats.hits, stats.misses, stats.entries) == (hits, asked - hits, entries)
    assert stats.hit_rate == int(hits * 100 / asked + 0.5)


def test_empty_cache_stats(spark):
    stats = reuse.cache_stats(_replayed(spark, [(1, 0, None, 200)], 60)).head()
    assert (stats.hits, stats.misses, stats.hit_rate, stats.max_entries) == (0, 0, 0, 1000)


def test_content_keys(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("ab", "c")], "body string, path string")
    keys = [r.k for r in df.select(reuse.content_key(F.col("body"), F.col("path")).alias("k")).collect()]
    assert keys[0] == keys[2] != keys[1]
    assert [r.requests for r in reuse.content_repeats(df, "body").orderBy("requests").collect()] == [1, 2]


# ── Spend ────────────────────────────────────────────────────────────────────────────────────────


def test_usage_and_cost(spark):
    bodies = [
        '{"usage":{"prompt_tokens":1000000,"completion_tokens":200000,"total_tokens":5}}', "not json", "{}",
        '{"usage":{"prompt_tokens":0,"completion_tokens":0}}', '{"usage":{"prompt_tokens":1.5,"completion_tokens":2}}',
        '{"usage":{"prompt_tokens":99999999999999999999,"completion_tokens":2}}', '{"usage":null}', None,
        '{"usage":{"completion_tokens":3}}', '{"usage":{"prompt_tokens":true,"completion_tokens":2}}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string").withColumn("user", F.lit("u"))
    used = spend.with_cost(spend.parse_usage(df)).orderBy("request_id").collect()
    assert [(r.request_id, r.input_tokens, r.output_tokens) for r in used] == [(0, 1000000, 200000), (8, 0, 3)]
    assert used[0].cost_usd == 6.0
    assert spend.spend_by_user(spend.parse_usage(df)).head().input_tokens == 1000000
    nothing = spend.spend_totals(spend.parse_usage(df.filter("request_id = 1"))).head()
    assert (nothing.total_input, nothing.total_output, nothing.total_usd) == (0, 0, 0.0)


def test_budget_gate_and_status(spark):
    rows = [(1, at(1), "u", "g", 1_000_000, 200_000), (2, at(2), "u", "g", None, None), (3, at(7200), "u", "g", 5, 5),
            (4, at(1), "v", "none", 10**9, 0), (5, at(2), "v", "none", 1, 1), (6, at(3), "w", "g", 1, 0), (7, at(4), "x", None, 1, 1)]
    df = spark.createDataFrame(
        rows, "request_id long, ts timestamp, user string, group string, input_tokens long, output_tokens long"
    )
    got = {r.request_id: r.budget_error for r in spend.budget_gate(df, {"g": 6.0, "none": 0.0}).collect()}
    refused = "budget exceeded for group g: $6.00 / $6.00"
    assert got == {1: None, 2: refused, 3: refused, 4: None, 5: None, 6: None, 7: None}
    shared = {r.request_id: r.budget_error for r in spend.budget_gate(df, {"g": 6.0}, scope="group").collect()}
    assert shared[6] == refused and shared[1] is None
    status = spend.budget_status(spend.spend_by_user(df.na.fill(0)), spend.user_group(df), {"g": 6.0})
    exceeded = {r.user: r.exceeded for r in status.collect()}
    assert exceeded == {"u": True, "v": False, "w": False, "x": False}


def test_latest_group(spark):
    rows = [(1, at(1), "u", "a"), (3, at(2), "u", "b"), (2, at(2), "u", "c")]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, user string, group string")
    assert spend.user_group(df).head().group == "b"


# ── Registry ─────────────────────────────────────────────────────────────────────────────────────


def _loop_registry(users, changes):
    state = {u[0]: {"name": u[1], "group": u[3], "tokens": [list(t) for t in u[6]]} for u in users}
    errors = {}
    for seq, ts, op, uid, name, _, group, limit, k, label, hours in sorted(changes):
        if op == "create_user":
            if not name:
                errors[seq] = "Name is required"
                continue
            state[uid] = {"name": name, "group": group or "default", "tokens": []}
        elif not uid:
            errors[seq] = "user_id is required"
        elif uid not in state:
            errors[seq] = f"user not found: {uid}"
        elif op == "delete_user":
            del state[uid]
        elif op == "add_token":
            expires = ts + timedelta(hours=hours) if hours and hours > 0 else None
            state[uid]["tokens"].append([k, label or "api-key", ts, expires, False])
        else:
            mine = [t for t in state[uid]["tokens"] if t[0] == k]
            if not mine:
                errors[seq] = "token not found"
            else:
                mine[0][4] = True
    return state, errors


@pytest.mark.parametrize("seed", range(3))
def test_registry_changes_against_a_loop(spark, seed):
    rng = random.Random(seed)
    users = [user(f"u{i}", [key(f"k{i}"), key(f"r{i}", revoked=True)]) for i in range(4)]
    changes, made = [], 0
    for seq in range(120):
        op = rng.choice(["create_user", "delete_user", "add_token", "add_token", "revoke_token", "revoke_token"])
        uid = rng.choice([f"u{i}" for i in range(7)] + [""])
        k = None
        if op == "add_token":
            k, made = f"t{made}", made + 1
        elif op == "revoke_token":
            k = rng.choice([f"k{i}" for i in range(4)] + [f"t{i}" for i in range(max(1, made))])
        changes.append((seq, at(seq), op, uid or (None if op != "create_user" else "u9"), rng.choice(["n", "", "m"]), None,
                        rng.choice([None, "", "x"]), 3, k, rng.choice(["", "lab", None]), rng.choice([None, 0, 5])))
    after, rejected = registry.apply_registry_changes(
        spark.createDataFrame(users, registry.USERS), spark.createDataFrame(changes, registry.CHANGES)
    )
    want, errors = _loop_registry(users, changes)
    assert {r.seq: r.error for r in rejected.collect()} == errors
    got = {r.id: {"name": r["name"], "group": r.group, "tokens": [list(t) for t in r.tokens]} for r in after.collect()}
    assert got == want


def test_registry_views(spark):
    entries = spark.createDataFrame(
        [("abcdefgh-1234", "ann", "g", 3, 1), ("abcdefgh-1234", "bob", "h", 0, 2), ("zzz", "cid", "g", None, 3)],
        "key string, user string, group string, rate_limit int, position int",
    )
    users = registry.registry_from_keys(entries, F.lit("2024-01-01"))
    assert {(r["name"], r.rate_limit, r.tokens[0].label) for r in users.collect()} == {("bob", 0, "config"), ("cid", 0, "config")}
    previews = {r.user: r.preview for r in registry.token_preview(users).collect()}
    assert previews["bob"] == "abcdefgh...1234"
    assert "key" not in " ".join(registry.users(users).columns).replace("live_keys", "")
    one = registry.users(users).filter("name = 'bob'").head().id
    assert registry.user_by_id(users, one).head()["name"] == "bob"
    with pytest.raises(Exception, match="user not found: nobody"):
        registry.user_by_id(users, "nobody").collect()
    assert registry.flatten_registry(spark.createDataFrame([user("u", [])], registry.USERS)).count() == 1


# ── Attempts ─────────────────────────────────────────────────────────────────────────────────────


def test_attempt_cases(spark):
    rows = [
        (1, 0, "a", 0, 503, None), (1, 0, "a", 1, 503, None), (1, 0, "a", 2, 200, None),
        (2, 0, "a", 0, 404, None),
        (3, 0, "a", 0, None, "refused"), (3, 1, "b", 0, 429, None), (3, 1, "b", 1, 200, None),
        (4, 0, "a", 0, 500, None), (4, 1, "b", 0, None, "timeout"),
        (5, 0, "a", 9, 200, None), (5, 0, "a", 0, 504, None),
        (6, 0, "a", 0, 200, None), (6, 0, "a", 1, 503, None),
    ]
    df = spark.createDataFrame(rows, tables.ATTEMPTS)
    got = {r.request_id: r for r in attempts.attempt_outcome(df).collect()}
    assert (got[1].status, got[1].attempts, got[1].waited_ms, got[1].target) == (200, 3, 1500, "a")
    assert (got[2].status, got[2].attempts, got[2].waited_ms) == (404, 1, 0)
    assert (got[3].target, got[3].attempts, got[3].answered) == ("b", 3, True)
    assert got[4].error == "all targets failed: max retries exhausted: timeout" and not got[4].answered
    assert (got[5].answered, got[5].status, got[5].attempts) == (True, 200, 2)  # every logged attempt counts
    capped = {r.request_id: r for r in attempts.attempt_outcome(df, max_retries=3).collect()}
    assert capped[5].error == "all targets failed: max retries exhausted: HTTP 504"
    assert got[6].attempts == 1
    usage = {r.target: r for r in attempts.fallback_usage(df).collect()}
    assert (usage["b"].requests, usage["b"].answered, usage["b"].is_fallback) == (2, 1, True)
    assert (usage["a"].requests, usage["a"].attempts, usage["a"].answered) == (6, 9, 4)
    later = spark.createDataFrame([(1, 0, "a", 0, 200, None), (1, 1, "b", 0, 200, None)], tables.ATTEMPTS)
    assert [r.target for r in attempts.fallback_usage(later).collect()] == ["a"]
    waits = spark.range(0, 5).select(attempts.backoff_ms(F.col("id")).alias("w")).collect()
    assert [r.w for r in waits] == [0, 500, 1000, 2000, 4000]


# ── Formats, catalog ─────────────────────────────────────────────────────────────────────────────


def test_formats(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).head().v

    for n, want in [(999, "999"), (1000, "1.0K"), (1500000, "1.5M"), (224250, "224.3K"), (1150, "1.1K"), (999999, "1000.0K")]:
        assert one(formats.format_tokens(F.lit(n))) == want
    for n, want in [(59, "59s"), (61, "1m 1s"), (3660, "1h 1m"), (0, "0s"), (3599, "59m 59s"), (90061, "25h 1m")]:
        assert one(formats.format_duration(F.lit(n))) == want
    rng = random.Random(1)
    values = [0.125, 1.005, 0.375, 2.5, 0.0, 0.005, 0.015, 1e6 + 0.005] + [rng.random() * 10 ** rng.randint(-3, 6) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(*[formats.fixed(F.col("v"), d).alias(f"d{d}") for d in (1, 2, 4)]).collect()
    for v, row in zip(values, got):
        assert (row.d1, row.d2, row.d4) == (f"{v:.1f}", f"{v:.2f}", f"{v:.4f}")
    assert one(formats.percent(F.lit(1), F.lit(8))) == 13 and one(formats.percent(F.lit(0), F.lit(0))) == 0
    assert one(formats.error_payload(F.lit(401), F.lit('no "x"'))) == (
        '{"error":{"code":401,"message":"no \\"x\\"","type":"gateway_error"}}'
    )


def test_providers(spark):
    full, service = catalog.providers(spark), catalog.providers(spark, service=True)
    assert (full.count(), service.count()) == (45, 25)
    df = spark.createDataFrame([("https://api.openai.com",), ("https://api.openai.com/",), ("",), (None,)], "target string")
    assert [r.provider for r in catalog.with_provider(df).collect()] == ["openai", "custom", "custom", "custom"]
    found = catalog.search_providers(full, "  AI ").select("name").collect()
    assert {"OpenAI", "Mistral AI", "LocalAI"} <= {r.name for r in found} and "Groq" not in {r.name for r in found}
    assert catalog.search_providers(full, "").count() == 45


# ── Gateway, audit, files ────────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def decided(spark):
    users = spark.createDataFrame(
        [user("u1", [key("k1")], "ann", "g", 2), user("u2", [key("k2")], "bob", "h")], registry.USERS
    )
    bodies = {
        1: ("Bearer k1", "mail a@b.com"), 2: ("Bearer nope", "x"), 3: ("Bearer k1", "plain"), 4: ("Bearer k1", "third"),
        5: ("Bearer k2", "ssn 123-45-6789"), 6: ("Bearer k2", "plain"), 7: ("Bearer k2", "lost"), 8: ("Bearer k2", "big"),
        9: ("Bearer k2", "after"),
    }
    requests = spark.createDataFrame(
        [(i, at(i), "POST", "/v1", "10.0.0.1", h, None, None, b) for i, (h, b) in bodies.items()], tables.REQUESTS
    )
    usage = '{"usage":{"prompt_tokens":%d,"completion_tokens":0}}'
    responses = spark.createDataFrame(
        [(1, at(1), 200, "to [EMAIL_1] é"), (3, at(3), 200, "ok"), (8, at(8), 200, usage % 10**6), (5, at(5), 200, usage % 10**9)],
        tables.RESPONSES,
    )
    settings = Settings(budgets={"h": 3.0})
    return gateway.gateway_decisions(
        requests, responses, users, policy=Policy({"SSN": "block"}), settings=settings
    ).persist()


def test_gateway_steps(decided):
    got = {r.request_id: r for r in decided.collect()}
    assert {i: (r.outcome, r.code) for i, r in got.items()} == {
        1: ("forwarded", 200), 2: ("auth_fail", 401), 3: ("forwarded", 200), 4: ("rate_limited", 429), 5: ("blocked", 403),
        6: ("cache_hit", 200), 7: ("failed", 502), 8: ("forwarded", 200), 9: ("over_budget", 402),
    }
    assert got[9].message == "budget exceeded for group h: $3.00 / $3.00"
    assert got[6].source_id == 3
    assert got[1].sent_bytes == len("to a@b.com é".encode())


def test_audit_and_activity(spark, decided, tmp_path):
    events = audit.audit_events(decided)
    got = sorted((r.request_id, r.event, r["items"], r.types, r.msg) for r in events.collect())
    assert got == sorted([
        (1, "redact", 1, ["EMAIL"], None), (2, "auth_fail", None, None, "invalid API key"), (3, "pass", None, None, None),
        (5, "dlp_block", None, ["SSN"], "Request blocked by DLP policy: contains SSN"), (7, "pass", None, None, None),
        (7, "error", None, None, "Upstream failed: no response"), (8, "pass", None, None, None),
    ], key=lambda r: (r[0], r[1]))
    assert {r.ts for r in events.collect() if r.request_id == 1} == {"2024-01-01T00:00:01Z"}
    lines = [(r.request_id, r.type) for r in audit.recent_activity(decided, last=6).collect()]
    assert lines[0] == (4, "RATE") and lines[1:] == [(5, "DLP"), (6, "CACHE"), (7, "ERROR"), (8, "PASS"), (9, "BUDGET")]
    assert (1, "RESTORE", "Restored 1 token(s) in response (13 bytes)") in [
        (r.request_id, r.type, r.message) for r in audit.activity(decided).collect()
    ]
    totals = audit.live_totals(decided).head()
    assert (totals.requests, totals.redacted) == (9, 1)
    board = audit.dashboard(decided).head()
    assert (board.hits, board.blocked_by_rate, board.spend_text, board.input_text) == (1, 1, "$3.0000", "1.0M")
    flagged = audit.dashboard(decided, features={"auth": True, "retry": False}).head()
    assert flagged.feature_auth and not flagged.feature_retry
    rolled = audit.audit_rollup(events, ["event"]).collect()
    assert sum(r.events for r in rolled) == 7 and {r.bucket for r in rolled} == {T0}
    assert [r.tokens for r in audit.spend_table(decided).collect()] == ["1.0M"]


def test_audit_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = [
        Row(ts=None, event="redact", items=3, types=["EMAIL", "SSN"], method="POST", path="/v1/chat/completions", src="10.0.1.50", msg=None),
        Row(ts="2024-01-01T00:00:00Z", event="pass", items=0, types=[], method="GET", path="/v1/models", src="", msg=""),
    ]
    schema = audit.EVENT
    for row in rows:
        tables.write_audit(spark.createDataFrame([row], schema), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) == 2
    (passed,) = [line for line in lines if "pass" in line]
    assert passed == '{"ts":"2024-01-01T00:00:00Z","event":"pass","method":"GET","path":"/v1/models"}'
    back = {r.event: r for r in tables.read_audit(spark, path).collect()}
    assert back["redact"].types == ["EMAIL", "SSN"] and back["redact"].ts.endswith("Z") and back["pass"]["items"] is None


def test_registry_files(spark, tmp_path):
    missing = tables.read_registry(spark, str(tmp_path / "none.json"))
    assert missing.count() == 0 and missing.columns[0] == "id"
    (tmp_path / "users.json").write_text(
        '[{"id":"u1","name":"Ann","group":"g","rate_limit":5,"created_at":"2024-01-01T00:00:00Z",\n'
        ' "tokens":[{"key":"k","label":"l","created_at":"2024-01-01T00:00:00Z","revoked":false}]}]'
    )
    users = tables.read_registry(spark, str(tmp_path / "users.json"))
    assert users.head().tokens[0].key == "k" and users.head().tokens[0].expires_at is None
    snapshot = str(tmp_path / "snap")
    tables.write_registry(users, snapshot)
    assert tables.read_registry(spark, snapshot, multi_line=False).collect() == users.collect()
    with pytest.raises(Exception):
        tables.write_registry(users, snapshot)


def test_log_files(spark, tmp_path):
    import gzip

    folder = tmp_path / "responses"
    folder.mkdir()
    with gzip.open(folder / "part.json.gz", "wt") as f:
        f.write('{"request_id":1,"status":200,"body":"x"}\n')
    assert tables.read_responses(spark, str(folder)).head().status == 200
    (tmp_path / "req.json").write_text('{"request_id":1,"ts":"2024-01-01T00:00:00Z","body":"b","extra":1}\n')
    row = tables.read_requests(spark, str(tmp_path / "req.json")).head()
    assert (row.request_id, row.body, row.method) == (1, "b", None)
