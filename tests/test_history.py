"""Authentication as of request time, the registry in force, and usage as it is written."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensitext.operators import access, registry, spend
from sensitext.operators.registry import CHANGES, USERS
from sensitext.sources import tables

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def user(ident, *tokens):
    return (ident, f"name-{ident}", None, "g", 3, T0, [(k, "api-key", T0, expires, revoked) for k, expires, revoked in tokens])


def change(seq, minutes, op, ident, key=None, name=None, hours=0):
    return (seq, at(minutes), op, ident, name, None, None, 9, key, None, hours)


def judged(spark, users, changes, asked):
    requests = spark.createDataFrame([(i, at(m) if m is not None else None, f"Bearer {k}" if k else None, "own") for i, (m, k) in enumerate(asked)],
                                     "request_id long, ts timestamp, authorization string, user string")
    out = access.authenticate_as_of(requests, spark.createDataFrame(users, USERS), spark.createDataFrame(changes, CHANGES))
    assert out.columns == ["request_id", "ts", "authorization", "user", "auth_error", "user_id", "group", "rate_limit"]
    return [(r.user_id, r.rate_limit) if r.auth_error is None else r.auth_error for r in sorted(out.collect(), key=lambda r: r.request_id)]


def test_keys_hold_from_grant_to_revocation(spark):
    users = [user("a", ("k1", None, False), ("k2", at(5), False), ("k3", None, True)), user("b")]
    changes = [
        change(1, 10, "revoke_token", "a", "k1"), change(2, 20, "add_token", "b", "k1"), change(3, 30, "add_token", "a", "n", hours=1),
        change(4, 40, "delete_user", "a"), change(5, 50, "create_user", "a", name="again"), change(6, 60, "add_token", "a", "n"),
        change(7, 70, "add_token", "b", "n"), change(8, 80, "revoke_token", "b", "n"), change(9, 85, "revoke_token", "a", "unknown"),
        change(10, 90, "revoke_token", "a", "n"), change(11, 95, "add_token", "a", "n"),
    ]
    asked = [(9, "k1"), (10, "k1"), (19, "k1"), (20, "k1"), (4, "k2"), (6, "k2"), (0, "k3"), (0, None), (29, "n"), (30, "n"), (45, "n"),
             (61, "n"), (70, "n"), (80, "n"), (89, "n"), (90, "n"), (99, "n"), (41, "k2"), (None, "k1"), (None, "n")]
    a, again, b, bad = ("a", 3), ("a", 9), ("b", 3), access.INVALID
    assert judged(spark, users, changes, asked) == [
        a, bad, bad, b, a, access.EXPIRED, bad, access.MISSING, bad, a, bad, again, b, again, again, bad, again, bad, bad, bad,
    ]


def test_without_changes_it_is_the_registry(spark):
    users = [user("a", ("k", None, False), ("e", at(5), False)), user("b", ("k", None, False))]
    asked = [(0, "k"), (6, "e"), (5, "e"), (None, "k"), (1, "x"), (1, None)]
    requests = spark.createDataFrame([(i, at(m) if m is not None else None, f"Bearer {k}" if k else None) for i, (m, k) in enumerate(asked)],
                                     "request_id long, ts timestamp, authorization string")
    people = spark.createDataFrame(users, USERS)
    plain = access.authenticate(requests, people)
    dated = access.authenticate_as_of(requests, people, spark.createDataFrame([], CHANGES))
    assert sorted(map(str, plain.collect())) == sorted(map(str, dated.select(plain.columns).collect()))
    assert access.authenticate_as_of(requests, people.limit(0), spark.createDataFrame([], CHANGES)).filter("auth_error is null").count() == 0


def test_the_registry_in_force(spark, tmp_path):
    folder = str(tmp_path / "registry")
    with pytest.raises(Exception):
        tables.current_registry(spark, folder).count()
    one = spark.createDataFrame([user("a", ("k", None, False))], USERS)
    for name in ("first", "second", "third"):
        tables.publish_registry(one.withColumn("name", F.lit(name)), folder)
        assert [r.name for r in tables.current_registry(spark, folder).collect()] == [name]
    tables.write_registry(one, f"{folder}/snapshot-died")  # no pointer to it
    assert tables.current_registry(spark, folder).head().name == "third"
    assert tables.drop_old_snapshots(spark, folder, keep=1) == 2
    assert tables.current_registry(spark, folder).head().name == "third" and tables.drop_old_snapshots(spark, folder) == 0


@pytest.mark.parametrize("body,counts", [
    ('{"usage":{"prompt_tokens":5,"completion_tokens":2}}', (5, 2)), ('{"USAGE":{"Prompt_tokens":5}}', (5, 0)),
    ('{"usage":{"prompt_tokens":"5"}}', None), ('{"usage":{"prompt_tokens":5,"total_tokens":"9"}}', None), ('{"usage":{"prompt_tokens":5.0}}', None),
    ('{"usage":{"prompt_tokens":5e2}}', None), ('{"usage":{"prompt_tokens":true,"completion_tokens":1}}', None), ('{"usage":null}', None),
    ('{"usage":[5]}', None), ("[]", None), ("{", None), (None, None), ("", None), ('{"usage":{"prompt_tokens":0,"completion_tokens":0}}', None),
    ('{"usage":{"prompt_tokens":-3}}', (-3, 0)), ('{"usage":{"prompt_tokens":9223372036854775807}}', (2**63 - 1, 0)),
    ('{"usage":{"prompt_tokens":9223372036854775808}}', None), ('{"usage":{"prompt_tokens":null,"completion_tokens":4}}', (0, 4)),
    ('{"choices":[{"text":"\\u00e9"}],"usage":{"prompt_tokens":1,"other":{}}}', (1, 0)),
])
def test_usage_forms(spark, body, counts):
    got = spend.parse_usage(spark.createDataFrame([(1, body)], "request_id long, body string")).collect()
    assert [(r.input_tokens, r.output_tokens) for r in got] == ([counts] if counts else [])
