"""Scans in Arrow batches give what scans row by row give, whatever the texts hold."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from sensitext.functions.batches import readable
from sensitext.functions.rules import Rules
from sensitext.operators import detect, policy, tokens
from sensitext.plans.catalog import QUERIES

BITS = ["a@b.co", "555-123-4567", "+1 (555) 123.4567", "123-45-6789", "1234567890123456", "pwd=", "PaSSword: ", "pa\u017f\u017fwd=x", "x", " ",
        "-", "ß", "😀", "/home/u/", "10.1.2.3", "sk-abcdefghij1234567890", "[EMAIL_1]", "\n", "\r", "\x0b", "'", "/Users/",
        "C:\\Users\\a\\", "172.20.1.1", "A" * 41, "+/" * 21, "=", "xoxb-a-1", "\x00", "$0", "\\", "\\0", "\U000f0000", "555-1234"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    made = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    made += [None, "", "".join(map(chr, range(32))) + " a@b.co " + "\U000f0000", "mail a@b.co " * 300]
    return spark.createDataFrame(list(enumerate(made)), "id long, text string").repartition(3).cache()


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_same_matches(spark, texts):
    for overlaps in (False, True):
        same(*[detect.scan(texts, rules=rules, overlaps=overlaps) for rules in (Rules(), Rules().in_batches())])


def test_same_tokens_and_verdicts(spark, texts):
    custom = Rules().add("ORDER_ID", r"\b(?:555-)?\d{4}\b", spark).add("GREEK", r"(?i)\p{Greek}+|k", spark)
    both = (custom, custom.in_batches())
    same(*[tokens.token_map(texts, ["id"], rules=r) for r in both])
    same(*[tokens.redact(texts, rules=r, with_map=True).withColumn("tokens", F.map_entries("tokens")) for r in both])
    strict = policy.Policy({"password": "block", "email": "block"})
    same(*[policy.classify(texts, strict, rules=r, before_overlap=True) for r in both])


def test_rules_arrow_does_not_read_are_scanned_row_by_row(spark):
    rules = Rules(rules=()).add("X", r"a\Cb", spark).in_batches()
    assert not readable(rules) and not readable(Rules(rules=()).in_batches())
    df = spark.createDataFrame([("aüb",)], "text string")
    assert tokens.redact(df, rules=rules).head().redacted == "[X_1]"
    assert tokens.redact(df, rules=Rules(rules=()).in_batches()).head().redacted == "aüb"


def test_bytes_that_are_no_utf8(spark):
    """They count as one replacement character each, as Spark's own functions read them."""
    df = spark.sql("select cast(concat(x'ff', cast('ü a@b.co ' as binary), x'c3', cast(' 10.1.1.1' as binary)) as string) as text")
    found = detect.scan(df, rules=Rules().in_batches()).head().matches
    assert [tuple(m) for m in found] == [(3, 9, "EMAIL", "a@b.co"), (12, 20, "IP_ADDR", "10.1.1.1")]


@pytest.mark.parametrize("name", ["token_map_customers", "token_stats_customers", "custom_rule_optional_prefix", "policy_before_overlap_removal",
                                  "pii_findings_customers", "pii_findings_before_overlap_removal", "restore_replies", "pii_email_findings",
                                  "redact_customers"])
def test_customers_are_scanned_in_batches_once(spark, name):
    """A customer's text matches most rules: neither the Java patterns nor a second scan is in the plan."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "ghp_(?<!" not in plan and plan.count("make_valid_utf8") + plan.count("makeValid") == 1


def test_gateway_reads_bodies_in_batches_and_placeholders_by_value(spark, monkeypatch):
    from sensitext.operators import gateway
    from sensitext.plans import log_queries

    given = {}
    bodies = ["[EMAIL_1] and [EMAIL_1], [x] [[SSN_2] []_3]", "none", "", None]
    rows = spark.createDataFrame([(i, 200, b) for i, b in enumerate(bodies)], "request_id long, status int, body string")
    facts = gateway.response_facts(rows)
    assert {r.request_id: r.placeholders for r in facts.collect()} == {0: ["[EMAIL_1]", "[EMAIL_1]", "[SSN_2]"], 1: [], 2: [], 3: []}
    # Values are all that is asked for: one run of the pattern finds them.
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("_[0-9]+") == 1
    monkeypatch.setattr(gateway, "gateway_decisions", lambda *_, **named: given.update(named))
    log_queries._decisions(spark, SF)
    assert given["rules"].batched


def test_numbers_are_counted_in_arrays():
    """Values, types and rows that share names; and work that does not go match by match through the interpreter."""
    import sys

    import pyarrow as pa

    from sensitext.functions import batches

    def lists(*rows):
        made = [None if row is None else [{"start": i, "end": i + 1, "type": t, "value": v} for i, (t, v) in enumerate(row)] for row in rows]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("value", pa.string())]))
        return pa.array(made, kind)

    given = lists([("A", "x"), ("B", "y"), ("A", "z"), ("B", "x"), ("A", "x")], None, [], [("B", "x"), ("A", "y"), ("B", "z")])
    tokens = [[m["token"] for m in row] for row in batches._numberer(False)(given).to_pylist()]
    assert tokens == [["[A_1]", "[B_1]", "[A_2]", "[A_1]", "[A_1]"], [], [], ["[B_1]", "[A_1]", "[B_2]"]]
    once = [[(m["start"], m["token"], m["token_type"], m["ordinal"]) for m in row] for row in batches._numberer(True)(given).to_pylist()]
    assert once == [[(0, "[A_1]", "A", 1), (1, "[B_1]", "B", 1), (2, "[A_2]", "A", 2)], [], [], [(0, "[B_1]", "B", 1), (1, "[A_1]", "A", 1), (2, "[B_2]", "B", 2)]]
    many, calls = lists(*[[("A", str(i)) for i in range(9)]] * 2000), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += 1

    numbered = batches._numberer(True)
    sys.setprofile(count)
    numbered(many)
    sys.setprofile(None)
    assert calls < 5000


def test_verdicts_alone_have_nothing_numbered(spark):
    plan = QUERIES["policy_before_overlap_removal"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "scanned_in_batches" in plan and "resolved_in_batches" not in plan
