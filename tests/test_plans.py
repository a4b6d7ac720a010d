"""The physical plans the operators are meant to have, and skewed inputs."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF
from sensitext.functions.rules import Rules
from sensitext.operators import access, detect, policy, reuse, spend, tokens
from sensitext.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_text_operators_neither_shuffle_nor_leave_the_jvm(docs):
    rules = policy.Policy({"SSN": "block"})
    frames = [
        detect.scan(docs), detect.findings(docs, ["doc_id"]), tokens.redact(docs), tokens.token_map(docs, ["doc_id"]),
        tokens.restore(tokens.redact(docs, with_map=True)), policy.classify(docs, rules), *policy.quarantine_split(docs, rules),
    ]
    for frame in frames:
        text = plan(frame)
        assert "Exchange" not in text and "Python" not in text and "MapInPandas" not in text


def test_only_needed_columns_are_read(docs):
    text = plan(detect.pii_counts(docs, ["lang"]))
    assert re.search(r"ReadSchema: struct<text:string,lang:string>", text)
    text = plan(tokens.redact(docs).select("doc_id", "items"))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_filters_reach_the_scan(docs):
    text = plan(detect.findings(docs.filter("lang = 'de'"), ["doc_id"]))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in text


@pytest.mark.parametrize("name", ["gateway_decisions", "rate_limit_admitted", "ttl_cache_hits", "budget_gate", "authenticate",
                                  "redact_by_source", "registry_after_changes", "dashboard", "user_by_id"])
def test_no_cross_joins(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_remembered_columns_follow_their_arguments(docs):
    first = detect.scan(docs).schema["matches"]
    assert detect.scan(docs, rules=Rules().disable("SECRET")).schema["matches"] == first
    a = plan(detect.scan(docs, rules=Rules().disable("EMAIL")))
    b = plan(detect.scan(docs))
    assert "Contains(text#" in a and a.count(", @)") < b.count(", @)")


# One user, key, source or instant with a third of everything or more: results stay whole.


def test_hot_user_and_key(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i // 40), "hot" if i % 3 else f"u{i}", 30, "k" if i % 3 else f"k{i}", 200,
             100, 10, "g") for i in range(20000)]
    df = spark.createDataFrame(
        rows, "request_id long, ts timestamp, user_id string, rate_limit int, content_key string, status int, "
        "input_tokens long, output_tokens long, group string"
    )
    limited = access.rate_limit(df)
    got = {r.user_id: r.n for r in limited.filter("admitted").groupBy("user_id").count().withColumnRenamed("count", "n").collect()}
    # 30 admitted at once, then 30 more each time the window has passed.
    assert got["hot"] == 30 * (500 // 60 + 1) and all(n == 1 for u, n in got.items() if u != "hot")
    assert limited.count() == len(rows)
    hits = reuse.ttl_cache_hits(df, ttl_seconds=60)
    stores = sorted(r.ts for r in hits.filter("content_key = 'k' and stored").collect())
    assert [(t - start).seconds for t in stores] == [61 * i for i in range(9)] and hits.count() == len(rows)
    gated = spend.budget_gate(df.withColumnRenamed("user_id", "user"), {"g": 1.0})
    last = gated.filter("user = 'hot'").agg(F.max("spent_before")).head()[0]
    hot = sum(1 for r in rows if r[2] == "hot") - 1
    assert last == hot * 100 / 1e6 * 3.0 + hot * 10 / 1e6 * 15.0


def test_everything_at_one_instant(spark):
    rows = [(i, datetime(2024, 1, 1), "u", 5, "k", 200) for i in range(3000)]
    df = spark.createDataFrame(
        rows, "request_id long, ts timestamp, user_id string, rate_limit int, content_key string, status int"
    ).repartition(8)
    admitted = [r.request_id for r in access.rate_limit(df).filter("admitted").collect()]
    assert sorted(admitted) == [0, 1, 2, 3, 4]
    hits = reuse.ttl_cache_hits(df)
    assert hits.filter("stored").head().request_id == 0 and hits.filter("hit").count() == 2999


def test_ordering_helpers_leave_no_hot_group(spark):
    """The numbering of one scope is done in several slices, the running total in several cells."""
    df = spark.range(5000).select(F.lit("s").alias("scope"), F.col("id").alias("v"))
    from sensitext.operators.ordering import rank_rows

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = rank_rows(df.orderBy(F.desc("v")), ["scope"], ["v"], "n")
        assert ranked.filter(F.col("n") != F.col("v") + 1).count() == 0
        assert re.search(r"row_number\(\) windowspecdefinition\(scope#\d+, _slice#\d+", plan(ranked))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
