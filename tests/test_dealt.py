"""Inputs of the registered queries are dealt to tasks by their rows, however few row groups their files have."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from sensitext.operators import detect
from sensitext.plans import inputs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Customers and events as one row group each."""
    out = str(tmp_path_factory.mktemp("dealt"))
    keys = spark.range(0, 12000, 1, 1)
    keys.select(
        F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")
    ).write.parquet(f"{out}/customer.parquet")
    return out


def test_customers_are_dealt_by_rows(spark, folder, monkeypatch):
    rows = inputs.customers(spark, folder)
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(inputs, "CUSTOMER_ROWS", 500)
    many = inputs.customers(spark, folder)
    sizes = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert many.rdd.getNumPartitions() == 24 and len(sizes) == 24 and max(sizes) < 700 and sum(sizes) == 12000
    # The scan runs where the rows were dealt to.
    assert detect.findings(many, ["c_custkey"]).rdd.getNumPartitions() == 24


def test_registries_are_dealt_by_users(spark, folder, monkeypatch):
    monkeypatch.setattr(inputs, "USER_ROWS", 500)
    users = inputs.registry(spark, folder)
    plan = users._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [c_custkey" in plan and "], 24" in plan
    assert users.count() == 12000 and users.filter("size(tokens) <> 2").count() == 0


def test_usage_is_read_once_and_by_its_own_name(spark):
    """The map of all members is for names that differ in case; the budget reads each body once."""
    from sensitext.operators import spend
    from sensitext.plans.catalog import QUERIES

    bodies = ['{"usage":null,"Usage":{"prompt_tokens":3}}', '{"usage":{"prompt_tokens":null,"Prompt_Tokens":5,"completion_tokens":1}}',
              '{"Usage":{"PROMPT_TOKENS":3},"USAGE":{"prompt_tokens":9}}', '{"usage":{"prompt_tokens":1,"total_tokens":"x"}}',
              '{"usage":{"prompt_tokens":1,"total_tokens":null}}', '{"usage":[1]}', "3", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {r.id: (r.input_tokens, r.output_tokens) for r in spend.parse_usage(df).collect()}
    assert got == {1: (0, 1), 2: (9, 0), 4: (1, 0)}
    plan = QUERIES["budget_gate"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("parseJson") <= 2


def test_stretches_of_equal_keys():
    import pandas as pd

    from sensitext.operators.base import run_splitter

    batch = pd.DataFrame({"a": ["x", "x", "y", "y"], "b": [1, 1, 1, 2], "c": [9, 8, 7, 6]})
    assert list(run_splitter()(batch, ["a", "b"])) == [(("x", 1), 0, 2), (("y", 1), 2, 3), (("y", 2), 3, 4)]


def test_starts_are_necessary(spark):
    """What a rule says its matches start with loses none of them."""
    from sensitext.functions.rules import BUILTIN
    from sensitext.functions.patterns import to_spark_regex

    texts = ["+1-555-123-4567", "x+1 555 123 4567", "(555) 123-4567", "a(555)1234567", "ü5551234567", "555.123.4567", "172.16.1.1",
             "x172.16.1.1", "ß172.31.0.9 172.32.0.1", "((555) 123-4567"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for rule in [r for r in BUILTIN if r.starts]:
        pairs = [(F.regexp_extract_all("text", F.lit(x), F.lit(0))) for x in (rule.regex, to_spark_regex(rule.pattern))]
        rows = df.select(pairs[0].alias("a"), pairs[1].alias("b")).collect()
        assert all(r.a == r.b for r in rows) and any(r.a for r in rows)
