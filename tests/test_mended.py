"""Faults that once gave wrong answers on inputs the registered tables do not hold."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sensitext import Rules, clean_scratch, rate_limit, redact, redact_table, restore_table, scratch
from sensitext.functions.patterns import to_spark_regex
from sensitext.operators.audit import rfc3339
from sensitext.settings import cut_lineage, scratch_folder
from sensitext.sources import tables


def test_a_damaged_registry_is_an_error(spark, tmp_path):
    path = tmp_path / "users.json"
    path.write_text(json.dumps([{"id": "u1", "name": "ann", "tokens": []}])[:-9])
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        tables.read_registry(spark, str(path)).collect()
    (tmp_path / "changes").mkdir()
    (tmp_path / "changes" / "a.json").write_text('{"seq": 1, "op": "create_u')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        tables.read_registry_changes(spark, str(tmp_path / "changes")).collect()
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"request_id": 1, "body": "x"}\n{"request_id": 2, "bo')
    rows = {r.request_id: r[tables.CORRUPT] for r in tables.read_requests(spark, str(tmp_path / "log")).collect()}
    assert rows == {1: None, None: '{"request_id": 2, "bo'}


def test_audit_times_are_utc_in_every_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Asia/Tokyo", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            at = spark.range(1).select(rfc3339(F.timestamp_seconds(F.lit(1704067200))).alias("t")).head().t
            assert at == "2024-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rows_with_one_key_keep_their_own_texts(spark):
    rows = [(1, "s", "mail a@example.com"), (1, "s", "hi verylongname@example.com b@example.com"), (1, "s", "mail a@example.com"), (2, "s", "b@example.com")]
    df = spark.createDataFrame(rows, "k long, s string, text string")
    with scratch(spark):
        out, tokens = redact_table(df, ["k"], ["s"])
        got = sorted(r.redacted for r in out.collect())
        assert all("@" not in t for t in got)
        back = restore_table(out, ["k"], ["s"], tokens).collect()
        assert sorted(r.restored for r in back) == sorted(t for _, _, t in rows)


def test_no_shuffle_files_stay_behind_a_frozen_step(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffles(), spark.conf.get(setting)
    frozen = cut_lineage(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):  # they go in the background
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and frozen.count() == 7 and spark.conf.get(setting) == was


def test_nothing_is_left_in_scratch(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def listed():
        return {f.getPath().getName() for f in files.listStatus(folder)} if files.exists(folder) else set()

    before = listed()
    with scratch(spark):
        df = spark.createDataFrame([(1, "s", "mail a@example.com")], "k long, s string, text string")
        redact_table(df, ["k"], ["s"])[0].collect()
        assert len(listed()) > len(before)
    assert listed() == before
    cut_lineage(spark.range(3))
    assert clean_scratch(spark) >= 1


def test_each_request_is_judged_by_the_limit_it_carries(spark):
    rows = [(i, f"2024-01-01 00:00:0{i}", "u", limit) for i, limit in enumerate([5, 5, 1, 1, 1, 5])]
    df = spark.createDataFrame(rows, "request_id long, ts string, user_id string, rate_limit int").withColumn("ts", F.to_timestamp("ts"))
    got = [r.admitted for r in rate_limit(df).orderBy("request_id").collect()]
    assert got == [True, True, False, False, False, True]


@pytest.mark.parametrize("pattern,text,found", [
    (r"\b(?:EMP-)?\d{6}", "x123456 EMP-123456 123456", ["EMP-123456", "123456"]),
    (r"\b(?:ab)?c", "xc abc c", ["abc", "c"]),
    (r"\b(?:\d{3}-){0,1}\d{4}", "x1234 123-4567 9999", ["123-4567", "9999"]),
    (r"[[:^alpha:]]+x", "ab12x", ["12x"]),
    (r"a\vb", "a\x0bb a\nb", ["a\x0bb"]),
    (r"[[:word:]]+-", "ab_1- ?", ["ab_1-"]),
    (r"\p{Greek}+", "ab αβγ", ["αβγ"]),
])
def test_custom_patterns_mean_what_the_dialect_says(spark, pattern, text, found):
    rules = Rules().only().add("X", pattern, spark)
    row = redact(spark.createDataFrame([(text,)], "text string"), rules=rules, with_map=True).head()
    assert sorted(row.tokens.values()) == sorted(found)


@pytest.mark.parametrize("pattern", [r"(?=a)b", r"a(?!b)", r"(?<=a)b", r"(a)\1", "a++", "a{2}+", "(?>a)b", r"\b", "a*", "x|"])
def test_patterns_the_dialect_refuses(spark, pattern):
    with pytest.raises(ValueError):
        Rules().add("X", pattern, spark)


def test_names_with_brackets_are_refused(spark):
    with pytest.raises(ValueError):
        Rules().add("ID]X", "abc", spark)
    assert to_spark_regex(r"a\++") == r"a\++"
