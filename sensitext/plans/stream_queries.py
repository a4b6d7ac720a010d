"""Registered queries that run the streaming forms over the given tables until they are used up.

Each reads its table as a file stream, writes to the scratch folder and returns what was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import reuse
from ..operators.spend import budget_of, usage_of
from ..settings import scratch_folder
from ..streaming import streams
from . import inputs, log_queries, text_queries  # noqa: F401
from .registered import ORACLES, query


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    schema = inputs.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/{name}.parquet*")


def _run(writer: DataStreamWriter, checkpoint: str) -> None:
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()


def _written(stream: DataFrame) -> DataFrame:
    """Runs an append-mode stream into a parquet sink and reads the sink."""
    spark = stream.sparkSession
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    _run(stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out"), f"{folder}/log")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _last_state(stream: DataFrame) -> DataFrame:
    """Runs a complete-mode stream; the sink always holds the latest full result."""
    spark = stream.sparkSession
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    _run(stream.writeStream.foreachBatch(replace).outputMode("complete"), f"{folder}/log")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_redact", ORACLES["redact_documents"])
def stream_redact(spark, sf_dir):
    out = streams.stream_redact(stream_table(spark, sf_dir, "documents"))
    return _written(out.select("doc_id", "redacted", "items", F.array_join("types", ",").alias("types")))


@query(
    "stream_policy",
    f"""select doc_id, 'blocked' as half, blocked_types, message, text from ({ORACLES["policy_blocked_docs"]})
    union all select doc_id, 'clean', null, null, redacted from ({ORACLES["policy_clean_docs"]})""",
)
def stream_policy(spark, sf_dir):
    """Both halves: quarantined documents as they are, the others redacted."""
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = streams.stream_policy(
        stream_table(spark, sf_dir, "documents"), text_queries.POLICY, f"{folder}/clean", f"{folder}/blocked"
    )
    _run(writer, f"{folder}/log")
    blocked = spark.read.parquet(f"{folder}/blocked")
    clean = spark.read.parquet(f"{folder}/clean")
    nothing = F.lit(None).cast("string")
    return blocked.select(
        "doc_id", F.lit("blocked").alias("half"), F.array_join("blocked_types", ", ").alias("blocked_types"), "message", "text"
    ).union(clean.select("doc_id", F.lit("clean"), nothing, nothing, "redacted"))


@query(
    "stream_audit_rollup",
    """select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%dT%H') as hour, event_type as event, count(*) as events
    from events group by 1, 2""",
)
def stream_audit_rollup(spark, sf_dir):
    """Every bucket, open ones included: complete mode into a sink that is replaced."""
    events = stream_table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"), F.lit(1).alias("items")
    )
    rolled = _last_state(streams.stream_audit_rollup(events, ["event"]))
    return rolled.select(F.date_format("bucket", "yyyy-MM-dd'T'HH").alias("hour"), "event", "events")


@query("stream_spend", ORACLES["spend_by_user"])
def stream_spend(spark, sf_dir):
    text = inputs.RESPONSES.replace("select event_id as request_id", "select concat('user', cast(user_id as string)) as user")
    made = text.replace("{", "{{").replace("}", "}}").replace("from events", "from {src}")
    answers = spark.sql(made, src=stream_table(spark, sf_dir, "events"))
    totals = _last_state(streams.stream_spend(answers))
    return totals.withColumn("estimated_usd", F.round("estimated_usd", 9))


def _rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)


@query("stream_rate_limit", ORACLES["rate_limit_admitted"])
def stream_rate_limit(spark, sf_dir):
    _rocksdb(spark)
    log = inputs.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), "ts", "user_id", F.lit(3).alias("rate_limit")
    )
    judged = streams.stream_rate_limit(_in_time_order(log, "ts", 4), window_seconds=6 * 3600)
    return _written(judged).select("request_id", "admitted")


def _in_time_order(df: DataFrame, ts: str, parts: int) -> DataFrame:
    """The rows as a stream of ``parts`` micro-batches, earlier rows first."""
    spark = df.sparkSession
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}/in"
    rows = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    bounds = rows.approxQuantile("_us", [i / parts for i in range(1, parts)], 0.01)
    many = 1
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = rows.filter((F.lit(low is None) | (F.col("_us") > F.lit(low))) & (F.lit(high is None) | (F.col("_us") <= F.lit(high))))
        part.drop("_us").write.mode("append").parquet(folder)
        many = max(many, -(-len(spark.read.parquet(folder).inputFiles()) // parts))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", many).parquet(folder)


@query("stream_budget_gate", f"select request_id, refused from ({ORACLES['budget_gate']})")
def stream_budget_gate(spark, sf_dir):
    """The budget gate over several micro-batches decides as the replay does."""
    _rocksdb(spark)
    log = inputs.usage_log(spark, sf_dir)
    usage = usage_of(F.col("body"))
    log = log.select(
        "request_id", "user", "ts", usage["input_tokens"].alias("input_tokens"), usage["output_tokens"].alias("output_tokens"),
        budget_of(F.col("group"), inputs.BUDGETS).alias("budget_usd"),
    )
    return _written(streams.stream_budget_gate(_in_time_order(log, "ts", 4))).select("request_id", "refused")


@query(
    "stream_cache_hits",
    ORACLES["ttl_cache_hits"].replace(", coalesce(st[2] = id, false) as stored", ""),
)
def stream_cache_hits(spark, sf_dir):
    _rocksdb(spark)
    log = inputs.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), "ts", reuse.content_key(F.col("props")).alias("content_key"),
        F.when(F.col("event_type").isin("error", "signup"), 503).otherwise(200).alias("status"),
    )
    found = streams.stream_cache_hits(_in_time_order(log, "ts", 4), ttl_seconds=6 * 3600)
    return _written(found).select("request_id", "hit", "source_id")


@query("stream_repeat_filter", "select sha256(text) as content_key from documents group by 1")
def stream_repeat_filter(spark, sf_dir):
    docs = stream_table(spark, sf_dir, "documents").withColumn("ts", F.current_timestamp())
    return _written(streams.stream_repeat_filter(docs, body="text", lateness="1 hour").select("content_key"))
