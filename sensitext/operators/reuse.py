"""Repeat requests and time-limited response reuse, by content hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import percent
from ..settings import DEFAULTS
from .base import run_splitter


def content_key(body: Column, *more: Column) -> Column:
    """Hex SHA-256 of the body. Further columns (method, path, user) keep equal bodies apart."""
    if not more:
        return F.sha2(body, 256)
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (body, *more)]
    # Lengths in front keep ("ab", "c") and ("a", "bc") different.
    return F.sha2(F.concat_ws("|", *[F.octet_length(p) for p in parts], *parts), 256)


def content_repeats(requests: DataFrame, body: str = "body", *more: str) -> DataFrame:
    """Content keys with the number of requests that share them."""
    key = content_key(F.col(body), *[F.col(c) for c in more])
    return requests.groupBy(key.alias("content_key")).agg(F.count("*").alias("requests"))


def _anchors(lifetime: int):
    """Fold over storable instants ordered by (key, stretch, time): those that store anew.

    From one store it jumps to the first instant after that store has expired.
    """

    runs = run_splitter()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stored_at = None, 0
        for batch in batches:
            times, stores = batch["_us"].to_numpy(), []
            for key, i, end in runs(batch, ["_key", "_stretch"]):
                if key == current:
                    i += int(np.searchsorted(times[i:end], stored_at + lifetime, side="right"))
                while i < end:
                    current, stored_at = key, int(times[i])
                    stores.append(i)
                    i += int(np.searchsorted(times[i:end], stored_at + lifetime, side="right"))
            yield batch.iloc[stores][["_key", "_us", "_id", "_code"]]

    return fold


def ttl_cache_hits(
    requests: DataFrame,
    key: str = "content_key",
    ts: str = "ts",
    order: str = "request_id",
    status: str | None = "status",
    ttl_seconds: int = DEFAULTS.cache_ttl_seconds,
) -> DataFrame:
    """Replays a response store with a lifetime over a request log.

    Adds ``hit`` (the key was stored at most ``ttl_seconds`` ago; hits do not prolong it), ``stored`` (a
    miss whose 2xx response is kept), ``source_id`` and ``source_status``, the request whose response is in
    use and its status. Rows with a null key take no part. Stores of one key are more than a lifetime apart, so time cells one lifetime
    wide hold at most one store each: a request finds its store by an equi-join on (key, cell). Only
    distinct storable instants in unbroken multi-cell stretches of a key go through the sequential fold.
    """
    lifetime = (ttl_seconds if ttl_seconds > 0 else DEFAULTS.cache_ttl_seconds) * 1_000_000
    width = lifetime + 1
    rows = requests.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = rows.withColumn("_cell", F.expr(f"_us div {width}"))
    can_store = F.col(status).between(200, 299) if status else F.lit(True)
    storable = rows.filter(can_store & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), "_us", "_cell", F.col(order).alias("_id"),
        (F.col(status).cast("int") if status else F.lit(None).cast("int")).alias("_code"),
    )
    per_cell = storable.groupBy("_key", "_cell").agg(
        F.min(F.struct("_us", "_id", "_code")).alias("_first"), F.max("_us").alias("_last_us")
    )
    by_cell = Window.partitionBy("_key").orderBy("_cell")
    gap = F.col("_first._us") - F.lag("_last_us").over(by_cell)
    starts = F.when(gap.isNull() | (gap > lifetime), F.col("_cell"))
    per_cell = per_cell.withColumn("_start", starts).withColumn(
        "_stretch",
        F.last("_start", ignorenulls=True).over(by_cell.rowsBetween(Window.unboundedPreceding, 0)),
    )
    goes_on = F.lead("_cell").over(by_cell).isNotNull() & F.lead("_start").over(by_cell).isNull()
    per_cell = per_cell.withColumn("_long", F.col("_start").isNull() | goes_on)
    # A stretch inside one cell stores once, at its first instant.
    simple = per_cell.filter("not _long").select("_key", "_first.*")
    long = per_cell.filter("_long").select("_key", "_cell", "_stretch")
    instants = (
        storable.join(long, ["_key", "_cell"])
        .groupBy("_key", "_stretch", "_us")
        .agg(F.min(F.struct("_id", "_code")).alias("_m"))
        .select("_key", "_stretch", "_us", "_m.*")
        .repartition("_key", "_stretch")
        .sortWithinPartitions("_key", "_stretch", "_us")
    )
    types = dict(storable.dtypes)
    folded = instants.mapInPandas(
        _anchors(lifetime), f"_key {types['_key']}, _us bigint, _id {types['_id']}, _code int"
    )
    store = F.struct(F.col("_us").alias("us"), F.col("_id").alias("id"), F.col("_code").alias("code"))
    stores = simple.unionByName(folded).select("_key", F.expr(f"_us div {width}").alias("_own"), store.alias("_s"))
    # Each store serves its own cell and the next one.
    lookup = (
        stores.select("_key", "_own", "_s", F.explode(F.array("_own", F.col("_own") + 1)).alias("_at"))
        .groupBy("_key", "_at")
        .agg(
            F.max(F.when(F.col("_own") == F.col("_at"), F.col("_s"))).alias("_here"),
            F.max(F.when(F.col("_own") < F.col("_at"), F.col("_s"))).alias("_back"),
        )
    )
    joined = rows.join(lookup, (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_at")), "left")
    me = F.struct(F.col("_us").alias("us"), F.col(order).alias("id"))
    here = F.struct(F.col("_here.us").alias("us"), F.col("_here.id").alias("id"))
    used = F.when(F.col("_here").isNotNull() & (here <= me), F.col("_here")).when(
        F.col("_back.us") + lifetime >= F.col("_us"), F.col("_back")
    )
    joined = joined.withColumn("_used", used)
    stored = F.coalesce(F.col("_used.id") == F.col(order), F.lit(False))
    return (
        joined.withColumn("stored", stored)
        .withColumn("hit", F.col("_used").isNotNull() & ~F.col("stored"))
        .withColumn("source_id", F.col("_used.id"))
        .withColumn("source_status", F.col("_used.code"))
        .drop("_us", "_cell", "_key", "_at", "_here", "_back", "_used")
    )


def cache_stats(
    replayed: DataFrame,
    key: str = "content_key",
    ts: str = "ts",
    order: str = "request_id",
    max_entries: int = DEFAULTS.cache_max_entries,
) -> DataFrame:
    """One row from ``ttl_cache_hits``: hits, misses, entries, max_entries, hit_rate.

    ``entries`` counts the keys still stored after their last request. The replay itself has no size limit.
    """
    held = F.struct(ts, order, (F.col("hit") | F.col("stored")).alias("held"))
    per_key = replayed.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.max(held).alias("last")
    )
    total = per_key.agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"),
        F.count_if("last.held").alias("entries"),
    )
    return total.withColumn("max_entries", F.lit(max_entries).cast("bigint")).withColumn(
        "hit_rate", percent(F.col("hits"), F.col("hits") + F.col("misses"))
    )


def reuse_responses(replayed: DataFrame, responses: DataFrame, order: str = "request_id") -> DataFrame:
    """Hits with the stored response they are served (columns of ``responses``, joined on the source)."""
    stored = responses.withColumnRenamed(order, "source_id")
    return replayed.filter("hit").select(order, "source_id").join(stored, "source_id")
