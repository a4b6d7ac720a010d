"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (iterative quantisation after centring) turns every vector into a binary code
of 64 bits, cut into 8 substrings that are each indexed. Two codes that differ in at most r bits differ in at most
floor(r / 8) bits in some substring (pigeonhole), so probing every substring with all values that near retrieves every
code within r. Candidates are found once, at their first substring that is near, and are reranked by the
Euclidean distance of the original vectors in double precision.

The radius is chosen on the sample: ``quantile`` of the distances in bits between sample vectors and their true
neighbours in the sample, which are no nearer than those in the whole table. Queries that find fewer than k
neighbours are asked again with a larger radius, at last with all 64 bits, which retrieves everything.

Equal vectors are indexed once, with their k + 1 smallest ids: no result can hold more of them. They are settled per
Arrow batch before they are shuffled.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those with
another length than most of the sample; rows without vec_id neither. Repeated rows count once. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import cut_lineage

BITS, PARTS = 64, 8
WIDTH = BITS // PARTS


@dataclass(frozen=True)
class Search:
    """``sample`` vectors (those with the smallest hash of their id) and ``probes`` of them as queries fit the codes;
    a slice of the index holds about ``slice`` vectors."""

    k: int = 10
    sample: int = 10_000
    probes: int = 500
    turns: int = 30
    quantile: float = 0.95
    slice: int = 200_000


@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        bits = ((vectors - self.mean) @ self.rotation > 0).astype(np.uint8)
        return np.packbits(bits, axis=1).view(">i8")[:, 0].astype(np.int64)


def usable(column: Column) -> Column:
    """Whether a vector takes part."""
    wide = column.cast("array<double>")
    infinite = F.lit(float("inf"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.coalesce(column.isNotNull() & finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def learn_codes(vectors: np.ndarray, search: Search = Search()) -> Codes:
    """Rotates the principal axes so that the signs lose least, and sets the radius."""
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    dims = vectors.shape[1]
    axes = axes[:, ::-1][:, : min(BITS, dims)]
    random = np.random.default_rng(7)
    if dims >= BITS:
        projection = axes
    else:  # fewer dimensions than bits: a random frame of BITS directions over all axes
        projection = axes @ random.normal(size=(dims, BITS)) / np.sqrt(dims)
    projected = centred @ projection
    rotation = np.linalg.qr(random.normal(size=(BITS, BITS)))[0]
    for _ in range(search.turns):
        signs = np.where(projected @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        rotation = (left @ right).T
    codes = Codes(mean, projection @ rotation, BITS)
    signs = (centred @ codes.rotation > 0).astype(np.float32)
    far = []
    squares = (centred**2).sum(axis=1)
    for i in range(min(search.probes, len(vectors))):
        apart = squares + squares[i] - 2 * centred @ centred[i]
        apart[i] = np.inf
        near = np.argpartition(apart, min(search.k, len(vectors) - 1) - 1)[: min(search.k, len(vectors) - 1)]
        far.extend(np.abs(signs[near] - signs[i]).sum(axis=1).astype(int))
    return Codes(mean, codes.rotation, int(np.quantile(far, search.quantile, method="higher")) if far else BITS)


def fit_codes(vectors: DataFrame, search: Search = Search()) -> Codes | None:
    """From (vec_id, embedding) rows that take part; at most ``sample`` of them come to the driver."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(search.sample).collect()
    if not some:
        return None
    length = Counter(len(r.embedding) for r in some).most_common(1)[0][0]
    return learn_codes(np.array([r.embedding for r in some if len(r.embedding) == length], np.float64), search)


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """(embedding, ids): each different vector once with its ``most`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            number = batch.column("print").dictionary_encode().indices.to_numpy()
            order = np.lexsort((ids, number))
            heads = np.searchsorted(number[order], number[order])
            yield batch.take(pa.array(order[np.arange(len(order)) - heads < most]))

    # + 0.0 makes minus zero zero; the text of a float is exact.
    same = F.md5(F.transform("embedding", lambda x: x + F.lit(0.0)).cast("string"))
    rows = vectors.select("vec_id", "embedding", same.alias("print"))
    rows = rows.mapInArrow(run, rows.schema)
    place = F.row_number().over(Window.partitionBy("print").orderBy("vec_id"))
    few = rows.dropDuplicates(["print", "vec_id"]).withColumn("place", place).filter(F.col("place") <= most)
    return few.groupBy("print").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids")).drop("print")


def with_codes(vectors: DataFrame, codes: Codes) -> DataFrame:
    """Adds the code of each embedding; rows of another length go."""
    length = len(codes.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat = lists.flatten().to_numpy().astype(np.float64).reshape(-1, length)
            yield batch.append_column("code", pa.array(codes.of(flat)))

    same = vectors.filter(F.size("embedding") == length)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return same.mapInArrow(run, f"{fields}, code long")


def _indexed(vectors: DataFrame, *columns: str) -> DataFrame:
    """One row per substring of each code."""
    value = [F.shiftrightunsigned("code", p * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int") for p in range(PARTS)]
    parts = F.array(*[F.struct(F.lit(p).alias("part"), v.alias("value")) for p, v in enumerate(value)])
    return vectors.select(*columns, "code", F.inline(parts))


def _floats(lists: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in lists.chunks]).to_numpy().astype(np.float64)
    return flat.reshape(len(lists), -1)


def within_radius(queries: DataFrame, index: DataFrame, radius: int, search: Search, slices: int) -> DataFrame:
    """(query_id, score, ids): of all vectors with a code within ``radius`` bits, found once each, those that can be
    among a query's k nearest: the k + 1 nearest of every bucket.

    A bucket is a value of a substring; its vectors are dealt to ``slices`` slices, so that no task holds more of them
    than a slice, and meet all queries that probe the value, some at a time."""
    near, many = radius // PARTS, search.k + 1
    flips = [sum(1 << b for b in bits) for n in range(near + 1) for bits in combinations(range(WIDTH), n)]
    asked = _indexed(queries, "query_id", "embedding").withColumn("flip", F.explode(F.array(*map(F.lit, flips))))
    asked = asked.withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    byte = np.uint64((1 << WIDTH) - 1)
    empty = pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def run(probes: pa.Table, bucket: pa.Table) -> pa.Table:
        if not probes.num_rows or not bucket.num_rows:
            return empty.empty_table()
        part = bucket.column("part")[0].as_py()
        codes = bucket.column("code").to_numpy().view(np.uint64)
        vectors, ids = _floats(bucket.column("embedding")), bucket.column("ids").combine_chunks()
        least = np.array([x[0].as_py() for x in ids])
        query_ids, own, asked_codes = probes.column("query_id").to_numpy(), _floats(probes.column("embedding")), probes.column("code").to_numpy().view(np.uint64)
        out = []
        step = max(1, (1 << 20) // len(codes))
        for s in range(0, len(query_ids), step):
            differing = asked_codes[s : s + step, None] ^ codes[None, :]
            found = np.bitwise_count(differing) <= radius
            for p in range(part):  # found at an earlier substring already
                found &= np.bitwise_count(differing >> np.uint64(p * WIDTH) & byte) > near
            i, j = np.nonzero(found)
            score = np.sqrt(((own[s : s + step][i] - vectors[j]) ** 2).sum(axis=1))
            order = np.lexsort((least[j], score, i))
            i, j, score = i[order], j[order], score[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < many
            out.append((query_ids[s : s + step][i[best]], score[best], j[best]))
        query, score, j = map(np.concatenate, zip(*out))
        return pa.Table.from_arrays([pa.array(query), pa.array(score), ids.take(pa.array(j))], schema=empty)

    keys = ("part", "value", "slice")
    return asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(run, "query_id long, score double, ids array<long>")


def nearest(vectors: DataFrame, is_query: Column, search: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest found, nearest first, ties to smaller ids."""
    good = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), "embedding")
    codes = fit_codes(good, search)
    if codes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    different = cut_lineage(with_codes(distinct_vectors(good, search.k + 1), codes), "vectors")
    slices = 1 + different.count() // search.slice
    slice_ = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(slices)).cast("int").alias("slice")
    index = _indexed(different, "embedding", "ids", slice_)
    queries = with_codes(good.filter(is_query).dropDuplicates(["vec_id"]), codes).withColumnRenamed("vec_id", "query_id")
    left = cut_lineage(queries, "queries")
    radius, found = codes.radius, None
    while True:
        near = within_radius(left, index, radius, search, slices)
        rows = near.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        best = cut_lineage(rows.withColumn("rank", place).filter(F.col("rank") <= search.k), "nearest")
        if radius >= BITS:
            return best if found is None else found.union(best)
        whole = best.filter(F.col("rank") == search.k).select("query_id")
        left = cut_lineage(left.join(whole, "query_id", "left_anti"), "queries")
        done = best.join(whole, "query_id", "left_semi")
        found = done if found is None else found.union(done)
        if left.isEmpty():
            return found
        radius = min(BITS, radius + 12)
