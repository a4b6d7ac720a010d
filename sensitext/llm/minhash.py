"""Near-duplicate documents by fast similarity sketching.

The sketch of a set has ``bins`` coordinates. In round i every element is thrown into a random bin with the value
(i, random), and each bin keeps its smallest value; from round ``bins`` on, every element goes to bin i - ``bins``.
So after at most 2 * ``bins`` rounds every coordinate is filled, usually far earlier, and two sketches agree in a
coordinate with the probability of the sets' similarity, with the concentration of independent samples. Bands of
coordinates give candidates; every link is then confirmed on the full shingle sets.

How candidates become components without all pairs of a group:

1. documents with equal sets are one vertex (its smallest doc_id), found by a fingerprint of the set;
2. every band bucket links its vertices to one of them, within Arrow batches first, and the components of these
   links are clusters: whatever shares a bucket is in one cluster;
3. a cluster's full sets meet, in blocks of bounded size if there are many, and are linked in the task. Sets that are
   similar enough share one of their rarest elements (prefix filter), so candidates come from an index of those
   alone; what is known to be in one component is not compared again; only the links that join components leave the task.

A pair with similarity s shares a bucket with probability 1 - (1 - s**6)**64: a link at exactly 0.75 is missed
four times in a million, one at 0.8 once in 3e8; and it may still be found through its cluster.

Defined results: null and empty texts, and texts of white space, have the empty set and are linked with nothing.
Rows with one doc_id count as one document with the links of all their texts (an empty text is with its own doc_id). Rows without doc_id take no part: their
component is null and they are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import cut_lineage
from .components import components
from .words import Words, mix, plain, split_words, text_slices

_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sketch:
    """Shingles of ``width`` words; ``bands`` bands of ``rows`` coordinates; links at ``percent`` per cent or more.
    The sets of larger clusters meet in blocks of about ``block`` sets."""

    width: int = 5
    bands: int = 64
    rows: int = 6
    percent: int = 75
    block: int = 20_000

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sets as sorted 64-bit hashes, one after the other, and their bounds."""
    words = split_words(pc.ascii_lower(plain(texts)))
    return _sets(words, width)


def _sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, words.vocabulary.to_pylist()), np.uint64, len(words.vocabulary))
    hashes = of_word[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    rolled = np.full(max(len(hashes) - width + 1, 0), np.uint64(width))
    for k in range(width):
        rolled = mix(rolled * _GOLD + hashes[k : k + len(rolled)])
    found = []
    for start, end in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if end - start >= width:
            own = np.sort(rolled[start : end - width + 1])
            found.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif end > start:  # the whole sequence is one shingle, unlike any of full width
            one = np.full(1, np.uint64(end - start))
            for h in hashes[start:end]:
                one = mix(one * _GOLD + h)
            found.append(one)
        else:
            found.append(np.zeros(0, np.uint64))
    sizes = np.array([len(x) for x in found], np.int64)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def sketches(elements: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` values per set; rows of empty sets hold the largest number everywhere."""
    empty = np.uint64(2**64 - 1)
    n = len(bounds) - 1
    out = np.full((n, bins), empty)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for turn in range(2 * bins):
        if not len(owner):
            break
        h = mix(elements + np.uint64(turn * int(_GOLD) % 2**64))
        value = np.uint64(turn) << np.uint64(48) | mix(h + _GOLD) >> np.uint64(16)
        if turn < bins:
            cell = owner * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            cell = owner * bins + (turn - bins)
        np.minimum.at(flat, cell, value)
        open_ = (out == empty).any(axis=1)[owner]
        if not open_.all():
            elements, owner = elements[open_], owner[open_]
    return out


def _summaries(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """Per row: the size and a 128-bit fingerprint of the set, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            elements, bounds = shingle_sets(batch.column("text"), sketch.width)
            sizes = np.diff(bounds)
            prints = []
            for salt in (1, 2):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(mix(elements + np.uint64(salt))), dtype=np.uint64)])
                prints.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
            values = sketches(elements, bounds, sketch.bins)
            keys = np.broadcast_to(np.arange(sketch.bands, dtype=np.uint64), (len(sizes), sketch.bands)).copy()
            for k in range(sketch.rows):
                keys = mix(keys * _GOLD + values[:, k :: sketch.rows])
            ends = np.arange(len(sizes) + 1, dtype=np.int32) * sketch.bands
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), *map(pa.array, prints), bands], names=["doc_id", "n", "p1", "p2", "bands"]
            )

    schema = "doc_id long, n long, p1 long, p2 long, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i] to starts[i] + sizes[i], for all i one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def joining_links(ids: np.ndarray, sets: np.ndarray, bounds: np.ndarray, asks: np.ndarray, answers: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the sets that ask and those that answer, as many as join their components."""
    sizes = np.diff(bounds)
    _, element, often = np.unique(sets, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.lexsort((np.arange(len(often)), often))] = np.arange(len(often))
    owner = np.repeat(np.arange(len(ids)), sizes)
    ranks = rank[element]
    ranks = ranks[np.lexsort((ranks, owner))]  # rarest first in each set
    first = sizes - -(-percent * sizes // 100) + 1
    place = np.arange(len(ranks)) - np.repeat(bounds[:-1], sizes)
    listed = np.nonzero((place < first[owner]) & answers[owner])[0]
    listed = listed[np.argsort(ranks[listed], kind="stable")]
    known, holders = ranks[listed], owner[listed]
    label = np.unique(ids, return_inverse=True)[1]  # rows with one id are one vertex
    mine = np.zeros(len(often), bool)
    links = []
    for q in np.nonzero(asks)[0].tolist():
        own = ranks[bounds[q] : bounds[q + 1]]
        rare = own[: first[q]]
        low = np.searchsorted(known, rare)
        found = np.unique(holders[_ragged(low, np.searchsorted(known, rare, "right") - low)])
        n = len(own)
        found = found[(label[found] != label[q]) & (100 * sizes[found] >= percent * n) & (100 * n >= percent * sizes[found])]
        if not len(found):
            continue
        mine[own] = True
        many = sizes[found]
        shared = np.add.reduceat(mine[ranks[_ragged(bounds[found], many)]], np.cumsum(many) - many, dtype=np.int64)
        mine[own] = False
        for other in found[100 * shared >= percent * (n + many - shared)].tolist():
            if label[other] != label[q]:
                links.append((int(ids[q]), int(ids[other])))
                label[label == label[other]] = label[q]
    return links


def _bucket_stars(vertices: DataFrame) -> DataFrame:
    """(a, b): from (node, bands), in every band bucket links that join all its vertices.

    Vertices of one Arrow batch that share a bucket are linked there, and only the first goes on under the bucket's
    key. So the keys are shuffled once, and a bucket with a third of all vertices has one row per batch. The sorted
    rows of a partition are then read as a stream that remembers one vertex.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bands")
            key = lists.flatten().to_numpy().astype(np.int64)
            node = np.repeat(batch.column("node").to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            head = np.searchsorted(key, key)
            first = head == np.arange(len(key))
            links = np.unique(np.column_stack([node[head], node])[~first], axis=0)
            # A link needs no partner: it goes anywhere.
            anywhere = mix(links[:, 0].view(np.uint64) * _GOLD ^ links[:, 1].view(np.uint64)).view(np.int64)
            columns = (np.concatenate(c) for c in zip((key[first], node[first], node[first]), (anywhere, links[:, 0], links[:, 1])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_node = None
        for batch in batches:
            key, a, b = (batch.column(c).to_numpy() for c in ("key", "a", "b"))
            linked = a != b
            links = [np.column_stack([a[linked], b[linked]])]
            key, node = key[~linked], a[~linked]
            if len(key):
                head = node[np.searchsorted(key, key)]
                if last_key == key[0]:  # the bucket goes on from the batch before
                    head[: np.searchsorted(key, key[0], "right")] = last_node
                last_key, last_node = key[-1], head[-1]
                links.append(np.column_stack([head, node])[head != node])
            found = np.unique(np.concatenate(links), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    keyed = vertices.mapInArrow(settle, "key long, a long, b long").repartition("key").sortWithinPartitions("key")
    return keyed.mapInArrow(join, "a long, b long")


#: Bits of the filter of ids, and bits in one of its rows as Spark's bitmap functions cut them: 8 MB in 2,048 rows.
_FILTER_BITS, _ROW_BITS = 1 << 26, 1 << 15


def maybe_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (doc_id, text) whose doc_id may be among ``ids`` (doc_id): all that are, and few others.

    One hashed bit per id, in a table of at most 8 MB whatever the input, so it is broadcast. It keeps texts that
    a join would drop out of the join's shuffle; the more of the bits are set, the more rows pass.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER_BITS))
    row, bit = F.floor(place / _ROW_BITS).cast("int").alias("_row"), (place % _ROW_BITS).cast("int").alias("_bit")
    bitmaps = ids.select(row, bit).repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.select("doc_id", "text", row, bit).join(F.broadcast(bitmaps), "_row")
    return marked.filter(F.getbit(byte, F.col("_bit") % 8) == 1).select("doc_id", "text")


def _cluster_links(docs: DataFrame, clusters: DataFrame, sketch: Sketch) -> DataFrame:
    """(a, b): links that join the components of each cluster (node, component)."""
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / sketch.block).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "component").select(F.col("node").alias("doc_id"), "component", "blocks")
    texts = maybe_among(docs.select(F.col("doc_id").cast("long"), "text"), clusters.select(F.col("node").alias("doc_id"))).join(placed, "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            elements, bounds = shingle_sets(batch.column("text"), sketch.width)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(elements.view(np.int64)))
            columns = [batch.column(c) for c in ("doc_id", "component", "blocks")]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=["id", "component", "blocks", "shingles"])

    sets = texts.mapInArrow(make, "id long, component long, blocks int, shingles array<long>")
    # A set asks in the row of its block and answers in the column; with one block it does both at once.
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    meetings = F.array_distinct(F.concat(
        F.transform(every, lambda k: F.struct(k.alias("i"), own.alias("j"))), F.transform(every, lambda k: F.struct(own.alias("i"), k.alias("j")))
    ))
    met = sets.withColumn("own", own).select("id", "component", "own", "shingles", F.inline(meetings))

    def link(table: pa.Table) -> pa.Table:
        ids, block = (table.column(c).to_numpy() for c in ("id", "own"))
        lists = table.column("shingles").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        links = joining_links(ids, lists.flatten().to_numpy(), bounds, block == i, block == j, sketch.percent)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("component", "i", "j").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    found = cut_lineage(_summaries(docs, sketch), "sketches")
    usable = found.filter("n > 0 and doc_id is not null")
    classes = cut_lineage(usable.groupBy("p1", "p2").agg(F.min("doc_id").alias("node")), "classes")
    vertices = usable.withColumn("node", F.col("doc_id")).join(classes, ["node", "p1", "p2"], "left_semi").select("node", "bands")
    clusters = cut_lineage(components(_bucket_stars(vertices)), "clusters")
    links = _cluster_links(docs, clusters, sketch)
    # A doc_id with several texts belongs to several classes; its rows are one document.
    own = cut_lineage(usable.select("doc_id", "p1", "p2").join(classes, ["p1", "p2"]).select("doc_id", "node"), "own")
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a < most").drop("most")
    same = own.join(several, "doc_id").filter("node > a").select("a", F.col("node").alias("b"))
    graph = components(links.union(same))

    placed = found.select("doc_id", "n", "p1", "p2").join(classes, ["p1", "p2"], "left").join(graph, "node", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of those with equal doc_id (null equals null) and text, the one with the smallest other columns.

    Only rows that do repeat are grouped by their texts; they are found by digests.
    """
    digest = "_" * (1 + max(map(len, docs.columns)))
    shown = docs.withColumn(digest, F.struct("doc_id", F.sha2("text", 256)))
    twice = shown.groupBy(digest).count().filter("count > 1").select(digest)
    again = shown.join(twice, digest, "left_semi")
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    least = F.min(F.struct(F.lit(0).alias(digest), *others)).alias(digest)
    again = again.groupBy("doc_id", "text").agg(least).select("doc_id", "text", *[F.col(f"{digest}.{c}").alias(c) for c in others])
    return shown.join(twice, digest, "left_anti").select(*docs.columns).union(again.select(*docs.columns))
