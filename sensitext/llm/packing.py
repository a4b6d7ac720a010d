"""Best-fit packing planned on the histogram of lengths.

Documents are cut into pieces of at most ``room`` tokens. Only how many pieces there are of each length goes to the
driver: at most ``room`` counts. Best-fit, longest first, is carried out there on groups of equal sequences: pieces of
one length go into the open sequences with the least room that holds them, and a group splits when only some of its
sequences get one. So planning takes a number of steps bounded by ``room``, whatever the corpus. The pieces then take
their planned slots by rank within their length; a rank is the place within a task plus the pieces of that length in the
tasks before, so no length is gathered in one place.

Defined results: null and empty texts consist of the closing id alone, so every row has at least one piece. Rows
with one doc_id are packed each for itself. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import cut_lineage
from .encoding import Encoder
from .words import SLICE_BYTES, text_slices


@dataclass
class Group:
    """``many`` sequences with the same pieces: (length, how often, offset of the first)."""

    many: int
    free: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)


def plan(histogram: dict[int, int], room: int) -> list[Group]:
    """Groups of sequences that hold all pieces: best-fit decreasing, on counts."""
    open_: dict[int, list[Group]] = {}
    free: list[int] = []  # the rooms that groups have, kept sorted

    def put(group: Group) -> None:
        if group.free not in open_:
            open_[group.free] = []
            at = int(np.searchsorted(free, group.free)) if free else 0
            free.insert(at, group.free)
        open_[group.free].append(group)

    def add(group: Group, many: int, length: int, times: int) -> None:
        put(Group(many, group.free - length * times, [*group.pieces, (length, times, room - group.free)]))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = int(np.searchsorted(free, length)) if free else 0
            if at < len(free):
                key = free[at]
                group = open_[key].pop()
                if not open_[key]:
                    del open_[key], free[at]
            else:  # a new sequence takes as many of this length as it holds
                times = min(room // length, left)
                group = Group(max(left // times, 1), room)
            times = group.free // length
            whole = min(group.many, left // times)
            rest = min(left - whole * times, times) if whole < group.many else 0
            if whole:
                add(group, whole, length, times)
            if rest and rest < times:
                add(group, 1, length, rest)
            else:
                rest = 0
            left -= whole * times + rest
            if group.pieces and group.many > whole + bool(rest):
                put(Group(group.many - whole - bool(rest), group.free, group.pieces))
    return [g for groups in open_.values() for g in groups]


def slots(groups: list[Group]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: from which rank on pieces go where."""
    rows, sequence = [], 0
    taken: dict[int, int] = {}
    for group in groups:
        for length, times, offset in group.pieces:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, times, offset))
            taken[length] = first + times * group.many
        sequence += group.many
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "times", "offset"), table.T))


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long"


def cut_pieces(docs: DataFrame, tokenizer: str, room: int = 2048, close: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it starts, its length and checksum (and its ids, if asked for), the task that made it
    and its place among that task's pieces of the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        made = np.zeros(room + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in text_slices(batches, "text", SLICE_BYTES // 2):
            ids, bounds = encoder.ids(batch.column("text"))
            sizes = np.diff(bounds) + 1
            closed = np.full(len(ids) + len(sizes), close, np.uint32)
            inner = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), np.diff(bounds))
            closed[inner] = ids
            pieces = -(-sizes // room)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * room
            length = np.minimum(sizes[row] - start, room)
            first = (np.cumsum(sizes) - sizes)[row] + start
            raw = memoryview(closed.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(first.tolist(), (first + length).tolist())]
            order = np.argsort(length, kind="stable")
            heads = np.searchsorted(length[order], length[order])
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - heads
            place += made[length]
            made += np.bincount(length, minlength=room + 1)
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32))]
            columns += [pa.array(x) for x in (start, length)]
            columns += [pa.array(sums, pa.int64()), pa.array(np.full(len(row), part)), pa.array(place)]
            names = [f.split()[0] for f in _PIECES.split(", ")]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(closed.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
            pa.default_memory_pool().release_unused()

    schema = _PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit(pieces: DataFrame, room: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset. They are written once, so ranks and counts are of the same rows."""
    pieces = cut_lineage(pieces, "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("many"))
    counts = cut_lineage(counts, "lengths")
    histogram = {r.length: r.many for r in counts.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    where = slots(plan(histogram, room))
    before = F.sum("many").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    kept = [f for f in pieces.schema.names if f not in ("part", "place")]
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("place") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.int64(1) << np.int64(48)
        keys = where["length"] * reach + where["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = np.searchsorted(keys, length * reach + rank, "right") - 1
            sequence, copy = np.divmod(rank - where["first"][slot], where["times"][slot])
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(where["sequence"][slot] + sequence), pa.array(where["offset"][slot] + copy * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept)
    return ranked.select(*kept, "rank").mapInArrow(run, schema + ", sequence_id long, offset long")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of pieces that were cut ``with_ids``, joined in order; bounded by the room."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 2048, close: int = 0) -> DataFrame:
    return best_fit(cut_pieces(docs, tokenizer, room, close), room)
