"""Removal of repeated passages by suffix arrays, with threshold-bounded interval expansion.

Every byte that lies in a string of ``length`` bytes that also starts earlier (in a smaller doc_id, or earlier in
the same document) is removed; all strings are judged on the input.

A suffix array over a whole corpus cannot be split, so strings that may be equal are first brought together:

1. Every window of ``length`` bytes has an anchor, the leftmost smallest-hash ``gram`` bytes in it. Equal windows
   have equal anchors at equal places. Neighbouring windows share theirs, so there is one row per some 40 bytes.
2. Rows with the same anchor meet by its hash. Where all their windows are the same bytes, those after the first
   are repeated. Copies within an Arrow batch are settled before the shuffle, so a passage that a third of the
   corpus holds sends one row per batch.
3. What is left, different surroundings of one anchor, are the ends of shared passages. Their bytes are fetched,
   dealt out by anchor and by what stands beside it (any shared window has the half before or the half after the
   anchor in common), and compared in blocks of whole groups: the block's suffix array gives its Burrows-Wheeler
   transform, and breadth-first backward extension of intervals yields the common prefixes of neighbouring
   suffixes by increasing value. It stops at ``length``: boundaries without a value by then separate nothing, and
   the runs between the others are the equal strings.
4. A group above ``block`` bytes (the ends of one passage that very many documents hold) gets no suffix array: its
   windows are dealt out by a 128-bit hash of their bytes, after those that repeat an earlier one of their own batch
   are settled, and the first of each hash stays.

Defined results: null texts count as empty; rows without doc_id are not compared and keep every byte; of rows with
equal doc_id neither is earlier than the other at the same place; extra columns pass through ``remove_repeated``, and
those with the name of a result are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import cut_lineage
from .words import extended_batch, extended_schema, mix, text_bytes, text_slices

_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = [int(x) | 1 for x in mix(np.arange(1000, 1008, dtype=np.uint64))]
_END = 0xFF  # never a byte of UTF-8


@dataclass(frozen=True)
class Passages:
    """``length`` bytes must be repeated; anchors have ``gram`` bytes; ``block`` bytes share a suffix array, and
    groups of more bytes get none."""

    length: int = 100
    gram: int = 24
    block: int = 2 << 20

    @property
    def bits(self) -> int:
        return int(self.length).bit_length()


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at each position that has so many, by doubling."""
    power, size, found, done = _SPREAD[text], 1, None, 0
    for k, odd in enumerate(_ODD):
        if gram >> k & 1:
            if found is None:
                found = power
            else:
                n = max(min(len(found), len(power) - done), 0)
                found = found[:n] * np.uint64(_ODD[k - 1] ^ 2) + power[done : done + n]
            done += size
        if done == gram:
            break
        n = max(len(power) - size, 0)
        power = power[:n] * np.uint64(odd) + power[size : size + n]
        size *= 2
    return mix(found[: max(len(text) - gram + 1, 0)])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    low, size = keys, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[width - size : width - size + n])


def anchors(text: np.ndarray, bounds: np.ndarray, p: Passages) -> dict[str, np.ndarray]:
    """Maximal runs of windows of one text with one anchor.

    row: the text; start: first window, from the text's front; more: windows after the first; before: from the first
    window to the anchor; gram: the anchor's hash; whole: a hash of all bytes of the windows."""
    names = ("row", "start", "more", "before", "gram", "whole")
    n = len(text) - p.length + 1
    if n <= 0:
        return {k: np.zeros(0, np.uint64 if k in ("gram", "whole") else np.int64) for k in names}
    hashes = gram_hashes(text, p.gram)
    keys = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    low = window_minima(keys, p.length - p.gram + 1)
    new = np.ones(n, bool)
    new[1:] = low[1:] != low[:-1]
    inside = np.zeros(n, bool)
    for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - first >= p.length:
            inside[first : end - p.length + 1] = True
            new[first] = True
            if end - p.length + 1 < n:
                new[end - p.length + 1] = True
    first = np.nonzero(new)[0]
    last = np.append(first[1:], n) - 1
    real = inside[first]
    first, last = first[real], last[real]
    at = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    powers = np.multiply.accumulate(np.full(len(text) + 1, np.uint64(_ODD[7]), np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_SPREAD[text] * powers[:-1], dtype=np.uint64)])
    inverse = pow(_ODD[7], -1, 2**64)
    back = np.multiply.accumulate(np.full(len(text) + 1, np.uint64(inverse), np.uint64))
    whole = (sums[last + p.length] - sums[first]) * back[first]
    row = np.searchsorted(bounds, first, "right") - 1
    return {
        "row": row, "start": first - bounds[row], "more": last - first, "before": at - first,
        "gram": hashes[at], "whole": mix(whole + (last - first).astype(np.uint64)),
    }


def _after_first(order: np.ndarray, new: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted groups (by doc and start within a group): which rows are at the group's first place, which later."""
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    first = (doc[order] == doc[order][head]) & (start[order] == start[order][head])
    return first, ~first


_ROWS = "gram long, form long, doc_id long, place long"
_GONE = "doc_id long, tag long, start long, end long"


def _scan(docs: DataFrame, p: Passages) -> DataFrame:
    """Anchor rows; those that repeat an earlier text of their own batch are settled and have a place under 0.

    form packs the hash of all bytes, the anchor's distance and the number of windows; place the start and a
    32-bit tag of the text, which tells apart texts with one doc_id."""
    b = p.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for part in text_slices(iter([batch]), "text", 1 << 20):
                text, bounds = text_bytes(part.column("text"))
                found = anchors(text, bounds, p)
                doc = part.column("doc_id").to_numpy()[found["row"]]
                tag = part.column("tag").to_numpy()[found["row"]].astype(np.int64)
                form = (found["whole"] >> np.uint64(2 * b)).astype(np.int64) << (2 * b) | found["before"] << b | found["more"]
                parts.append((found["gram"].view(np.int64), form, doc, found["start"] << 32 | tag))
            if not parts:
                continue
            gram, form, doc, place = map(np.concatenate, zip(*parts))
            order = np.lexsort((place, doc, form, gram))
            new = np.ones(len(order), bool)
            new[1:] = (gram[order][1:] != gram[order][:-1]) | (form[order][1:] != form[order][:-1])
            first, later = _after_first(order, new, doc, place >> 32)
            place = place.copy()
            settled = order[later]
            place[settled] = ~place[settled]
            gram[settled] = mix((doc[settled] ^ place[settled]).view(np.uint64)).view(np.int64)  # they go anywhere
            yield pa.RecordBatch.from_arrays([*map(pa.array, (gram, form, doc, place))], names=["gram", "form", "doc_id", "place"])

    return docs.filter(F.length("text") > 0).filter("doc_id is not null").mapInArrow(run, _ROWS)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` again, in tables of at least ``least`` bytes that cut no group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < least:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left")) if (np.diff(keys) >= 0).all() else 0
        if cut == 0:
            continue
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        held = [batch.slice(cut)]
        size = held[0].nbytes
    if held:
        yield pa.Table.from_batches(held)


def _meet(rows: DataFrame, p: Passages) -> DataFrame:
    """Of rows with one anchor: later rows with the same bytes (gram null), and first rows with different bytes.

    hot marks the latter where the windows of their anchor have more than ``block`` bytes."""
    low = (1 << p.bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "gram", 8 << 20):
            gram, form, doc, place = (table.column(c).to_numpy() for c in ("gram", "form", "doc_id", "place"))
            settled, open_ = np.nonzero(place < 0)[0], np.nonzero(place >= 0)[0]
            done = [form[settled], doc[settled], ~place[settled]]
            order = open_[np.lexsort((place[open_], doc[open_], form[open_], gram[open_]))]
            gram, form, doc, place = gram[order], form[order], doc[order], place[order]
            new_gram = np.append(True, gram[1:] != gram[:-1])[: len(gram)]  # a table may hold settled rows only
            new = new_gram | np.append(True, form[1:] != form[:-1])[: len(gram)]
            first, later = _after_first(np.arange(len(gram)), new, doc, place >> 32)
            group = np.cumsum(new_gram) - 1
            several = (np.bincount(group, weights=new) > 1)[group]
            tied = np.append(False, (place[1:] == place[:-1]) & ~new[1:] & (doc[1:] == doc[:-1]))[: len(gram)]
            ends = first & several & ~tied
            hot = (np.bincount(group, weights=ends * ((form & low) + p.length)) > p.block)[group]
            out = np.nonzero(later | ends)[0]
            grams = np.concatenate([gram[out], np.zeros(len(settled), np.int64)])
            known = np.concatenate([later[out], np.ones(len(settled), bool)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams, mask=known), *(pa.array(np.concatenate([x[out], y])) for x, y in zip((form, doc, place), done)),
                    pa.array(np.concatenate([hot[out] & ends[out], np.zeros(len(settled), bool)])),
                ],
                names=["gram", "form", "doc_id", "place", "hot"],
            )

    met = rows.repartition("gram").sortWithinPartitions("gram")
    return met.mapInArrow(run, f"{_ROWS}, hot boolean")


_SIDES = "key long, doc_id long, tag long, start long, bytes binary, hot boolean"


def _surroundings(docs: DataFrame, ends: DataFrame, p: Passages) -> DataFrame:
    """The bytes of the windows of ``ends``, once for windows that hold the half before the anchor, once for the rest."""
    half = (p.length - p.gram) // 2
    b, low = p.bits, (1 << p.bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1 << 20):
            keys, rows, starts, bytes_, hot = [], [], [], [], []
            texts, lists = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("ends").to_pylist()
            for row, (text, own) in enumerate(zip(texts, lists)):
                for end in own:
                    first, before, more = end["place"] >> 32, end["form"] >> b & low, end["form"] & low
                    at = first + before
                    turn = min(max(at - half - first + 1, 0), more + 1)  # windows that hold the half before
                    for side, s, e in ((0, first, first + turn), (1, first + turn, first + more + 1)):
                        if s >= e:
                            continue
                        beside = text[at - half : at] if side == 0 else text[at + p.gram : at + p.gram + p.length - p.gram - half]
                        digest = hashlib.blake2b(beside, digest_size=8, key=end["gram"].to_bytes(8, "little", signed=True), salt=bytes([side]))
                        keys.append(int.from_bytes(digest.digest(), "little", signed=True))
                        rows.append(row)
                        starts.append(s)
                        bytes_.append(text[s : e - 1 + p.length])
                        hot.append(end["hot"])
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column("doc_id").take(rows), batch.column("tag").take(rows), pa.array(starts, pa.int64()), pa.array(bytes_, pa.binary()), pa.array(hot, pa.bool_())],
                names=["key", "doc_id", "tag", "start", "bytes", "hot"],
            )

    own = ends.withColumn("tag", F.expr("place & 4294967295")).groupBy("doc_id", "tag")
    lists = own.agg(F.collect_list(F.struct("gram", "form", "place", "hot")).alias("ends"))
    return docs.join(lists, ["doc_id", "tag"]).mapInArrow(run, _SIDES)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by at least their next ``depth`` bytes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    keys = np.zeros(n, np.uint64)
    for k in range(8):
        keys = keys << np.uint64(8) | padded[k : k + n]
    size = 8
    while True:
        order = np.argsort(keys)
        done = keys[order]
        new = np.append(True, done[1:] != done[:-1])
        if size >= depth or new.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        after = np.zeros(n, np.uint64)
        step = min(size, depth - size)
        after[: n - step] = rank[step:]
        keys = rank << np.uint64(32) | after
        size += step


def common_prefix_boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix array: whether its suffix shares fewer than ``length`` bytes with the one before.

    Breadth-first backward extension on the Burrows-Wheeler transform: level l holds intervals of suffixes that
    start with a common string of l bytes. Extending an interval to the left by each byte before its suffixes gives
    intervals of l + 1 bytes; the boundary after such an interval, if it has no value yet, separates suffixes with
    exactly l common bytes. Only intervals that set a boundary are extended again."""
    n = len(text)
    here, before = text[order], text[order - 1]  # the first suffix is preceded by the last byte, as if the text were a ring
    to = np.empty(n, np.int64)
    to[np.argsort(before, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    left, right = np.zeros(1, np.int64), np.full(1, n)
    mark = np.zeros(n, np.int32)
    for _ in range(length):
        sizes = right - left
        inside = np.repeat(left - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        moved, interval = to[inside], np.repeat(np.arange(1, len(left) + 1, dtype=np.int32), sizes)
        if len(moved) > n // 16:  # in order of place: by scattering many, by sorting few
            mark[moved] = interval
            moved = np.nonzero(mark)[0]
            interval = mark[moved]
            mark[moved] = 0
        else:
            by_place = np.argsort(moved)
            moved, interval = moved[by_place], interval[by_place]
        byte = here[moved]
        new = np.ones(len(moved), bool)
        new[1:] = (interval[1:] != interval[:-1]) | (byte[1:] != byte[:-1])
        first = np.nonzero(new)[0]
        left = moved[first]
        right = moved[np.append(first[1:], len(moved)) - 1] + 1
        fresh = ~known[right]
        known[right[fresh]] = True
        left, right = left[fresh], right[fresh]
        if not len(left):
            break
    return known[:n]


def repeated_windows(parts: list[bytes], length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each window of each part the first place of the same bytes in the joined text, and where the parts start."""
    sizes = np.array([len(x) for x in parts], np.int64)
    text = np.frombuffer(bytes([_END]).join(parts) + bytes([_END]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    order = suffix_array(text, length)
    run = np.cumsum(common_prefix_boundaries(text, order, length)) - 1
    least = np.full(run[-1] + 1 if len(run) else 0, len(text))
    np.minimum.at(least, run, order)
    first = np.empty(len(text), np.int64)
    first[order] = least[run]
    return [first[s : s + max(z - length + 1, 0)] for s, z in zip(starts.tolist(), sizes.tolist())], starts


def _compare(sides: DataFrame, p: Passages) -> DataFrame:
    """Stretches of later windows among the surroundings of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "key", p.block):
            key, doc, start = (table.column(c).to_numpy() for c in ("key", "doc_id", "start"))
            order = np.lexsort((start, doc, key))
            new = np.append(True, key[order][1:] != key[order][:-1])
            group = np.cumsum(new) - 1
            order = order[(np.bincount(group) > 1)[group]]  # alone, there is nothing to compare with
            if not len(order):
                continue
            order = order[np.lexsort((start[order], doc[order]))]  # so the first place of a class is the earliest one
            kept = table.take(pa.array(order))
            firsts, starts = repeated_windows(kept.column("bytes").to_pylist(), p.length)
            doc, start = doc[order], start[order]
            counts = np.array([len(x) for x in firsts])
            part = np.repeat(np.arange(len(order)), counts)
            within = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = np.concatenate(firsts)
            other = np.searchsorted(starts, first, "right") - 1
            earliest = start[other] + first - starts[other]
            later = (doc[other] < doc[part]) | (doc[other] == doc[part]) & (earliest < start[part] + within)
            change = np.append(True, (later[1:] != later[:-1]) | (part[1:] != part[:-1]))
            opened = np.nonzero(change)[0]
            closed = np.append(opened[1:], len(later)) - 1
            opened, closed = opened[later[opened]], closed[later[opened]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[part[opened]]), pa.array(kept.column("tag").to_numpy()[part[opened]]),
                    pa.array(start[part[opened]] + within[opened]), pa.array(start[part[closed]] + within[closed] + p.length),
                ],
                names=["doc_id", "tag", "start", "end"],
            )

    return sides.drop("hot").repartition("key").sortWithinPartitions("key").mapInArrow(run, _GONE)


_WINDOWS = "high long, low long, doc_id long, place long, end long"


def _windows(sides: DataFrame, p: Passages) -> DataFrame:
    """The windows of ``sides`` with a 128-bit hash of their bytes; those that repeat an earlier one of their own batch
    are settled: joined to stretches, which have an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2500) for b in batches for at in range(0, b.num_rows, 2500)):
            digests, counts = bytearray(), []
            for bytes_ in batch.column("bytes").to_pylist():
                counts.append(len(bytes_) - p.length + 1)
                for s in range(counts[-1]):
                    digests += hashlib.blake2b(bytes_[s : s + p.length], digest_size=16).digest()
            high, low = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2).T
            counts = np.array(counts)
            part = np.repeat(np.arange(len(counts)), counts)
            within = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
            doc = batch.column("doc_id").to_numpy()[part]
            place = batch.column("start").to_numpy()[part] + within << 32 | batch.column("tag").to_numpy()[part].astype(np.int64)
            order = np.lexsort((place, doc, low, high))
            new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))
            first, later = _after_first(order, new, doc, place >> 32)
            open_, settled = order[first], np.sort(order[later])
            opened = np.append(True, (part[settled][1:] != part[settled][:-1]) | (np.diff(settled) != 1))[: len(settled)]
            closed = np.append(opened[1:], True)[: len(settled)]
            end = (place[settled[closed]] >> 32) + p.length
            settled = settled[opened]
            anywhere = mix((doc[settled] ^ place[settled]).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([high[open_], anywhere])), pa.array(np.concatenate([low[open_], anywhere])),
                    pa.array(np.concatenate([doc[open_], doc[settled]])), pa.array(np.concatenate([place[open_], place[settled]])),
                    pa.array(np.concatenate([np.zeros(len(open_), np.int64), end])),
                ],
                names=["high", "low", "doc_id", "place", "end"],
            )

    return sides.select("doc_id", "tag", "start", "bytes").mapInArrow(run, _WINDOWS)


def _later_windows(windows: DataFrame, p: Passages) -> DataFrame:
    """Stretches of windows after the first of their hash; a group passes by in order and is never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = [np.zeros(0, np.int64)] * 4  # the first place of the group that the last batch ended in
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("high", "low", "doc_id", "place", "end")]
            done = columns[4] > 0
            high, low, doc, place = (np.concatenate([h, x[~done]]) for h, x in zip(head, columns))
            new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(high)]
            _, later = _after_first(np.arange(len(high)), new, doc, place >> 32)
            if len(high):
                at = int(np.nonzero(new)[0][-1])
                head = [x[at : at + 1] for x in (high, low, doc, place)]
            doc, place = (np.concatenate([x, y[done]]) for x, y in ((doc[later], columns[2]), (place[later], columns[3])))
            end = np.concatenate([(place[: later.sum()] >> 32) + p.length, columns[4][done]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(place & 0xFFFFFFFF), pa.array(place >> 32), pa.array(end)],
                names=["doc_id", "tag", "start", "end"],
            )

    return windows.repartition("high", "low").sortWithinPartitions("high", "low", "doc_id", "place").mapInArrow(run, _GONE)


def _tag(text: str) -> F.Column:
    return F.expr(f"pmod(xxhash64(`{text}`), 4294967296)")


def repeated_stretches(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """(doc_id, tag, start, end): stretches of bytes to remove; they may overlap. ``tag`` is a 32-bit hash of the text."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("tag", _tag("text"))
    met = cut_lineage(_meet(_scan(texts, p), p), "anchors")
    gone = met.filter("gram is null")
    mask = (1 << p.bits) - 1
    gone = gone.select(
        "doc_id", F.expr("place & 4294967295").alias("tag"), F.expr("shiftright(place, 32)").alias("start"),
        F.expr(f"shiftright(place, 32) + (form & {mask}) + {p.length}").alias("end"),
    )
    sides = _surroundings(texts, met.filter("gram is not null"), p)
    if met.filter("hot").isEmpty():
        return gone.union(_compare(sides, p))
    sides = cut_lineage(sides, "sides")
    big = sides.filter("hot").groupBy("key").agg(F.sum(F.length("bytes")).alias("size")).filter(F.col("size") > p.block)
    big = cut_lineage(big.select("key"), "big-groups")
    gone = gone.union(_compare(sides.join(big, "key", "left_anti"), p))
    return gone.union(_later_windows(_windows(sides.join(big, "key", "left_semi"), p), p))


def _kept(text: bytes, stretches: list) -> tuple[int, int, list[tuple[int, int]]]:
    """Bytes removed, maximal removed runs, and the stretches that stay."""
    stay, gone, runs, at, end = [], 0, 0, 0, -1
    for s, e in sorted((x["start"], x["end"]) for x in stretches or []):
        if s > end:
            runs += 1
            if s > at:
                stay.append((at, s))
            gone += e - s
        elif e > end:
            gone += e - end
        end = at = max(end, e)
    if at < len(text):
        stay.append((at, len(text)))
    return gone, runs, stay


def _characters(text: bytes, s: int, e: int) -> bytes:
    """The stretch without bytes of characters that its ends cut."""
    while s < e and text[s] & 0xC0 == 0x80:
        s += 1
    cut = e
    while cut < len(text) and cut > s and text[cut] & 0xC0 == 0x80:
        cut -= 1
    return text[s:cut]


def remove_repeated(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """All columns of ``docs`` with the text that is left, and columns n_bytes, n_removed, n_spans, kept_sha256.

    kept_sha256 is of the remaining bytes. In the text, a character of which only some bytes are left goes too."""
    found = repeated_stretches(docs, p).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("stretches"))
    # Names that no column of the input has.
    ident, tag, lists = (f"{c}{'_' * max(map(len, docs.columns))}" for c in ("id", "tag", "stretches"))
    found = found.select(F.col("doc_id").alias(ident + "2"), F.col("tag").alias(tag + "2"), F.col("stretches").alias(lists))
    own = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(ident, F.col("doc_id").cast("long")).withColumn(tag, _tag("text"))
    joined = own.join(found, (F.col(ident) == F.col(ident + "2")) & (F.col(tag) == F.col(tag + "2")), "left")
    joined = joined.select(*[f"`{c}`" for c in docs.columns], lists)
    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            left, counts, digests = [], [], []
            texts, gaps = batch.column("text").cast(pa.binary()).to_pylist(), batch.column(lists).to_pylist()
            for text, own in zip(texts, gaps):
                gone, runs, stay = _kept(text, own)
                digests.append(hashlib.sha256(b"".join(text[s:e] for s, e in stay)).hexdigest())
                left.append(b"".join(_characters(text, s, e) for s, e in stay).decode("utf-8") if runs else text.decode("utf-8"))
                counts.append((len(text), gone, runs))
            added = dict(zip(("n_bytes", "n_removed", "n_spans"), (pa.array(c, pa.int64()) for c in zip(*counts))))
            added["kept_sha256"] = pa.array(digests, pa.string())
            batch = batch.drop_columns([lists]).set_column(at, "text", pa.array(left, pa.string()))
            yield extended_batch(batch, added)

    schema = docs.schema
    at = [n.lower() for n in schema.names].index("text")
    return joined.mapInArrow(run, extended_schema(schema, fields))
