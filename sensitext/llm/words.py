"""Whole texts cut into words in Arrow and numpy: the shared inner step of the operators over documents.

A word is a maximal run of bytes other than space and the controls 0x09 to 0x0D. Texts come in slices
of a bounded number of bytes, so memory does not depend on how many rows an Arrow batch holds; one text
is never cut. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices with at most ``most`` bytes in ``column`` (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        row = 0
        while row < batch.num_rows:
            done = ends[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(row, end - row)
            row = end


def plain(texts: pa.Array) -> pa.Array:
    """A string array without nulls that starts at the front of its buffers."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    return pa.concat_arrays([texts]) if texts.offset else texts


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and each text's first byte with one end after the last."""
    texts = plain(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """``ids[bounds[i]:bounds[i + 1]]`` are the words of text i, numbers into ``vocabulary``."""

    ids: np.ndarray
    bounds: np.ndarray
    vocabulary: pa.Array

    def rows(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split_words(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(plain(texts))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py() if len(coded.dictionary) else -1
    if empty >= 0:  # white space at an end gives an empty part
        real = ids != empty
        kept = np.concatenate([[0], np.cumsum(real)])
        ids, bounds = ids[real], kept[bounds - bounds[0]]
    else:
        bounds = bounds - bounds[0]
    return Words(ids, bounds, coded.dictionary)


def extended_schema(schema: T.StructType, added: list[T.StructField]) -> T.StructType:
    """The schema with ``added`` at its end; columns of the same name (in any case) are replaced."""
    names = {f.name.lower() for f in added}
    return T.StructType([*(f for f in schema.fields if f.name.lower() not in names), *added])


def extended_batch(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    names = {n.lower() for n in added}
    kept = [n for n in batch.schema.names if n.lower() not in names]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *added.values()], names=[*kept, *added])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
