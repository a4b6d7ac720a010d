"""Two tokenizers side by side: which tokens of one cover which tokens of the other, and how usual that is.

Both tokenizations of a text cover the same bytes. Where a token of A and a token of B end at the same byte, a group
ends: tokens of one group are linked with each other, and no others. The ends of A and of B are two sorted lists,
and their merge is divided on diagonals: a binary search on each finds how many ends of A and of B lie before it, so
every piece merges equally many ends on its own. A piece emits its finished groups and what is left open at its end;
the open part is stitched to what the next pieces begin with.

A slice of texts is merged at once, so the work of a task does not depend on how long its texts are. Links are not
enumerated: a group of a times b tokens counts as such, and only its distinct ids are paired. Each slice is written once,
with its texts' distinct pairs as numbers into the slice's own list of pairs; the number of documents that hold a pair
is a sum over those lists, and comes back by slice. So a pair occurs once in a slice, however frequent it is.

Defined results: texts that are null or empty, or that a tokenizer does not give back byte for byte, have no tokens.
Rows with equal ids are documents of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..settings import cut_lineage
from .encoding import BYTE_LETTERS
from .words import text_slices

#: Bytes of text merged at once, and ends merged by one piece.
ALIGNED_BYTES = 4 << 20
PIECE = 1 << 16
#: Fixed value: the public pre-token pattern of byte-level tokenizers of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteTokens:
    """Ids of a byte-level vocabulary. ``spelled[i]`` are the bytes of token i."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        value = {letter: byte for byte, letter in enumerate(BYTE_LETTERS)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(value[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # Ids of such a vocabulary ascend with the merges, so they are the ranks that merging needs.
        self.encoding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spelled = _table({i: token for token, i in ranks.items()})

    @cached_property
    def library(self) -> Tokenizer:
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        return tokenizer

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            try:
                ids = self.encoding.encode_ordinary(" " + text)
            except (ValueError, OverflowError, RuntimeError):  # the pattern gives up on some very long runs
                ids = self.library.encode(" " + text, add_special_tokens=False).ids
            out.append(np.array(ids, np.int64))
        return out


class PieceTokens:
    """Ids of a sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            tokens[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
        self.spelled = _table(tokens)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


def _table(tokens: dict[int, bytes]) -> pa.Array:
    return pa.array([tokens.get(i, b"") for i in range(max(tokens) + 1)], pa.large_binary())


def _spell(ids: np.ndarray, spelled: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The joined bytes of entries and the offset at which each ends."""
    taken = spelled.take(pa.array(ids))
    return memoryview(taken.buffers()[2] or b"").cast("B"), np.frombuffer(taken.buffers()[1], np.int64)[1 : len(ids) + 1]


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of ``piece`` ends of the merge of a and b begin, as numbers of ends of a and of b.

    All diagonals are searched at once. Equal ends stay in one piece.
    """
    total = len(a) + len(b)
    d = np.arange(0, total + piece, piece).clip(max=total)
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        active = low < high
        first = active & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(d - middle - 1, 0, len(b) - 1)])
        low = np.where(first, middle + 1, low)
        high = np.where(active & ~first, middle, high)
    i, j = low, d - low
    if len(a) and len(b):
        split = (i > 0) & (j < len(b)) & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)])
        j = j + split
    return i, j


@dataclass
class Groups:
    """Group g has the next ``a[g]`` tokens of A and ``b[g]`` tokens of B."""

    a: np.ndarray
    b: np.ndarray


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end in a piece, as numbers of its ends of a and of b, with the piece's own end last."""
    at = np.searchsorted(b, a)
    both = np.zeros(len(a), bool)
    inside = at < len(b)
    both[inside] = b[at[inside]] == a[inside]
    i = np.nonzero(both)[0] + 1
    return np.append(i, len(a)), np.append(at[both] + 1, len(b))


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> Groups:
    """Groups of tokens from their ends (ascending, with the same last one)."""
    i, j = diagonals(a, b, piece)
    in_a, in_b, open_a, open_b = [], [], 0, 0
    for i0, i1, j0, j1 in zip(i.tolist(), i[1:].tolist(), j.tolist(), j[1:].tolist()):
        ends_a, ends_b = merge_piece(a[i0:i1], b[j0:j1])
        sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        # Stitch: what earlier pieces left open belongs to the first group here, and the last part stays open.
        sizes_a[0] += open_a
        sizes_b[0] += open_b
        open_a, open_b = int(sizes_a[-1]), int(sizes_b[-1])
        in_a.append(sizes_a[:-1])
        in_b.append(sizes_b[:-1])
    none = [np.zeros(0, np.int64)]
    return Groups(np.concatenate(in_a or none), np.concatenate(in_b or none))


def number_table(most: int) -> pa.Array:
    """The decimal numbers under ``most``, followed by a comma, then all by a bar, then all by a semicolon."""
    return pa.array([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(most)], pa.large_binary())


def spelled_groups(ids_a: np.ndarray, ids_b: np.ndarray, groups: Groups, numbers: pa.Array) -> tuple[memoryview, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups in a row, and where each group ends in it."""
    most, both = len(numbers) // 3, groups.a + groups.b
    last = np.cumsum(both)
    entry = np.empty(int(last[-1]) if len(last) else 0, np.int64)
    for ids, sizes, front, mark in ((ids_a, groups.a, last - both, 1), (ids_b, groups.b, last - groups.b, 2)):
        ends = np.cumsum(sizes)
        shown = ids.copy()
        shown[ends - 1] += mark * most
        entry[np.arange(len(ids)) + np.repeat(front - (ends - sizes), sizes)] = shown
    letters, ends = _spell(entry, numbers)
    return letters, ends[last - 1]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    first = np.nonzero(np.diff(keys, prepend=-1))[0]
    return keys[first], np.diff(first, append=len(keys))


def linked_pairs(ids_a: np.ndarray, ids_b: np.ndarray, groups: Groups, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, links) of each row's distinct id pairs; pair is A's id times 2**20, plus B's. ``row`` is each group's."""
    wide = np.int64(1) << np.int64(_SHIFT)
    of_a, of_b = np.repeat(np.arange(len(groups.a)), groups.a), np.repeat(np.arange(len(groups.b)), groups.b)
    key_a, many_a = _counted(of_a * wide + ids_a)
    key_b, many_b = _counted(of_b * wide + ids_b)
    group_a, group_b = key_a // wide, key_b // wide
    first_b = np.searchsorted(group_b, np.arange(len(groups.b) + 1))
    partners = (first_b[1:] - first_b[:-1])[group_a]
    left = np.repeat(np.arange(len(key_a)), partners)
    right = np.arange(len(left)) - np.repeat(np.cumsum(partners) - partners, partners) + first_b[group_a][left]
    pair = (key_a[left] % wide) * wide + key_b[right] % wide
    links = many_a[left] * many_b[right]
    owner = row[group_a[left]]
    order = np.lexsort((pair, owner))
    pair, owner, links = pair[order], owner[order], links[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
    first = np.nonzero(new)[0]
    return owner[first], pair[first], np.add.reduceat(links, first) if len(first) else links[:0]


_SHIFT = 20
_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_WRITTEN = f"slice long, {_DOCS}, pairs array<int>, links array<long>, a array<int>, b array<int>, docs array<int>"


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, spans: bool = False) -> DataFrame:
    """One row per text: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs as numbers into
    the pairs of its slice, with links; and one row per slice (doc_id and n_a null) with those pairs and in how many
    of the slice's texts each is. To be written once: a slice's number comes from the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ByteTokens(tokenizer_a), PieceTokens(tokenizer_b)
        numbers = number_table(max(len(one.spelled), len(two.spelled)))
        number = np.int64(TaskContext.get().partitionId()) << np.int64(32)
        for batch in text_slices(batches, "text", ALIGNED_BYTES):
            yield _slice_rows(batch, one, two, numbers, int(number))
            number += 1
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _WRITTEN)


def _same(tokens: list[np.ndarray], spelled: pa.Array, plain: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which texts their tokens give back byte for byte, and the offsets in the text at which tokens end."""
    sizes = np.cumsum([len(x) for x in tokens])
    letters, ends = _spell(np.concatenate(tokens) if tokens else np.zeros(0, np.int64), spelled)
    own = np.split(ends, sizes[:-1]) if tokens else []
    same, done = np.zeros(len(plain), bool), 0
    for k, text in enumerate(plain):
        stop = int(own[k][-1]) if len(own[k]) else done
        same[k] = letters[done:stop] == text
        own[k], done = own[k] - done, stop
    return same, own


def _slice_rows(batch: pa.RecordBatch, one: ByteTokens, two: PieceTokens, numbers: pa.Array, number: int) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    rows = [r for r, text in enumerate(texts) if text]
    said = [texts[r] for r in rows]
    plain = [b" " + text.encode() for text in said]
    ids_a, ids_b = one.ids(said), two.ids(said)
    (same_a, ends_a), (same_b, ends_b) = _same(ids_a, one.spelled, plain), _same(ids_b, two.spelled, plain)
    good = np.nonzero(same_a & same_b)[0].tolist()
    kept = [rows[k] for k in good]
    before = np.cumsum([0, *(len(plain[k]) for k in good)])
    ids_a, ids_b = [ids_a[k] for k in good], [ids_b[k] for k in good]
    ends_a, ends_b = ([ends[k] + d for k, d in zip(good, before)] for ends in (ends_a, ends_b))
    del plain, said
    n = len(texts)
    counts = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    digests = [""] * n
    none = np.zeros(0, np.int64)
    owner = pair = links = none
    if kept:
        flat_a, flat_b = np.concatenate(ids_a), np.concatenate(ids_b)
        groups = align(np.concatenate(ends_a), np.concatenate(ends_b))
        size_a, size_b = [len(x) for x in ids_a], [len(x) for x in ids_b]
        # Every text ends with an end of both, so no group crosses texts.
        last = np.searchsorted(np.cumsum(groups.a), np.cumsum(size_a)) + 1
        per_text = np.diff(last, prepend=0)
        row = np.repeat(np.array(kept), per_text)
        counts["n_a"][kept], counts["n_b"][kept], counts["n_groups"][kept] = size_a, size_b, per_text
        counts["n_links"] = np.bincount(row, weights=groups.a * groups.b, minlength=n).astype(np.int64)
        letters, ends = spelled_groups(flat_a, flat_b, groups, numbers)
        start = 0
        for r, stop in zip(kept, ends[last - 1].tolist()):
            digests[r] = hashlib.sha256(letters[start : stop - 1]).hexdigest()  # without the last semicolon
            start = stop
        owner, pair, links = linked_pairs(flat_a, flat_b, groups, row)
    distinct, where = np.unique(pair, return_inverse=True)
    in_texts = np.bincount(where, minlength=len(distinct))
    bounds = np.searchsorted(owner, np.arange(n + 1))
    wide = np.int64(1) << np.int64(_SHIFT)
    columns = [pa.array(np.full(n + 1, number))]
    columns.append(pa.concat_arrays([batch.column("doc_id"), pa.nulls(1, pa.int64())]))
    columns += [pa.concat_arrays([pa.array(c), pa.nulls(1, pa.int64())]) for c in counts.values()]
    columns.append(pa.array([*digests, None], pa.string()))
    columns.append(_lists(where, np.append(bounds, bounds[-1]), pa.int32()))
    columns.append(_lists(links, np.append(bounds, bounds[-1]), pa.int64()))
    of_slice = np.append(np.zeros(n + 1, np.int64), len(distinct))
    columns += [_lists(x, of_slice, pa.int32()) for x in (distinct // wide, distinct % wide, in_texts)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


_ARROW = pa.schema(
    [("slice", pa.int64()), *((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
     ("pairs", pa.list_(pa.int32())), ("links", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("a", "b", "docs"))]
)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(slice, place, a, b, docs) of all slices' pairs from ``aligned`` rows."""
    of_slice = rows.filter("n_a is null").select("slice", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "pair"))
    return of_slice.select("slice", "place", "pair.a", "pair.b", "pair.docs")


def cross_aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """Per text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    An id pair's count is the number of texts of the corpus in which it is linked; a link is best if its count is the
    highest that its A id has.
    """
    rows = cut_lineage(aligned(docs, tokenizer_a, tokenizer_b), "aligned")
    pairs = pair_counts(rows)
    counted = cut_lineage(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "pair-counts")
    highest = counted.groupBy("a").agg(F.max("count").alias("most"))
    judged = counted.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    back = pairs.join(judged, ["a", "b"]).select(F.col("slice").alias("in_slice"), "place", "count", "best")

    def add_up(texts: pa.Table, known: pa.Table) -> pa.Table:
        place = known.column("place").to_numpy()
        lists = texts.column("pairs").combine_chunks()
        at, many = (texts.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "links"))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        out = texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        for name, column in (("n_best", "best"), ("count_sum", "count")):
            value = np.zeros(len(place), np.int64)
            value[place] = known.column(column).to_numpy()
            upto = np.concatenate([[0], np.cumsum(many * value[at])])[bounds - bounds[0]]
            out = out.append_column(name, pa.array(np.diff(upto)))
        return out.append_column("groups_sha256", texts.column("groups_sha256"))

    texts = rows.filter("n_a is not null").select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("slice").cogroup(back.groupBy("in_slice")).applyInArrow(add_up, schema)
