"""Plain forms of the operators, for small inputs."""

import functools
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from conftest import SF

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


@functools.cache
def document_rows():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


def repeated_bytes(documents, length):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256); documents in the order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in documents:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = True
            seen.add(window)
        gone = gone[: len(data)]
        starts = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[doc_id] = (len(data), int(gone.sum()), int(starts.sum()), hashlib.sha256(kept).hexdigest())
    return out


def packed_well(got, documents, room=2048):
    """Pieces are those of the tokenizers library, lie gapless, and need hardly more sequences than their tokens."""
    pieces = {(r.doc_id, r.piece): r for r in got.itertuples()}
    assert len(pieces) == len(got)
    made = 0
    for doc_id, text in documents:
        ids = [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), room)):
            own, row = ids[start : start + room], pieces[doc_id, k]
            assert (row.start, row.length, row.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
            made += 1
    assert made == len(got)
    ordered = got.sort_values(["sequence_id", "offset"])
    used = ordered.groupby("sequence_id")["length"].sum()
    assert (ordered["offset"] == ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"]).all()
    assert used.max() <= room
    assert len(used) <= 1.02 * got["length"].sum() / room + 2


def shingles(text, width=5):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split(" ")
    words = [w for part in words for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", part)]
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))}


def near_components(documents, percent=75):
    """doc_id -> (n_shingles, component_id) from all pairs."""
    sets = [(i, shingles(t)) for i, t in documents]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (len(s), root(i)) for i, s in sets}
