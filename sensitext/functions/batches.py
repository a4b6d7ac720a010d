"""The scan and the numbering of ``spans.py`` over whole Arrow batches: for texts in which most rules match.

Gates spare a text without matches nearly everything, but where most rules match, the cost is in the Java matcher and
in lambdas, which Spark interprets step by step for every element. Here a rule runs over a batch of texts in Arrow's
RE2, the dialect the patterns are published in, and positions are counted in arrays. Results are those of ``spans.py``.
The functions are made inside others, so that they travel to the workers by value.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Rules

MATCH = "array<struct<start:int,end:int,type:string,value:string>>"
TOKENIZED = "array<struct<start:int,end:int,type:string,value:string,token:string,token_type:string,ordinal:int>>"


@lru_cache(maxsize=1024)
def _reads(pattern: str) -> bool:
    """Whether Arrow's matcher reads the pattern; its ``\\C`` is a byte, not a character."""
    try:
        pc.replace_substring_regex(pa.array(["a"]), pattern=pattern, replacement="")
    except pa.ArrowInvalid:
        return False
    return "\\C" not in pattern


def readable(rules: Rules) -> bool:
    return bool(rules.active) and all(_reads(rule.pattern) for rule in rules.active)


def _helpers():
    def flat(texts):
        """Offsets and bytes of a string array, from 0 on."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        return offsets.astype(np.int64) - offsets[0], data

    def absent(data):
        """A character that no text of the batch holds."""
        seen = np.bincount(data, minlength=32)
        for low in range(32):
            if not seen[low]:
                return chr(low)
        raw, high = data.tobytes(), 0xF0000
        while chr(high).encode() in raw:
            high += 1
        return chr(high)

    def strings(data, start, end):
        """The pieces of ``data`` from start to end as a string array."""
        at = np.concatenate([[0], np.cumsum(end - start)])
        taken = data[np.repeat(start - at[:-1], end - start) + np.arange(at[-1])]
        return pa.StringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(taken))

    def listed(sizes, **fields):
        """A list per row, of so many structs each."""
        items = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items)

    def unpacked(lists):
        """The sizes of the lists (null: 0) and the fields of all their structs."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        items = lists.flatten()
        return sizes, dict(zip([f.name for f in items.type], items.flatten()))

    def undisputed(start, end):
        """Places that the overlap rule keeps: whatever starts inside the last kept one goes."""
        kept, reach = [], -1
        for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
            if a >= reach:
                kept.append(i)
                reach = b
        return np.array(kept, dtype=np.int64)

    return flat, absent, strings, listed, unpacked, undisputed


def _scanner(rules: Rules, overlaps: bool = False):
    """Texts to lists of matches."""
    flat, absent, strings, listed, _, undisputed = _helpers()
    active = [(rule.pattern, rule.literals, rule.any_of) for rule in rules.active]
    types = [rule.type for rule in rules.active]

    def scanned(texts):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        offsets, data = flat(texts)
        mark, raw = absent(data), data.tobytes()
        sign = mark.encode()
        starts, ends, ruled = [], [], []
        for rule, (pattern, literals, any_of) in enumerate(active):
            if any(word.encode() not in raw for word in literals) or (any_of and all(word.encode() not in raw for word in any_of)):
                continue
            # Every match is set between marks: its place is theirs, less the marks before it.
            marked = flat(pc.replace_substring_regex(texts, pattern=pattern, replacement=f"{mark}\\0{mark}"))[1]
            at = np.flatnonzero(marked == sign[0])
            for i in range(1, len(sign)):
                at = at[marked[at + i] == sign[i]]
            at = at - np.arange(len(at)) * len(sign)
            starts.append(at[0::2])
            ends.append(at[1::2])
            ruled.append(np.full(len(at) // 2, rule))
        start, end, rule = (np.concatenate([np.zeros(0, np.int64), *part]) for part in (starts, ends, ruled))
        # Places in the whole batch order rows and matches at once: earliest, then longest, then the first rule.
        order = np.lexsort((rule, -end, start))
        start, end, rule = start[order], end[order], rule[order]
        if overlaps:
            kept = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)])
        else:
            kept = undisputed(start, end)
        start, end, rule = start[kept], end[kept], rule[kept]
        row = np.searchsorted(offsets, start, side="right") - 1
        # Positions count characters, not bytes.
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first = chars[offsets[row]]
        return listed(
            np.bincount(row, minlength=len(texts)),
            start=pa.array(chars[start] - first, pa.int32()), end=pa.array(chars[end] - first, pa.int32()),
            type=pa.array(types, pa.string()).take(pa.array(rule)), value=strings(data, start, end),
        )

    return scanned


def _resolver():
    """Lists of matches to those that the overlap rule keeps."""
    _, _, _, listed, unpacked, undisputed = _helpers()

    def resolved(lists):
        sizes, fields = unpacked(lists)
        row = np.repeat(np.arange(len(sizes)), sizes)
        # Rows are set apart by more than any position.
        apart = row * (1 << 32)
        start, end = (fields[name].to_numpy().astype(np.int64) + apart for name in ("start", "end"))
        kept = undisputed(start, end)
        rest = {name: field.take(pa.array(kept)) for name, field in fields.items()}
        return listed(np.bincount(row[kept], minlength=len(sizes)), **rest)

    return resolved


def _numberer(distinct: bool):
    """Lists of matches to the same with placeholders; with ``distinct`` only where a value appears first."""
    _, _, _, listed, unpacked, _ = _helpers()

    def numbered(lists):
        sizes, fields = unpacked(lists)
        row = np.repeat(np.arange(len(sizes)), sizes)
        kind, value = (fields[name].dictionary_encode() for name in ("type", "value"))
        coded, names = kind.indices.to_numpy().astype(np.int64), kind.dictionary
        # The first place of each value of a row, in order of place, and for each match which of them is its value's.
        _, first, which = np.unique(
            row * max(len(value.dictionary), 1) + value.indices.to_numpy(), return_index=True, return_inverse=True
        )
        order = np.argsort(first)
        first, which = first[order], np.argsort(order)[which]
        # Counted within the row and the type: the sort is stable, so a group keeps the order of places.
        group = row[first] * max(len(names), 1) + coded[first]
        by_group = np.argsort(group, kind="stable")
        opens = np.concatenate([[True], np.diff(group[by_group]) != 0])[: len(group)]
        ordinal = np.empty(len(group), np.int32)
        ordinal[by_group] = np.arange(len(group)) - np.flatnonzero(opens)[np.cumsum(opens) - 1] + 1
        kinds, ordinals = names.take(pa.array(coded[first])), pa.array(ordinal)
        parts = [kinds, pa.scalar("_"), ordinals.cast(pa.string())]
        tokens = pc.binary_join_element_wise(pa.scalar("["), *parts, pa.scalar("]"), "")
        if distinct:
            sizes = np.bincount(row[first], minlength=len(sizes))
            fields = {name: field.take(pa.array(first)) for name, field in fields.items()}
        else:
            tokens, kinds, ordinals = (made.take(pa.array(which)) for made in (tokens, kinds, ordinals))
        return listed(sizes, **fields, token=tokens, token_type=kinds, ordinal=ordinals)

    return numbered


def scan_batches(text: Column, rules: Rules, overlaps: bool = False) -> Column:
    """``scan_text`` in batches."""
    scanned = _scanner(rules, overlaps)

    @F.arrow_udf(MATCH)
    def scanned_in_batches(texts: pa.Array) -> pa.Array:
        return scanned(texts)

    return scanned_in_batches(F.make_valid_utf8(text))


def tokens_batches(text: Column, rules: Rules, distinct: bool = False) -> Column:
    """``number_matches`` of ``scan_text`` in batches; with ``distinct`` each value once, where it appears first."""
    scanned, numbered = _scanner(rules), _numberer(distinct)

    @F.arrow_udf(TOKENIZED)
    def numbered_in_batches(texts: pa.Array) -> pa.Array:
        return numbered(scanned(texts))

    return numbered_in_batches(F.make_valid_utf8(text))


def resolved_tokens_batches(matches: Column) -> Column:
    """``number_matches`` of ``resolve_overlaps`` in batches."""
    resolved, numbered = _resolver(), _numberer(False)

    @F.arrow_udf(TOKENIZED)
    def resolved_in_batches(lists: pa.Array) -> pa.Array:
        return numbered(resolved(lists))

    return resolved_in_batches(matches)
