"""Exact ids of the word-level byte-pair tokenizer for whole texts, one distinct word at a time.

The tokenizer normalises (NFC, white space, lower case), cuts into pre-tokens that never hold white space and merges
each alone. So a text's ids are the ids of its parts between ASCII white space, one after the other, and equal
parts have equal ids. Parts are cut and counted in Arrow, pre-tokens of a part by the tokenizer's own pattern, and all
pre-tokens that are new in a slice are merged together in numpy. To the tokenizers library go whole a part with other
white space, with the start of a special token or with a letter whose lower case depends on its neighbours, and a
pre-token of more than ``LONGEST_MERGED`` bytes. The library is loaded when the first of them comes.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .words import Words, split_words, text_bytes

#: Bytes of parts and ids that a worker remembers; beyond that it goes on with those of the last slice.
REMEMBERED_BYTES = 16 << 20
#: Longer parts are not remembered.
LONGEST_REMEMBERED = 64
LONGEST_MERGED = 1024
#: Parts that are one word, or one word and a mark: letters whose lower case is one letter each.
_WORD = "^[A-Za-zÀ-ÖØ-öø-įı-ſ]+[.,!]?$"
#: Latin to Extended-A, Greek but for the letter with a final form, Cyrillic, kana, CJK and Hangul.
_PLAIN = regex.compile("[\x21-\x7e\xa1-ſ\u0391-\u03a1\u03a4-\u03a9\u03b1-\u03c9\u0400-\u045f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*").fullmatch


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@dataclass(frozen=True)
class Vocabulary:
    """The tokenizer's tables: pre-token pattern, ids and merges in order, token texts by id."""

    pattern: str
    ids: dict[str, int]
    merges: dict[tuple[str, str], int]
    suffix: str
    tokens: list[str]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max(chain(model["vocab"].values(), special.values())) + 1)
        for token, number in chain(model["vocab"].items(), special.items()):
            tokens[number] = token
        return cls(pattern, model["vocab"], {p: i for i, p in enumerate(pairs)}, model["end_of_word_suffix"], tokens)


def _byte_letters() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


BYTE_LETTERS = _byte_letters()


def merge_word(word: str, vocabulary: Vocabulary) -> tuple[int, ...]:
    """Ids of one pre-token by merging its lowest-ranked pair, leftmost first, until none is left."""
    parts = [BYTE_LETTERS[b] for b in word.encode("utf-8")]
    parts[-1] += vocabulary.suffix
    rank = vocabulary.merges.get
    none = len(vocabulary.merges)
    while len(parts) > 1:
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        best = min(ranks)
        if best == none:
            break
        at = ranks.index(best)
        joined = parts[at] + parts[at + 1]
        left, right = parts[at], parts[at + 1]
        merged, k = [], 0
        while k < len(parts):
            if k + 1 < len(parts) and parts[k] == left and parts[k + 1] == right:
                merged.append(joined)
                k += 2
            else:
                merged.append(parts[k])
                k += 1
        parts = merged
    return tuple(vocabulary.ids[p] for p in parts)


@dataclass(frozen=True)
class Ids:
    """``values[bounds[i]:bounds[i + 1]]`` are the ids of item i."""

    values: np.ndarray
    bounds: np.ndarray

    def take(self, items: np.ndarray) -> Ids:
        """The ids of some items, in that order; none for item -1."""
        sizes = np.append(np.diff(self.bounds), 0)[items]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(np.append(self.bounds[:-1], 0)[items] - ends[:-1], sizes)
        return Ids(self.values[at], ends)


def joined(several: list[Ids]) -> Ids:
    """The items of several, one after the other."""
    shift = np.cumsum([0, *(len(x.values) for x in several)])
    bounds = [x.bounds[1:] + s for x, s in zip(several, shift)]
    none = [np.zeros(0, np.int64)]
    return Ids(np.concatenate([x.values for x in several] or none), np.concatenate([np.zeros(1, np.int64), *bounds]))


def listed(lists: list[tuple[int, ...]]) -> Ids:
    flat = np.fromiter(chain.from_iterable(lists), np.int64)
    return Ids(flat, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64))


class Merges:
    """Merges many pre-tokens at once: one row of symbols, and in each round every word's lowest-ranked pairs."""

    WORDS = 20_000  # merged together, so memory does not depend on the slice

    def __init__(self, vocabulary: Vocabulary):
        ids, suffix = vocabulary.ids, vocabulary.suffix
        self.inner = np.array([ids[c] for c in BYTE_LETTERS], np.int64)
        self.final = np.array([ids[c + suffix] for c in BYTE_LETTERS], np.int64)
        self.wide = np.int64(len(vocabulary.tokens))
        key = np.array([ids[x] * int(self.wide) + ids[y] for x, y in vocabulary.merges], np.int64)
        order = np.argsort(key)
        self.key, self.none = key[order], len(key)
        self.rank = np.append(order, self.none)
        self.made = np.array([ids[x + y] for x, y in vocabulary.merges], np.int64)

    def ranks(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of each symbol with the next one of its word; ``none`` where they do not merge."""
        wanted = symbols[:-1] * self.wide + symbols[1:]
        at = np.searchsorted(self.key, wanted)
        at[at == self.none] = 0
        hit = (self.key[at] == wanted) & (word[:-1] == word[1:])
        return np.append(self.rank[np.where(hit, at, self.none)], self.none)

    def of(self, letters: np.ndarray, bounds: np.ndarray) -> Ids:
        """Ids of the words letters[bounds[i]:bounds[i + 1]]."""
        out = []
        for k in range(0, len(bounds) - 1, self.WORDS):
            some = bounds[k : k + self.WORDS + 1]
            out.append(self._together(letters[some[0] : some[-1]], np.diff(some)))
        return joined(out)

    def _together(self, letters: np.ndarray, sizes: np.ndarray) -> Ids:
        words = len(sizes)
        symbols = self.inner[letters]
        last = np.cumsum(sizes)[sizes > 0] - 1
        symbols[last] = self.final[letters[last]]
        word = np.repeat(np.arange(words), sizes)
        done_symbols, done_words = [], []
        while len(symbols):
            rank = self.ranks(symbols, word)
            first = np.nonzero(np.diff(word, prepend=-1))[0]
            lowest = np.minimum.reduceat(rank, first)
            spread = np.repeat(lowest, np.diff(first, append=len(word)))
            over = spread == self.none
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                left = ~over
                symbols, word, rank, spread = symbols[left], word[left], rank[left], spread[left]
                if not len(symbols):
                    break
            here = rank == spread
            # In a run of one symbol every other pair merges, from the left.
            touching = here[1:] & here[:-1]
            if touching.any():
                start = here.copy()
                start[1:] &= ~here[:-1]
                begin = np.maximum.accumulate(np.where(start, np.arange(len(here)), 0))
                here &= (np.arange(len(here)) - begin) % 2 == 0
            symbols = np.where(here, self.made[np.minimum(rank, self.none - 1)], symbols)
            stay = np.append(True, ~here[:-1])
            symbols, word = symbols[stay], word[stay]
        if not done_words:
            return Ids(np.zeros(0, np.int64), np.zeros(words + 1, np.int64))
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return Ids(np.concatenate(done_symbols)[order], np.searchsorted(word[order], np.arange(words + 1)))


class Encoder:
    """Ids of the texts of a slice. ``ids_of`` gives the ids of a list of distinct pre-tokens."""

    def __init__(self, path: str, ids_of: Callable[[list[str]], list[tuple[int, ...]]] | None = None):
        self.path = path
        self.vocabulary = Vocabulary.read(path)
        self.cut = regex.compile(self.vocabulary.pattern).findall
        self.ids_of = ids_of
        self.forget()

    def forget(self) -> None:
        self.parts, self.known = pa.array([], pa.string()), Ids(np.zeros(0, np.int64), np.zeros(1, np.int64))

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return load(self.path)

    @cached_property
    def merges(self) -> Merges:
        return Merges(self.vocabulary)

    def word_ids(self, words: pa.Array) -> Ids:
        """Ids of distinct pre-tokens."""
        if self.ids_of:
            return listed(self.ids_of(words.to_pylist()))
        return self.merged(words)

    def merged(self, words: pa.Array) -> Ids:
        letters, bounds = text_bytes(words)
        sizes = np.diff(bounds)
        long = np.nonzero(sizes > LONGEST_MERGED)[0]
        if not len(long):
            return self.merges.of(letters, bounds)
        tokenize = self.tokenizer.model.tokenize
        apart = listed([tuple(t.id for t in tokenize("".join([BYTE_LETTERS[b] for b in words[i].as_py().encode("utf-8")]))) for i in long])
        short = np.nonzero(sizes <= LONGEST_MERGED)[0]
        together = joined([self.merges.of(*text_bytes(words.take(pa.array(short)))), apart])
        where = np.empty(len(words), np.int64)
        where[np.concatenate([short, long])] = np.arange(len(words))
        return together.take(where)

    def pre_tokens(self, part: str) -> list[str] | None:
        """The pre-tokens of a part, or None if the part is to go to the library."""
        if part.isascii():
            if not part.isprintable() or "<|" in part:
                return None
        else:
            part = unicodedata.normalize("NFC", part)
            if not _PLAIN(part) or "<|" in part:
                return None
        part = part.lower()
        # Most parts are letters alone, or with one mark after them; the pattern gives the same.
        if part.isalpha():
            return [part]
        if part[-1:] in (".", ",", "!") and part[:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.cut(part)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and their bounds."""
        return self.of_words(split_words(texts))

    def of_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and the bounds of the texts."""
        parts = words.vocabulary
        if self.known.values.nbytes + self.parts.nbytes > REMEMBERED_BYTES:
            self.remember(parts, self.known.take(self.places(parts)), pa.array(self.places(parts) >= 0), anew=True)
        place = self.places(parts)
        new = np.nonzero(place < 0)[0]
        fresh = parts.take(pa.array(new))
        ids = self.part_ids(fresh)
        place[new] = len(self.parts) + np.arange(len(new))
        flat = joined([self.known, ids]).take(place[words.ids] if len(words.ids) else np.zeros(0, np.int64))
        self.remember(fresh, ids, pc.less_equal(pc.binary_length(fresh), LONGEST_REMEMBERED))
        return flat.values.astype(np.uint32), flat.bounds[words.bounds]

    def places(self, parts: pa.Array) -> np.ndarray:
        """Where parts are remembered, or -1."""
        return pc.fill_null(pc.index_in(parts, self.parts), -1).to_numpy().astype(np.int64)

    def remember(self, parts: pa.Array, ids: Ids, which: pa.Array, anew: bool = False) -> None:
        kept = ids.take(np.nonzero(which.to_numpy(zero_copy_only=False))[0])
        if anew:
            self.forget()
        self.parts = pa.concat_arrays([self.parts, parts.filter(which)])
        self.known = joined([self.known, kept])

    def part_ids(self, parts: pa.Array) -> Ids:
        """Ids of distinct parts: single words in Arrow, the others one by one; each distinct word is merged once."""
        simple = pc.match_substring_regex(parts, _WORD).to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(parts.filter(pa.array(simple)))
        stems = pc.ascii_rtrim(lower, ".,!")
        marked = pc.not_equal(pc.binary_length(lower), pc.binary_length(stems)).to_numpy(zero_copy_only=False)
        marks = pc.utf8_slice_codeunits(lower.filter(pa.array(marked)), -1)
        cuts = [self.pre_tokens(part) for part in parts.filter(pa.array(~simple)).to_pylist()]
        others = pa.array([w for cut in cuts if cut for w in cut], pa.string())
        coded = pa.concat_arrays([stems, marks, others]).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        found = [self.word_ids(coded.dictionary)]
        whole = [tuple(self.tokenizer.encode(p.as_py(), add_special_tokens=False).ids) for p, cut in zip(parts.filter(pa.array(~simple)), cuts) if cut is None]
        found.append(listed(whole))
        # The words of each part in a row: a stem and its mark; what the pattern cut; or what the library gave.
        many = np.ones(len(parts), np.int64)
        many[simple] += marked
        many[~simple] = [1 if cut is None else len(cut) for cut in cuts]
        first = np.concatenate([[0], np.cumsum(many)])
        of_part = np.empty(first[-1], np.int64)
        of_part[first[:-1][simple]] = number[: len(stems)]
        of_part[first[:-1][simple][marked] + 1] = number[len(stems) : len(stems) + len(marks)]
        other = number[len(stems) + len(marks) :].tolist()
        at, done, given = first[:-1][~simple].tolist(), 0, len(coded.dictionary)
        for start, cut in zip(at, cuts):
            if cut is None:
                of_part[start], given = given, given + 1
            else:
                of_part[start : start + len(cut)] = other[done : done + len(cut)]
                done += len(cut)
        spelled = joined(found).take(of_part)
        return Ids(spelled.values, spelled.bounds[first])
