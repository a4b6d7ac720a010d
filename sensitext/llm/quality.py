"""Quality rules: distribution divergence from language references.

Every document is compared with each language of the corpus by two histograms: characters by class, and
common words of the language plus everything else. The measure is the Jensen-Shannon distance (base 2, so
0 to 1). The references are exact counts over all documents of a language. A document fails when even the
nearest language is too far away, and only if it is long enough for the histogram to mean something.

Defined results: a null text counts as empty; a document under the minimum lengths is not judged by the
divergence (only by the base rules), nor is one whose own language has too few words for a reference; null languages form a language of their own; with no reference at all
(empty table) nothing fails the divergence. Repeated rows are judged one by one. Extra columns pass through; those
with the name of a result are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import cut_lineage
from .words import SLICE_BYTES, extended_batch, extended_schema, split_words, text_slices

SPACES = r"\x20\x09-\x0D"
# The symbols that the base rules count.
SYMBOLS = "#*$%&|<>"
#: Character classes in order; a character belongs to the first that matches. ``other`` takes the rest.
CLASSES = (
    ("space", SPACES),
    ("lower", "a-z"),
    ("upper", "A-Z"),
    ("digit", "0-9"),
    ("symbol", r"#*$%&|<>=+_~^@\\/{}\[\]"),
    ("mark", r"!?;:.,'\"()\-`"),
)
OTHER = "other"


@dataclass(frozen=True)
class Limits:
    """When the divergence rejects: both distances are to the nearest language."""

    max_class_distance: float = 0.30
    max_word_distance: float = 0.47
    min_chars: int = 200
    min_words: int = 50
    common_words: int = 50
    common_share: float = 0.001
    languages: int = 64
    language_share: float = 0.0001


_CLASS_TABLE = {
    ord(c): i
    for i, (_, members) in reversed(list(enumerate(CLASSES)))
    for c in map(chr, range(128))
    if re.match(f"[{members}]", c)
}
_CLASS_OF_BYTE = np.array([_CLASS_TABLE.get(b, len(CLASSES)) for b in range(256)], np.uint8)
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def class_counts(text: bytes) -> np.ndarray:
    """Characters of each class in UTF-8 text, ``other`` last."""
    per_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return np.bincount(_CLASS_OF_BYTE, weights=per_byte * ~_CONTINUES, minlength=len(CLASSES) + 1).astype(np.int64)


def language_counts(docs: DataFrame) -> DataFrame:
    """Exact counts over all documents: (lang, word, null, n) and (lang, null, class, n).

    Words are counted within slices of whole texts first, so a word is shuffled once per slice, not per use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 4 * SLICE_BYTES):
            words = split_words(batch.column("text"))
            langs = batch.column("lang").dictionary_encode(null_encoding="encode")
            of_text = langs.indices.to_numpy(zero_copy_only=False)
            classes = np.zeros((len(langs.dictionary), len(CLASSES) + 1), np.int64)
            for lang, text in zip(of_text, batch.column("text").to_pylist()):
                if text:
                    classes[lang] += class_counts(text.encode("utf-8"))
            keys, n = np.unique(of_text[words.rows()] * np.int64(len(words.vocabulary)) + words.ids, return_counts=True)
            lang, word = np.divmod(keys, max(len(words.vocabulary), 1))
            at = np.nonzero(classes)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(np.concatenate([lang, at[0]]))),
                    pa.concat_arrays([words.vocabulary.take(pa.array(word)), pa.nulls(len(at[0]), pa.string())]),
                    pa.concat_arrays([pa.nulls(len(word), pa.int32()), pa.array(at[1].astype(np.int32))]),
                    pa.array(np.concatenate([n, classes[at]])),
                ],
                names=["lang", "word", "class", "n"],
            )

    counts = docs.select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, word string, class int, n long")
    return counts.groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))


def language_references(docs: DataFrame, limits: Limits = Limits()) -> list[dict]:
    """Per language, over all documents: its character classes and its most common words with their counts.

    The ``languages`` languages with the most words become references, and every other one that has at least
    ``language_share`` of all words. A common word has at least ``common_share`` of its language's words, and the
    ``common_words`` most frequent count. What reaches the driver is bounded by these numbers.
    """
    counts = cut_lineage(language_counts(docs), "language-counts")
    totals = counts.filter("class is null").groupBy("lang").agg(F.sum("n").alias("total"))
    totals = cut_lineage(totals, "language-totals")
    largest = totals.orderBy(F.desc("total"), "lang").limit(limits.languages)
    every = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    kept = cut_lineage(largest.union(totals.filter(F.col("total") >= limits.language_share * every)).distinct(), "languages")
    references = {r.lang: {"lang": r.lang, "total": r.total, "classes": [0] * (len(CLASSES) + 1), "words": []} for r in kept.collect()}
    own = counts.join(kept.withColumnRenamed("lang", "known"), F.col("lang").eqNullSafe(F.col("known")))
    words = own.filter("class is null").filter(F.col("n") >= limits.common_share * F.col("total"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")) <= limits.common_words
    words = words.withColumn("first", first).filter("first").select("lang", "word", "class", "n")
    for r in own.filter("class is not null").select("lang", "word", "class", "n").union(words).collect():
        if r["class"] is not None:
            references[r.lang]["classes"][r["class"]] = r.n
        else:
            references[r.lang]["words"].append((r.word, r.n))
    for reference in references.values():
        reference["words"].sort(key=lambda w: (-w[1], w[0]))
    return sorted(references.values(), key=lambda r: (-r["total"], r["lang"] is not None, r["lang"] or ""))


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts from the reference counts; 0 for an empty row."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1), p.shape)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(parts.sum(axis=1) / 2, 0)), 0.0)


_TOGETHER = 64  # languages whose common words are counted in one matrix
_WORD = re.compile(f"[^{SPACES}]")


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window that occurs at least twice, the first occurrence included."""
    n = len(ids) - 2
    if n < 2:
        return 0
    wide = ids.astype(np.int64)
    _, pairs = np.unique(wide[:-1] << 32 | wide[1:], return_inverse=True)
    windows = pairs[:n].astype(np.int64) << 32 | wide[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    + [T.StructField(c, T.DoubleType()) for c in ("class_distance", "word_distance")]
)


def judge_quality(docs: DataFrame, references: list[dict], limits: Limits = Limits()) -> DataFrame:
    """All columns of ``docs`` with the base counts, the two distances to the nearest language and the verdict."""
    spec = [(r["classes"], r["words"], r["total"]) for r in references]
    known = {r["lang"] for r in references}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = []
        for at in range(0, len(spec), _TOGETHER):
            part = spec[at : at + _TOGETHER]
            class_refs = [np.array(c, np.float64) for c, _, _ in part]
            word_refs = [np.array([*(n for _, n in w), t - sum(n for _, n in w)], np.float64) for _, w, t in part]
            every = sorted({w for _, words, _ in part for w, _ in words})
            place = {w: i for i, w in enumerate(every)}
            groups.append((place, [(c, r, np.array([place[w] for w, _ in words], np.int64)) for c, r, (_, words, _) in zip(class_refs, word_refs, part)]))
        for batch in text_slices(batches, "text"):
            words = split_words(batch.column("text"))
            n_words = np.diff(words.bounds)
            spaces = np.zeros(len(n_words), np.int64)
            sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column("text").to_pylist()
            classes = np.zeros((len(texts), len(CLASSES) + 1), np.int64)
            symbols, lines, repeats = (np.zeros(len(texts), np.int64) for _ in range(3))
            for i, text in enumerate(texts):
                if not text:
                    continue
                classes[i] = class_counts(text.encode("utf-8"))
                spaces[i] = classes[i, 0]
                symbols[i] = sum(map(text.count, SYMBOLS))
                lines[i] = repeated_lines(text)
                repeats[i] = repeated_words(words.ids[words.bounds[i] : words.bounds[i + 1]])
            vocabulary, rows = words.vocabulary.to_pylist(), words.rows()
            far_class, far_word = np.full(len(texts), np.inf), np.full(len(texts), np.inf)
            for place, members_of in groups:
                to_common = np.array([place.get(w, len(place)) for w in vocabulary], np.int64)
                common = np.zeros((len(texts), len(place) + 1), np.int64)
                if len(words.ids):
                    flat = rows * (len(place) + 1) + to_common[words.ids]
                    common = np.bincount(flat, minlength=common.size).reshape(common.shape)
                for class_ref, word_ref, members in members_of:
                    far_class = np.minimum(far_class, js_distance(classes, class_ref))
                    own = common[:, members]
                    rest = n_words - own.sum(axis=1)
                    far_word = np.minimum(far_word, js_distance(np.column_stack([own, rest]), word_ref))
            if not spec:
                far_class[:] = far_word[:] = 0
            failed = (n_words < 50) | (100 * repeats > 50 * n_words)
            strange = (sizes >= limits.min_chars) & (np.round(far_class, 9) > limits.max_class_distance)
            strange |= (n_words >= limits.min_words) & (np.round(far_word, 9) > limits.max_word_distance)
            strange &= np.array([lang in known for lang in batch.column("lang").cast(pa.string()).to_pylist()], bool)
            found = (n_words, sizes - spaces, symbols, lines, repeats, failed, ~failed & ~strange, far_class, far_word)
            yield extended_batch(batch, dict(zip(RESULT.names, map(pa.array, found))))

    return docs.mapInArrow(run, extended_schema(docs.schema, RESULT.fields))


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``judge_quality`` against the references of the same table."""
    return judge_quality(docs, language_references(docs, limits), limits)
