"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence gets a logistic score from its words; a document is toxic if at least one of its sentences is, so
the sentence scores are combined by noisy-or, with a leak for what no sentence explains. Weights, bias and
leak are fitted together by gradient descent on the document labels alone. The same sentence scores then
locate the offending sentences.

A sentence ends with a full stop, an exclamation or question mark, or a line end. Words are compared in lower
case without the marks around them; a word also stands for its beginnings of 4 to 8 letters, since insults
are inflected.

Defined results: null and empty texts have no sentence and get the leak as score; null or unknown labels are
not learned from; a document with several labels counts as toxic if one of them says so; without usable
labels the model has no words and gives every document the same low score. Rows with equal ids are scored one
by one. Extra columns pass through ``score_toxicity``; one with the name of the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, extended_batch, extended_schema, split_words, text_bytes, text_slices

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit. At most ``documents`` labelled documents (those with the smallest hash) and
    ``features`` words take part, so fitting is one task of bounded size whatever the corpus holds."""

    documents: int = 8_000
    features: int = 1_000
    least_ratio: float = 25.0
    steps: int = 400
    rate: float = 0.1
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    leak: float


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a star); nothing for a word of marks only."""
    word = word.lower().strip(_MARKS)
    return [word, *(word[:k] + "*" for k in range(4, min(len(word), 9)))] if word else []


def _expand(numbers: np.ndarray, starts: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items that hold ``numbers``, the (item, feature) pairs; features[starts[n]:starts[n + 1]] belong to n."""
    many = starts[numbers + 1] - starts[numbers]
    item = np.repeat(np.arange(len(numbers)), many)
    within = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    return item, features[starts[numbers][item] + within]


def sentences(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its sentence (dense, over all texts), and for each sentence its text."""
    every, bounds = text_bytes(texts)
    space = _SPACE[every]
    starts = ~space
    starts[1:] &= space[:-1]
    first = bounds[:-1][np.diff(bounds) > 0]
    starts[first] = ~space[first]
    ends = np.cumsum(_END[every]) - _END[every]
    ended = ends[starts]
    row = words.rows()
    new = np.ones(len(row), bool)
    new[1:] = (ended[1:] != ended[:-1]) | (row[1:] != row[:-1])
    return np.cumsum(new) - 1, row[new]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _log_sigmoid(z):
    return -np.logaddexp(0, -z)


def fit(texts: list[pa.Array], toxic: np.ndarray, training: Training = Training()) -> Model:
    """Weights of words, bias and leak that make the noisy-or of the sentences explain the labels."""
    known: dict[str, int] = {}
    ids, sentence, text_of, done, rows = [], [], [], 0, 0
    for part in texts:
        words = split_words(part)
        numbers = np.array([known.setdefault(w, len(known)) for w in words.vocabulary.to_pylist()], np.int64)
        where, owner = sentences(part, words)
        ids.append(numbers[words.ids] if len(words.ids) else np.zeros(0, np.int64))
        sentence.append(where + done)
        text_of.append(owner + rows)
        done, rows = done + len(owner), rows + len(part)
    y = toxic.astype(np.float64)
    leak0 = -4.0
    if not done or y.min() == y.max():
        return Model({}, -12.0, float(_sigmoid(leak0)))
    ids, sentence, text_of = np.concatenate(ids), np.concatenate(sentence), np.concatenate(text_of)
    names: dict[str, int] = {}
    lists = [[names.setdefault(f, len(names)) for f in word_features(w)] for w in known]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    features = np.array([f for x in lists for f in x], np.int64)
    del lists
    with_word, toxic_with = np.zeros(len(names)), np.zeros(len(names))
    first_word = np.searchsorted(text_of[sentence], np.arange(0, rows + 200, 200))  # some documents at a time
    for s, e in zip(first_word.tolist(), first_word[1:].tolist()):
        doc, word = np.divmod(np.unique(text_of[sentence[s:e]] * np.int64(len(known)) + ids[s:e]), len(known))
        item, feature = _expand(word, starts, features)
        doc, feature = np.divmod(np.unique(doc[item] * np.int64(len(names)) + feature), len(names))
        np.add.at(with_word, feature, 1)
        np.add.at(toxic_with, feature, y[doc])
    # Log-likelihood ratio of each feature being independent of the label; of use are those that toxic texts have more often.
    base, clean_with = y.mean(), with_word - toxic_with
    with np.errstate(divide="ignore", invalid="ignore"):
        toxic_part = np.where(toxic_with > 0, toxic_with * np.log(toxic_with / (with_word * base)), 0)
        ratio = 2 * (toxic_part + np.where(clean_with > 0, clean_with * np.log(clean_with / (with_word * (1 - base))), 0))
    chosen = np.nonzero((toxic_with > with_word * base) & (ratio >= training.least_ratio))[0]
    chosen = chosen[np.argsort(-ratio[chosen], kind="stable")][: training.features]
    place = np.full(len(names), -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    useful = np.zeros(len(known), bool)
    useful[np.repeat(np.arange(len(known)), np.diff(starts))[place[features] >= 0]] = True
    hit = useful[ids]
    item, feature = _expand(ids[hit], starts, features)
    item, feature = item[place[feature] >= 0], place[feature[place[feature] >= 0]]
    cells = np.unique(sentence[hit][item] * np.int64(max(len(chosen), 1)) + feature)
    s_of, f_of = np.divmod(cells, max(len(chosen), 1))
    s_ids, s_of = np.unique(s_of, return_inverse=True)
    s_doc = text_of[s_ids]
    plain = np.bincount(text_of, minlength=rows) - np.bincount(s_doc, minlength=rows)

    theta = np.concatenate([np.full(len(chosen), 1.0), [-6.0, leak0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, training.steps + 1):
        w, bias, leak = theta[:-2], theta[-2], theta[-1]
        zs = bias + np.bincount(s_of, weights=w[f_of], minlength=len(s_ids))
        clean = _log_sigmoid(-leak) + plain * _log_sigmoid(-bias) + np.bincount(s_doc, weights=_log_sigmoid(-zs), minlength=rows)
        clean = np.minimum(clean, -1e-9)
        # d loss / d log P(clean); P(toxic) = 1 - exp(clean)
        push = (y * np.exp(clean) / -np.expm1(clean) - (1 - y)) / rows
        per_sentence = -_sigmoid(zs) * push[s_doc]
        grad = np.concatenate(
            [
                np.bincount(f_of, weights=per_sentence[s_of], minlength=len(chosen)) + training.ridge * w / len(theta),
                [per_sentence.sum() - _sigmoid(bias) * (plain * push).sum(), -_sigmoid(leak) * push.sum()],
            ]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - training.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
        theta[-2] = min(theta[-2], -4.0)
    spelled = list(names)
    weights = {spelled[f]: float(x) for f, x in zip(chosen, theta)}
    return Model(weights, float(theta[-2]), float(_sigmoid(theta[-1])))


_MODEL = "words array<string>, weights array<double>, bias double, leak double"


def train_toxicity(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """Fits on at most ``training.documents`` of the given labelled documents.

    The sample of labels is bounded, so it is broadcast and the documents are not shuffled; one task fits and
    only the bounded model comes back to the driver.
    """
    some = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.documents)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in text_slices(batches, "text"):
            texts.append(batch.column("text"))
            toxic.append(batch.column("toxic").to_numpy(zero_copy_only=False))
        model = fit(texts, np.concatenate(toxic) if toxic else np.zeros(0), training)
        row = {"words": list(model.weights), "weights": list(model.weights.values()), "bias": model.bias, "leak": model.leak}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema(
            [("words", pa.list_(pa.string())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64()), ("leak", pa.float64())]
        ))

    fitted = sample.repartition(1).mapInArrow(run, _MODEL).collect()
    if not fitted:  # no row, so no batch and no task
        return Model({}, -12.0, float(_sigmoid(-4.0)))
    return Model(dict(zip(fitted[0].words, fitted[0].weights)), fitted[0].bias, fitted[0].leak)


def _sentence_logits(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(texts)
    where, owner = sentences(texts, words)
    if not len(owner):
        return np.zeros(0), owner
    place = {f: i for i, f in enumerate(model.weights)}
    weights = np.array([*model.weights.values(), 0.0])
    lists = [[place[f] for f in word_features(w) if f in place] for w in words.vocabulary.to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    some = np.nonzero(np.diff(starts)[words.ids])[0]
    item, feature = _expand(words.ids[some], starts, np.array([f for x in lists for f in x], np.int64))
    # A feature counts once in a sentence, as in training.
    sentence, feature = np.divmod(np.unique(where[some][item] * np.int64(len(weights)) + feature), len(weights))
    return model.bias + np.bincount(sentence, weights=weights[feature], minlength=len(owner)), owner


def score_toxicity(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability that the document is toxic, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            logits, owner = _sentence_logits(batch.column("text"), model)
            clean = np.bincount(owner, weights=_log_sigmoid(-logits), minlength=batch.num_rows)
            score = 1 - (1 - model.leak) * np.exp(clean)
            yield extended_batch(batch, {column: pa.array(score)})

    return docs.mapInArrow(run, extended_schema(docs.schema, [T.StructField(column, T.DoubleType())]))


def locate_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """One row per offending sentence: doc_id, sentence (from 0), start and end in characters, text, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            logits, owner = _sentence_logits(batch.column("text"), model)
            every, bounds = text_bytes(batch.column("text"))
            found = []
            if len(owner):
                words = split_words(batch.column("text"))
                where, _ = sentences(batch.column("text"), words)
                space = _SPACE[every]
                starts = ~space
                starts[1:] &= space[:-1]
                first = bounds[:-1][np.diff(bounds) > 0]
                starts[first] = ~space[first]
                at = np.nonzero(starts)[0]
                ids = batch.column("doc_id").to_pylist()
                opening = at[np.searchsorted(where, np.arange(len(owner)))]
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                for s in np.nonzero(_sigmoid(logits) >= least)[0]:
                    text, t = owner[s], opening[s]
                    stop = opening[s + 1] if s + 1 < len(owner) and owner[s + 1] == text else bounds[text + 1]
                    said = every[t:stop].tobytes().decode("utf-8").rstrip(" \t\n\v\f\r")
                    start = len(every[bounds[text] : t].tobytes().decode("utf-8"))
                    found.append((ids[text], int(number[s]), start, start + len(said), said, float(_sigmoid(logits[s]))))
            names = ["doc_id", "sentence", "start", "end", "text", "score"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            columns = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, sentence int, start int, end int, text string, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    """Column: whether labels of this document are kept away from the fit (null ids never teach)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
