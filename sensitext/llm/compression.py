"""Quality by compression: a text is good if it is described more shortly by good texts than by bad ones.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is compressed in blocks
with each of them, and the difference of the two sizes, as a share of the text's own bytes, says which of the two it
resembles. Labelled texts that neither dictionary has seen turn that difference into a probability: a logistic curve in
the difference, in the logarithm of the length and in their product, since the difference of a short text says less.

Learning takes a bounded sample (``Learning``); every text is scored, whole. Nothing but the model, of some 230 KB,
goes through the driver.

Defined results: null and empty texts have the difference 0 and the score of that at length 0. Labels without id or
value are not learned from; an id with several labels is good only if all say so. All rows of a sampled id are learned
from. Without good or without bad labels the score is the share of good ones among the labels, one half without any.
Extra columns pass through ``score_quality``; one with the name of the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import extended_batch, extended_schema, text_bytes, text_slices


@dataclass(frozen=True)
class Learning:
    """Bounds of the fit, which is one task whatever the corpus holds: at most ``documents`` labelled ids (those with
    the smallest hash) with at most ``total_bytes`` of text together; ids with more than ``largest`` bytes teach nothing."""

    documents: int = 8_000
    total_bytes: int = 32 << 20
    largest: int = 1 << 20
    dictionary_bytes: int = 112 << 10
    level: int = 3
    block: int = 1024
    segment: int = 50
    ridge: float = 1e-2


@dataclass(frozen=True)
class Model:
    """``weights`` are those of difference, log length, their product and one; without dictionaries only the last counts."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int
    block: int


def blocks(text: bytes, size: int) -> list[bytes]:
    return [text[s : s + size] for s in range(0, len(text), size)]


def build_dictionary(texts: list[bytes], learning: Learning) -> bytes:
    """A trained dictionary; the texts themselves where there are too few to train one."""
    pieces = [p for text in texts for p in blocks(text, learning.block)]
    try:
        return zstandard.train_dictionary(learning.dictionary_bytes, pieces, k=learning.segment, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-learning.dictionary_bytes :]


class Sizes:
    """Compressed bytes of texts with both dictionaries, without what an empty block costs."""

    def __init__(self, model: Model):
        self.block = model.block
        self.ways = []
        for content in (model.good, model.bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=model.level)
            way = zstandard.ZstdCompressor(
                level=model.level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            self.ways.append((way.compress, len(way.compress(b""))))

    def of(self, text: bytes) -> tuple[int, int, int]:
        """(with the good dictionary, with the bad one, plain)."""
        pieces = blocks(text, self.block)
        good, bad = (sum([len(compress(p)) for p in pieces]) - empty * len(pieces) for compress, empty in self.ways)
        return good, bad, len(text)


def evidence(sizes: np.ndarray) -> np.ndarray:
    """The calibrated curve's inputs: normalised difference, log length, their product, one."""
    length = sizes[:, 2] + 16.0
    apart = (sizes[:, 1] - sizes[:, 0]) / length
    return np.column_stack([apart, np.log(length), apart * np.log(length), np.ones(len(sizes))])


def _probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))


def calibrate(sizes: np.ndarray, good: np.ndarray, ridge: float) -> tuple[float, ...]:
    """Weights of a logistic curve by Newton's method, with a small ridge on standardised inputs."""
    x = evidence(sizes)
    middle, spread = x.mean(axis=0), x.std(axis=0)
    middle[-1], spread[-1] = 0.0, 1.0
    spread[spread < 1e-12] = 1.0
    z = (x - middle) / spread
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = _probability(z, w)
        bent = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bent, z.T @ (p - good) + ridge * w)
    plain = w / spread
    plain[-1] = w[-1] - ((w / spread) * middle)[:-1].sum()
    return tuple(plain.tolist())


def fit(texts: list[bytes], good: np.ndarray, first_half: np.ndarray, learning: Learning) -> Model:
    """Dictionaries from the first half of the labelled texts, calibration from the other."""

    def share() -> Model:
        rate = (good.sum() + 0.5) / (len(good) + 1) if len(good) else 0.5
        return Model(b"", b"", (0.0, 0.0, 0.0, float(np.log(rate / (1 - rate)))), learning.level, learning.block)

    teach = [[t for t, g, h in zip(texts, good, first_half) if h and g == kind and t] for kind in (1, 0)]
    rest = ~first_half
    if not all(teach) or len(np.unique(good[rest])) < 2:
        return share()
    model = Model(*(build_dictionary(t, learning) for t in teach), (), learning.level, learning.block)
    measure = Sizes(model).of
    sizes = np.array([measure(t) for t, r in zip(texts, rest) if r], float)
    return Model(model.good, model.bad, calibrate(sizes, good[rest].astype(float), learning.ridge), model.level, model.block)


_MODEL = "good binary, bad binary, weights array<double>"


def train_quality(docs: DataFrame, labels: DataFrame, learning: Learning = Learning()) -> Model:
    """Fits on a bounded sample of the given labels (doc_id, quality) that have documents."""
    label = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    some = (
        held.join(label, "doc_id").filter(F.coalesce("bytes", F.lit(0)) <= learning.largest)
        .withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(learning.documents)
        .withColumn("until", F.sum("bytes").over(Window.orderBy("turn", "doc_id")))  # of at most ``documents`` narrow rows
        .filter(F.coalesce("until", F.lit(0)) <= learning.total_bytes)
        .select("doc_id", "quality", "turn")
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("turn", "doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            (turn, doc_id, (text or "").encode(), int(quality > 0))
            for batch in batches
            for turn, doc_id, text, quality in zip(*(c.to_pylist() for c in batch.columns))
        )
        good = np.array([r[3] for r in rows], np.int64)
        # Bits of the hash that did not choose the sample.
        first_half = np.array([r[0] & 1 == 0 for r in rows], bool)
        model = fit([r[2] for r in rows], good, first_half, learning)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.good], pa.binary()), pa.array([model.bad], pa.binary()), pa.array([list(model.weights)], pa.list_(pa.float64()))],
            names=["good", "bad", "weights"],
        )

    fitted = sample.repartition(1).mapInArrow(run, _MODEL).collect()
    if not fitted:  # no row, so no task
        return fit([], np.zeros(0, np.int64), np.zeros(0, bool), learning)
    return Model(bytes(fitted[0].good), bytes(fitted[0].bad), tuple(fitted[0].weights), learning.level, learning.block)


def score_quality(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability that the document is good, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Sizes(model).of if model.good else lambda text: (0, 0, len(text))
        weights = np.array(model.weights)
        for batch in text_slices(batches, "text"):
            every, bounds = text_bytes(batch.column("text"))
            raw = every.tobytes()
            sizes = [measure(raw[s:e]) for s, e in zip(bounds.tolist(), bounds[1:].tolist())]
            score = _probability(evidence(np.array(sizes, float)), weights)
            yield extended_batch(batch, {column: pa.array(score)})

    return docs.mapInArrow(run, extended_schema(docs.schema, [T.StructField(column, T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    """Column: whether labels of this document are kept away from the fit (null ids never teach)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
