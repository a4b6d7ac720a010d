"""A minimal acyclic transducer of frequent words with their token ids, and encoding and decoding with it.

Words that the corpus uses most, counted over all documents, are compiled into the smallest acyclic automaton that
accepts exactly them: words share their beginnings, and equal states are merged, so they share their endings too.
Every arc carries the number of accepted words before it; the sum along a path is a word's place in the sorted list, and
its ids stand in a table at that place. The compiled arrays are written to one file in the shared folder, sent to
every executor by Spark and memory-mapped there, so the workers of a machine share its pages. Words are looked up
together, one byte of all of them per step. Unseen words are merged exactly by the tokenizer's ranked pairs.

Defined results: null and empty texts have no ids and decode to the empty text. Rows with one doc_id are encoded
each for itself. An empty table gives an empty lexicon. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import cut_lineage, scratch_folder
from .encoding import Encoder, Ids, Vocabulary, joined, merge_word
from .words import SLICE_BYTES, split_words, text_bytes, text_slices

#: How many words a lexicon holds at most; its size on disk and the driver's work are bounded by this.
LEXICON_WORDS = 50_000
#: Longer words are left to merging, so that looking up takes a bounded number of steps.
LONGEST_WORD = 64


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n): how often each pre-token occurs in all documents; counted per slice before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in text_slices(batches, "text", 4 * SLICE_BYTES):
            words = split_words(batch.column("text"))
            times = np.bincount(words.ids, minlength=len(words.vocabulary)).tolist()
            counts: dict[str, int] = {}
            for part, n in zip(words.vocabulary.to_pylist(), times):
                for word in encoder.pre_tokens(part) or ():
                    counts[word] = counts.get(word, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Transducer:
    """The compiled arrays. Arcs are sorted by state and byte, ``key`` = state * 256 + byte."""

    NAMES = ("key", "target", "skipped", "final", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays

    @classmethod
    def compile(cls, entries: dict[bytes, tuple[int, ...]]) -> Transducer:
        """From words to ids; words are added in order, and a finished state is replaced by an equal one."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        targets: list[tuple] = []  # of each state: whether it accepts, then (byte, state) pairs
        accepted: list[int] = []  # of each state: the words from there on

        def freeze(node: list) -> int:
            form = (node[0], *node[1])
            state = register.get(form)
            if state is None:
                state = register[form] = len(targets)
                targets.append(form)
                accepted.append(int(node[0]) + sum(accepted[t] for _, t in node[1]))
            return state

        path = [[False, []]]  # unfinished states from the root: accepting, finished arcs
        last = b""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            for k in range(len(last), shared, -1):
                state = freeze(path.pop())
                path[-1][1].append((last[k - 1], state))
            path.extend([False, []] for _ in word[shared:])
            path[-1][0] = True
            last = word
        for k in range(len(last), 0, -1):
            state = freeze(path.pop())
            path[-1][1].append((last[k - 1], state))
        root = freeze(path.pop())
        if root != len(targets) - 1:
            raise AssertionError("the root is the last state")
        arcs = []
        for state, (accepts, *out) in enumerate(targets):
            before = int(accepts)
            for byte, target in out:
                arcs.append((state * 256 + byte, target, before))
                before += accepted[target]
        table = np.array(sorted(arcs), np.int64).reshape(-1, 3)
        sizes = np.array([len(entries[w]) for w in words], np.int64)
        return cls(
            {
                "key": table[:, 0].copy(), "target": table[:, 1].copy(), "skipped": table[:, 2].copy(),
                "final": np.array([t[0] for t in targets], np.int64),
                "starts": np.concatenate([[0], np.cumsum(sizes)]),
                "ids": np.array([i for w in words for i in entries[w]], np.int64),
            }
        )

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.arrays[n]) for n in self.NAMES], np.int64)
        return b"".join(x.astype("<i8").tobytes() for x in (sizes, *(self.arrays[n] for n in self.NAMES)))

    @classmethod
    def open(cls, path: str) -> Transducer:
        """Maps the file into memory; nothing is read before it is needed."""
        every = np.memmap(path, "<i8", "r")
        ends = len(cls.NAMES) + np.concatenate([[0], np.cumsum(every[: len(cls.NAMES)])])
        return cls({n: every[s:e] for n, s, e in zip(cls.NAMES, ends, ends[1:])})

    def find(self, words: list[bytes]) -> np.ndarray:
        """For each word its place in the sorted list, or -1."""
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        return self.find_bytes(np.frombuffer(b"".join(words), np.uint8), bounds)

    def find_bytes(self, letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The same for words letters[bounds[i]:bounds[i + 1]]."""
        key, target, skipped, final = (self.arrays[n] for n in self.NAMES[:4])
        sizes = np.diff(bounds)
        place = np.zeros(len(sizes), np.int64)
        state = np.full(len(sizes), len(final) - 1)
        alive = np.nonzero(sizes <= LONGEST_WORD)[0]
        state[sizes > LONGEST_WORD] = -1
        front = bounds[:-1]
        for k in range(LONGEST_WORD):
            alive = alive[(sizes[alive] > k) & (state[alive] >= 0)]
            if not len(alive) or not len(key):
                break
            wanted = state[alive] * 256 + letters[front[alive] + k]
            arc = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            hit = key[arc] == wanted
            state[alive] = np.where(hit, target[arc], -1)
            place[alive] += np.where(hit, skipped[arc], 0)
        ends = (state >= 0) & (final[np.maximum(state, 0)] == 1)
        if not len(key):
            ends &= sizes == 0
        return np.where(ends, place, -1)

    def ids_at(self, place: int) -> tuple[int, ...]:
        starts = self.arrays["starts"]
        return tuple(self.arrays["ids"][starts[place] : starts[place + 1]].tolist())


def build_lexicon(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> str:
    """Compiles the ``words`` most frequent words of all documents; returns the name of the file Spark distributes."""
    spark = docs.sparkSession
    vocabulary = Vocabulary.read(tokenizer)
    short = cut_lineage(word_counts(docs, tokenizer).filter(F.octet_length("word") <= LONGEST_WORD), "words")
    best = most_frequent(short, words)
    entries = {r.word.encode("utf-8"): merge_word(r.word, vocabulary) for r in best}
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    return _share(spark, name, Transducer.compile(entries).to_bytes())


def most_frequent(counts: DataFrame, most: int) -> list:
    """The ``most`` rows with the largest n, ties by word. How often each n occurs tells which n is the last to take,
    so hardly more than the wanted rows are ever sent to the driver."""
    taken, last = 0, None
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect():
        if taken + r.words > most:
            last = r.n
            break
        taken, last = taken + r.words, r.n - 1
    if last is None:
        return []
    above = counts.filter(F.col("n") > last).collect()
    return above + counts.filter(F.col("n") == last).orderBy("word").limit(most - len(above)).collect()


def _share(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes a file of bounded size to the shared folder and has Spark give each executor a copy."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/{name}")
    out = path.getFileSystem(conf).create(path)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    spark.sparkContext.addFile(path.getFileSystem(conf).makeQualified(path).toString())
    return name


class LexiconEncoder(Encoder):
    """Looks words up in the transducer and merges what it does not hold."""

    def __init__(self, tokenizer: str, lexicon: Transducer):
        super().__init__(tokenizer)
        self.lexicon = lexicon
        self.unseen = 0

    def word_ids(self, words: pa.Array) -> Ids:
        places = self.lexicon.find_bytes(*text_bytes(words))
        new = np.nonzero(places < 0)[0]
        self.unseen += len(new)
        arrays = self.lexicon.arrays
        held = Ids(arrays["ids"], arrays["starts"])
        places[new] = len(held.bounds) - 1 + np.arange(len(new))
        return joined([held, self.merged(words.take(pa.array(new)))]).take(places)


def encode_texts(docs: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """(doc_id, ids) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LexiconEncoder(tokenizer, Transducer.open(SparkFiles.get(lexicon)))
        for batch in text_slices(batches, "text", 2 * SLICE_BYTES):
            ids, bounds = encoder.ids(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text): the token texts with a blank between, as this tokenizer decodes, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(Vocabulary.read(tokenizer).tokens, pa.large_string())
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            texts = decoded(lists.flatten().to_numpy(), bounds, tokens).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id long, text string")


def decoded(ids: np.ndarray, bounds: np.ndarray, tokens: pa.Array) -> pa.Array:
    """The texts of ids[bounds[i]:bounds[i + 1]]."""
    spelled = tokens.take(pa.array(ids.astype(np.int32)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spelled), pa.scalar(" ", pa.large_string()))


def round_trip(docs: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """Encodes and decodes whole texts in one pass; what comes back are counts and digests, not the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LexiconEncoder(tokenizer, Transducer.open(SparkFiles.get(lexicon)))
        tokens = pa.array(encoder.vocabulary.tokens, pa.large_string())
        for batch in text_slices(batches, "text"):
            ids, bounds = encoder.ids(batch.column("text"))
            ids = ids.astype("<u4")
            ends = bounds.tolist()
            parts = [ids[s:e] for s, e in zip(ends, ends[1:])]
            texts = decoded(ids, bounds, tokens)
            letters = memoryview(texts.buffers()[2] or b"")
            cuts = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(bounds)),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in parts]),
                    pa.array([hashlib.sha256(letters[s:e]).hexdigest() for s, e in zip(cuts, cuts[1:])]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
