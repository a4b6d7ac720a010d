"""The manifest, the compression classifier and the tokenizer alignment: brute force, held-out accuracy, edge cases."""

import bisect
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from brute import document_rows
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sensitext.llm import alignment, compression, manifest
from sensitext.llm.queries import QUERIES

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, score string"
ODD = ["", None, " ", "a", "<|endoftext|><s></s><unk>", "x" * 5000, "ab  \n\t c", "naïve Straße 日本語 🙂 ▁ ▁▁", "\x00\x01", " " * 3000, "é" * 700,
       "don't I'LL 1234567 ...!!", "   x", "\r\n\r\n", "Ωмир", "<0x41>", "the same text", "the same text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """{(doc_id, leaf)} -> rows of results, from whole lists; rows are (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha(*last[k : k + 2]) for k in range(0, len(last), 2)])
        return levels

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    levels = {x: climb([leaf(r) for r in trees[x]]) for x in langs}
    top = climb([levels[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, row in enumerate(trees[x]):
            path = []
            for tree, at in ((levels[x], i), (top, k)):
                for level in tree[:-1]:
                    path.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else ""))
                    at >>= 1
            shown = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                shown = (*row[:3], row[3] + 1, row[4])
            node = leaf(shown)
            for right, other in path:
                node = sha(other, node) if right else sha(node, other)
            proof = sha(*(other for _, other in path))
            out.append((row[0], leaf(row), levels[x][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def judged(spark, rows, bits):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "own leaf", "own score") for r in rows], DOCS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    got = manifest.verified_manifest(manifest.document_leaves(docs, tampered), bits)
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


def test_manifest_of_odd_rows(spark):
    rows = [(i, f"s{i % 2}", ("en", None, "", "日", "fr")[min(i % 9, 4)], i, "t" * (i % 3)) for i in range(45)]
    rows += [(7, "s", "en", None, None), (7, "s", "en", None, None), (None, None, None, None, None), (None, "s", "en", 2**63 - 1, "x")]
    rows += [(-5, "s", "en", 3, "z" * 100_000), (14, "s", "one", 1, "alone")]
    assert in_order(judged(spark, rows, 2)) == in_order(plain_manifest(rows))


def test_manifest_of_one_row_and_of_none(spark):
    row = (3, "s", "en", 1, "x")
    assert in_order(judged(spark, [row], 8)) == in_order(plain_manifest([row]))
    assert judged(spark, [], 8) == []


def test_manifest_shows_every_change(spark):
    got = QUERIES["op11_nested_rollup"](spark, SF).toPandas()
    chars = dict(zip(*(pq.read_table(f"{SF}/documents.parquet")[c].to_pylist() for c in ("doc_id", "n_chars"))))
    changed = [zlib.crc32(str(i).encode()) % 7 == 0 and chars[i] is not None for i in got["doc_id"]]
    assert got["root"].nunique() == 1 and (~got["verified"]).tolist() == changed and sum(changed)


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op12_compression_classifier"](spark, folder).toPandas()
    assert len(scored) == pq.read_metadata(f"{folder}/documents.parquet").num_rows
    assert scored["score"].between(0, 1).all() and (scored["predicted"] == (scored["score"] >= 0.7)).all()
    assert scored["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in scored["doc_id"]]
    away = scored[scored["held_out"]].merge(pq.read_table(f"{folder}/labels.parquet").to_pandas(), on="doc_id")
    assert away[away["quality"] == 1]["predicted"].mean() > 0.98 and away[away["quality"] == 0]["predicted"].mean() < 0.1


def labelled(spark, n=240):
    words = "the of and river house letter green window".split()
    good = [" ".join(words[(i * k + k) % 8] for k in range(60)) for i in range(n)]
    bad = ["".join("|#$"[(i + k * k) % 3] for k in range(200)) for i in range(n)]
    docs = [(2 * i + q, text) for i in range(n) for q, text in ((1, good[i]), (0, bad[i]))]
    return docs, [(i, i % 2) for i, _ in docs]


def test_scores_are_the_plain_formula(spark):
    docs, labels = labelled(spark)
    frame = spark.createDataFrame([(i, t, 9.0, "x") for i, t in docs] + [(None, None, 1.0, "y"), (1, "", 1.0, "z")], "doc_id long, text string, score double, lang string")
    model = compression.train_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.good and model.bad
    got = compression.score_quality(frame, model).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "score"}
    import zstandard

    for row in got:
        data, sizes = (row.text or "").encode(), []
        for content in (model.good, model.bad):
            way = zstandard.ZstdCompressor(
                level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False
            )
            sizes.append(sum(len(way.compress(data[s : s + 1024])) - len(way.compress(b"")) for s in range(0, len(data), 1024)))
        apart, length = (sizes[1] - sizes[0]) / (len(data) + 16), np.log(len(data) + 16)
        z = float(np.dot([apart, length, apart * length, 1], model.weights))
        assert row.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-9)
        if row.doc_id is not None and row.text:
            assert (row.score >= 0.7) == (row.doc_id % 2 == 1)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (2, 1)], [(None, 1), (1, None)], [(1, 0), (1, 1)], [(999, 1)]])
def test_few_labels_give_one_score(spark, labels):
    frame = spark.createDataFrame([(1, "a"), (2, None), (2, "b" * 100_000)], "doc_id long, text string")
    model = compression.train_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = {r.score for r in compression.score_quality(frame, model).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1
    none = frame.filter("doc_id > 5")
    assert compression.score_quality(none, compression.train_quality(none, spark.createDataFrame(labels, "doc_id long, quality int"))).count() == 0


def test_the_sample_is_bounded_by_rows_and_bytes(spark):
    docs, labels = labelled(spark, 40)
    frame = spark.createDataFrame(docs + [(0, "|" * 3_000_000)] * 3, "doc_id long, text string")
    learning = compression.Learning(documents=30, total_bytes=6_000, largest=2_000)
    model = compression.train_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int"), learning)
    assert len(model.good) + len(model.bad) < 8_000


def plain_alignment(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha) from the libraries, one token after the other."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(alignment.BYTE_LETTERS)}
    known = []
    for text in texts:
        groups = []
        if text:
            a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in two.encode(text) for p in [two.id_to_piece(i)]]
            plain = (" " + text).encode()
            if b"".join(x for _, x in a) == plain == b"".join(x for _, x in b):
                ends = []
                for tokens in (a, b):
                    at, own = 0, []
                    for _, x in tokens:
                        at += len(x)
                        own.append(at)
                    ends.append(own)
                i = j = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    m, n = bisect.bisect_right(ends[0], cut), bisect.bisect_right(ends[1], cut)
                    groups.append(([x for x, _ in a[i:m]], [x for x, _ in b[j:n]]))
                    i, j = m, n
        known.append(groups)
    count = collections.Counter()
    for groups in known:
        count.update({(x, y) for a, b in groups for x in a for y in b})
    most = collections.Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for groups in known:
        links = [(x, y) for a, b in groups for x in a for y in b]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha(shown) if groups else "",
        ))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_is_the_plain_one(spark):
    got = QUERIES["op13_merge_path"](spark, SF).toPandas().sort_values("doc_id")
    want = plain_alignment([t for _, t in document_rows()])
    assert list(got[NAMES].itertuples(index=False, name=None)) == want


def test_alignment_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "ALIGNED_BYTES", 4000)
    frame = spark.createDataFrame([(i // 2 if i else None, t, 1, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_a int, pairs string")
    got = alignment.cross_aligned(frame, A, B).select("doc_id", *NAMES).collect()
    want = [(i // 2 if i else None, *w) for i, w in enumerate(plain_alignment(ODD))]
    assert in_order(got) == in_order(want)
    assert alignment.cross_aligned(frame.filter("false"), A, B).count() == 0


def test_byte_tokens_are_the_library_s():
    texts = [t for t in ODD if t] + [t for _, t in document_rows() if t]
    tokens = alignment.ByteTokens(A)
    want = [e.ids for e in tokens.library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in tokens.ids(texts)] == want


ENDS = st.sets(st.integers(1, 60), max_size=30).map(lambda s: np.array(sorted(s | {61}), np.int64))


@settings(max_examples=200, deadline=None)
@given(ENDS, ENDS, st.integers(1, 12))
def test_pieces_stitch_to_the_groups_of_one_merge(a, b, piece):
    whole = alignment.align(a, b, 1 << 20)
    cut = alignment.align(a, b, piece)
    assert whole.a.tolist() == cut.a.tolist() and whole.b.tolist() == cut.b.tolist()
    ends = sorted(set(a.tolist()) & set(b.tolist()))
    assert np.cumsum(whole.a).tolist() == [np.searchsorted(a, e) + 1 for e in ends]
    assert np.cumsum(whole.b).tolist() == [np.searchsorted(b, e) + 1 for e in ends]
    i, j = alignment.diagonals(a, b, piece)
    assert (np.diff(i) + np.diff(j) <= piece + 1).all()
