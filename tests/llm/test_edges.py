"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import gzip
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute import TOKENIZER, near_components, packed_well, repeated_bytes, tokenizer
from sensitext.llm import chat, lexicon, minhash, neighbours, packing, quality, suffixes, toxicity, urls, warc
from sensitext.llm.components import components
from sensitext.llm.encoding import Encoder, Vocabulary, merge_word, load

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ("score", "kept", "tag", "stretches", "n_bytes", "n", "node", "key", "label", "word", "class_distance", "sequence_id")


def prose(seed, words):
    rng = random.Random(seed)
    made = ["".join(rng.choice(["an", "er", "to", "mi", "lo", "sa"]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + (".\n" if rng.random() < 0.08 else "") for w in made)


@pytest.fixture(scope="module")
def texts():
    shared = prose(99, 60)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (6, prose(1, 120)), (7, prose(1, 120)),
        (8, prose(1, 120) + " more words at the end"), (9, prose(2, 80) + shared + prose(3, 40)), (10, shared + " É中文😀 " + shared),
        (11, prose(4, 30_000)), (12, "same " * 400), (13, "x" * 5000), (14, "A b c d e"), (15, "a B c d e f"), (16, prose(5, 90) + shared),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, "s", None if t is None else len(t)) for i, t in rows], DOCS)


def clashing(df):
    return df.withColumns({c: F.lit("other") for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- quality rules


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, docs, texts, nothing):
    got = quality.quality_rules(clashing(docs.filter("doc_id != 11"))).toPandas().set_index("doc_id")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for i, text in texts:
        if i != 11:
            assert tuple(got.loc[i, names]) == plain_quality(text), i
    assert not got[got["base_failed"]]["kept"].any()
    assert quality.quality_rules(nothing).count() == 0


def test_divergence_rejects_what_no_language_resembles(spark):
    good = [(i, prose(i, 300)) for i in range(40)]
    odd = [(100, " ".join(f"{w}{w[0]}{k}###%%%" for k, w in enumerate(prose(100, 150).split()))), (101, prose(101, 150).upper().replace(" ", "!! "))]
    got = quality.quality_rules(frame(spark, good + odd)).toPandas().set_index("doc_id")
    assert got.loc[range(40), "kept"].all()
    assert not got.loc[[100, 101], "kept"].any() and not got.loc[[100, 101], "base_failed"].any()
    same = np.array([[5, 0, 5], [0, 9, 0], [0, 0, 0]])
    assert quality.js_distance(same, np.array([1.0, 0, 1])) == pytest.approx([0, 1, 0])


def test_no_language_is_lost_among_many(spark):
    cyrillic, greek = (str.maketrans("aeimlnorst", letters) for letters in ("аеимлнорст", "αειμλνορστ"))
    rows = [(i, f"l{i}", prose(i, 200)) for i in range(70)] + [(100, "ru", prose(100, 150).translate(cyrillic)), (101, "el", prose(101, 60).translate(greek))]
    rows += [(200 + i, "l0", prose(200 + i, 300)) for i in range(30)]
    rows += [(102, "l0", " ".join(f"{w}{w[0]}{k}###%%%" for k, w in enumerate(prose(102, 150).split())))]
    many = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, lang, t in rows], DOCS)
    assert {r.doc_id for r in quality.quality_rules(many).filter("not kept").collect()} == {102}
    limits = quality.Limits(language_share=0.005)  # Greek has less, and its one document is judged by the base rules
    references = quality.language_references(many, limits)
    assert {r["lang"] for r in references} == {lang for _, lang, _ in rows} - {"el"}
    got = {r.doc_id: r for r in quality.judge_quality(many, references, limits).collect()}
    assert {i for i, r in got.items() if not r.kept} == {102} and not any(r.base_failed for r in got.values())
    assert got[100].class_distance == 0 and got[101].word_distance > limits.max_word_distance


# --- toxicity


def toxic_fixture(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        said = prose(1000 + i, 80).split(" ")
        if i % 4 == 0:
            said.insert(rng.randrange(len(said)), rng.choice(["vilewort", "vilewoman", "grimble"]))
        rows.append((i, " ".join(said)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(3, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    return frame(spark, rows), labels


def test_toxicity(spark, docs, nothing):
    train, labels = toxic_fixture(spark)
    model = toxicity.train_toxicity(clashing(train), labels)
    asked = frame(spark, [(1, None), (2, ""), (3, prose(7, 50)), (4, prose(8, 50) + ". You grimble you. " + prose(9, 20)), (4, "Vilewort!")])
    got = toxicity.score_toxicity(clashing(asked), model).orderBy("doc_id", F.length("text")).toPandas()
    assert got["score"].between(0, 1).all() and got.columns.tolist().count("score") == 1
    assert (got["score"] >= 0.5).tolist() == [False, False, False, True, True]
    assert got["score"][0] == got["score"][1] == pytest.approx(model.leak)
    found = toxicity.locate_toxic(asked, model).collect()
    assert len(found) == 2 and all(re.search("grimble|Vilewort", r.text) for r in found)
    whole = {4: [r.text for r in asked.filter("doc_id = 4").collect()]}
    assert all(any(t[r.start : r.end] == r.text for t in whole[4]) for r in found)
    assert toxicity.score_toxicity(nothing, model).count() == 0
    none = toxicity.train_toxicity(nothing, labels)
    assert none.weights == {} and 0 < none.leak < 0.5
    assert toxicity.score_toxicity(docs, none).filter("score >= 0.5").count() == 0


# --- near duplicates


def test_near_duplicates(spark, docs, texts, nothing):
    got = minhash.near_duplicates(clashing(docs)).toPandas().set_index("doc_id")
    want = near_components(texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.iterrows()} == want
    assert (got["kept"] == (got.index == got["component_id"])).all()
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_in_chains_and_without_ids(spark):
    words = prose(50, 400).split()
    # Each text has 12 other words than the one before: neighbours are linked, distant ones are not.
    chain = [(i, " ".join([f"v{k}" if k < 12 * i else w for k, w in enumerate(words)])) for i in range(12)]
    rows = [*chain, (30, chain[0][1]), (30, chain[0][1]), (31, prose(60, 50)), (None, chain[0][1])]
    got = minhash.near_duplicates(frame(spark, [(i if i is not None else 0, t) for i, t in rows[:-1]]).union(
        frame(spark, [(1, rows[-1][1])]).withColumn("doc_id", F.lit(None).cast("long"))
    )).toPandas()
    want = near_components(chain)
    known = got[got["doc_id"].notna()].drop_duplicates("doc_id").set_index("doc_id")
    assert {i: known.loc[i, "component_id"] for i, _ in chain} == {i: c for i, (_, c) in want.items()}
    assert len({c for _, c in want.values()}) == 1
    assert (got[got["doc_id"] == 30]["component_id"] == 0).all() and known.loc[31, "component_id"] == 31
    missing = got[got["doc_id"].isna()]
    assert missing["component_id"].isna().all() and missing["kept"].all() and len(got) == len(rows)


@pytest.mark.parametrize("rows", [2, 10_000])
def test_bucket_links_join_what_shares_a_bucket(spark, rows):
    rng = random.Random(rows)
    bands = {i: [rng.randrange(2**62), 7 if i % 3 == 0 else rng.randrange(2**62), -rng.randrange(25)] for i in range(60)}
    bands |= {100: [-(2**63), 1, 2], 101: [2**63 - 1, 1, 3]}
    whole = {i: {i} for i in bands}
    for i in bands:
        for j in bands:
            if whole[i] is not whole[j] and set(bands[i]) & set(bands[j]):
                whole[i] |= whole[j]
                for k in whole[j]:
                    whole[k] = whole[i]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        links = minhash._bucket_stars(spark.createDataFrame(list(bands.items()), "node long, bands array<long>").repartition(3))
        assert all(set(bands[r.a]) & set(bands[r.b]) for r in links.collect())
        got = {r.node: r.component for r in components(links).collect()}
        assert minhash._bucket_stars(spark.createDataFrame([], "node long, bands array<long>")).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {i: got.get(i, i) for i in bands} == {i: min(w) for i, w in whole.items()}


def test_texts_of_one_id_are_one_document(spark):
    texts = [prose(200 + i, 40) for i in range(6)]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[2]), (3, texts[2]), (9, texts[1]), (4, texts[3]), (8, texts[4]), (8, texts[5])]
    got = minhash.near_duplicates(frame(spark, rows)).select("doc_id", "component_id").distinct().collect()
    assert {tuple(r) for r in got} == {(5, 3), (3, 3), (9, 3), (4, 4), (8, 8)}


def test_filter_of_ids_keeps_all_and_few_others(spark):
    rows = spark.range(-20_000, 20_000).selectExpr("if(id = 7, null, id) as doc_id", "'t' as text")
    ids = spark.range(-3_000, 60_000, 30).selectExpr("id as doc_id")
    kept = [r.doc_id for r in minhash.maybe_among(rows, ids).collect()]
    assert set(range(-3_000, 20_000, 30)) <= set(kept) and len(set(kept)) == len(kept) < 800
    assert minhash.maybe_among(rows, ids.limit(0)).count() == 0


def test_sketches_agree_as_often_as_sets(spark):
    rng = np.random.default_rng(1)
    every = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(every[:2000]), np.sort(every[500:2500])  # similarity 1500 / 2500
    both = minhash.sketches(np.concatenate([a, b, a[:1]]), np.array([0, 2000, 4000, 4001, 4001]), 384)
    assert abs((both[0] == both[1]).mean() - 0.6) < 0.1
    assert (both[2] != 2**64 - 1).all() and (both[3] == 2**64 - 1).all()


def test_components(spark):
    path = [(i, i + 1) for i in range(1, 40)] + [(5, 5), (None, 3), (100, 101), (101, 100), (200, 200)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 200, **{1000 + i: 1000 for i in range(60)}}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


# --- repeated passages


def test_repeated_passages(spark, docs, texts, nothing):
    got = suffixes.remove_repeated(clashing(docs)).toPandas().set_index("doc_id")
    want = repeated_bytes(texts, 100)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.iterrows()} == want
    assert set(CLASHES) - {"n_bytes"} <= set(got.columns) and (got["tag"] == "other").all()
    assert got.loc[7, "text"] == "" and got.loc[6, "text"] == texts[5][1]
    assert suffixes.remove_repeated(nothing).count() == 0


def test_repeated_passages_with_ids_missing_or_shared(spark):
    text = prose(70, 60)
    rows = frame(spark, [(5, text), (5, text), (6, text), (5, prose(71, 60))]).union(
        frame(spark, [(1, text)]).withColumn("doc_id", F.lit(None).cast("long"))
    )
    got = suffixes.remove_repeated(rows).toPandas()
    gone = [(None if pd.isna(i) else int(i), n > 0) for i, n in zip(got["doc_id"], got["n_removed"])]
    assert sorted(gone, key=str) == sorted([(5, False), (5, False), (6, True), (5, False), (None, False)], key=str)


def test_texts_of_one_id_with_like_hashes(spark):
    passage, by_end = prose(72, 40), {}
    made = spark.range(3000).selectExpr("id", "concat('own words ', id) as own")
    hashed = made.selectExpr("own", f"xxhash64(concat('{passage} ', own)) as a", "xxhash64(own) as b").collect()
    for r in hashed:
        by_end[r.a % 65536] = r.own
    alone, beside = next((r.own, by_end[r.b % 65536]) for r in hashed if r.b % 65536 in by_end)
    got = suffixes.remove_repeated(frame(spark, [(1, passage), (7, passage + " " + beside), (7, alone)])).collect()
    assert all(r.n_removed == 0 for r in got if r.text == alone) and sum(r.text == alone for r in got) == 1
    assert sorted(r.n_removed > 0 for r in got) == [False, False, True]


@pytest.mark.parametrize("length,gram", [(20, 6), (30, 7), (100, 24)])
def test_repeated_passages_on_random_letters(spark, length, gram):
    rng = random.Random(length)
    made = []
    for i in range(40):
        letters = "".join(rng.choice("ab" if i % 2 else "abé ") for _ in range(rng.randint(0, 300)))
        if made and rng.random() < 0.6:
            other = rng.choice(made)[1]
            at = rng.randrange(len(other) + 1)
            letters = letters[: rng.randrange(len(letters) + 1)] + other[at : at + rng.randint(length - 5, 3 * length)] + letters
        made.append((i, letters))
    p = suffixes.Passages(length=length, gram=gram, block=4096)
    got = suffixes.remove_repeated(frame(spark, made), p).toPandas().set_index("doc_id")
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.iterrows()} == repeated_bytes(made, length)


def test_a_passage_of_very_many_documents_gets_no_suffix_array(spark, monkeypatch):
    rng = random.Random(8)
    shared, line = prose(98, 60), prose(97, 16)
    assert len(line) < 100 < len(shared)
    made = []
    for i in range(400):  # every text has other bytes beside the passage, some share them in part
        beside = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 160))) for _ in range(3)]
        made.append((i, beside[0] + "zyx"[: i % 4] + shared + "xyz"[: i % 3] + beside[1] + line + beside[2]))
    block, inside = 4096, suffixes.repeated_windows

    def bounded(parts, length):
        assert sum(map(len, parts)) <= 4 * block
        return inside(parts, length)

    monkeypatch.setattr(suffixes, "repeated_windows", bounded)
    records = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = suffixes.remove_repeated(frame(spark, made), suffixes.Passages(block=block)).toPandas().set_index("doc_id")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.iterrows()} == repeated_bytes(made, 100)


def test_tasks_that_meet_settled_rows_only(spark):
    made = [(i, prose(96, 40)) for i in range(4)] + [(9, prose(95, 40))]
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = suffixes.remove_repeated(frame(spark, made).coalesce(1)).toPandas().set_index("doc_id")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.iterrows()} == repeated_bytes(made, 100)


def test_interval_expansion():
    rng = random.Random(3)
    for length in (1, 3, 8, 20):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 200))) for _ in range(6)]
        firsts, starts = suffixes.repeated_windows(parts, length)
        seen = {}
        for part, first, start in zip(parts, firsts, starts):
            for k, place in enumerate(first):
                assert seen.setdefault(part[k : k + length], start + k) == place


# --- encoding and packing

ODD = [
    "a<|endoftext|>b <|ENDOFTEXT|> x</w>", " \x1cab\x1dc d\xa0e\x85f", "İstanbul ΣΑΣ ßẞ don't DON'T it's 12½²³ ªº µ ﬁ 漢字 한글 😀😀 <| <|x|>",
    "\x00\x01 a\x00b", "don't're'll'd'' ''s", "é e ́ ạ́", "x" * 5000, "é" * 500, "Ω Å K ſ ŉ Ŀ ĳ Ŧ", "",
]


def test_encoder_on_odd_texts():
    import pyarrow as pa

    vocabulary = Vocabulary.read(TOKENIZER)
    library = load(TOKENIZER)
    for encoder in (Encoder(TOKENIZER), Encoder(TOKENIZER, lambda words: [merge_word(w, vocabulary) for w in words])):
        ids, bounds = encoder.ids(pa.array([*ODD, None]))
        for i, text in enumerate([*ODD, ""]):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_transducer_shares_and_finds():
    rng = random.Random(2)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 7))): (i, i + 1) for i in range(500)}
    made = lexicon.Transducer.compile(words)
    assert made.find(sorted(words)).tolist() == list(range(len(words)))
    assert all(made.ids_at(k) == words[w] for k, w in enumerate(sorted(words)))
    assert set(made.find([b"", b"zz", b"abcabcabcabc", b"a" * 100]).tolist()) == {-1}
    many = lexicon.Transducer.compile({f"{a}ing".encode(): (1,) for a in ("walk", "talk", "sing", "ring", "do")})
    assert len(many.arrays["final"]) < 15
    assert lexicon.Transducer.compile({}).find([b"", b"a"]).tolist() == [-1, -1]


def test_encoding(spark, docs, texts, nothing):
    rows = clashing(docs.union(frame(spark, [(20 + i, t) for i, t in enumerate(ODD)])))
    name = lexicon.build_lexicon(rows, TOKENIZER, 200)
    encoded = lexicon.encode_texts(rows, TOKENIZER, name)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    decoded = {r.doc_id: r.text for r in lexicon.decode_ids(encoded, TOKENIZER).collect()}
    short = {r.doc_id: r for r in lexicon.round_trip(rows, TOKENIZER, name).collect()}
    for i, text in [*texts, *((20 + i, t) for i, t in enumerate(ODD))]:
        ids = tokenizer().encode(text or "", add_special_tokens=False).ids
        assert got[i] == ids and short[i].n_tokens == len(ids)
        assert decoded[i] == tokenizer().decode(ids, skip_special_tokens=False)
        assert short[i].decoded_sha256 == hashlib.sha256(decoded[i].encode()).hexdigest()
    empty = lexicon.build_lexicon(nothing, TOKENIZER)
    assert lexicon.round_trip(nothing, TOKENIZER, empty).count() == 0
    assert lexicon.round_trip(docs, TOKENIZER, empty).count() == len(texts)


def test_packing(spark, docs, texts, nothing):
    packed_well(packing.pack_documents(clashing(docs), TOKENIZER).toPandas(), texts)
    assert packing.pack_documents(nothing, TOKENIZER).count() == 0
    twice = packing.pack_documents(docs.union(docs), TOKENIZER)
    assert twice.count() == 2 * packing.pack_documents(docs, TOKENIZER).count()
    assert twice.groupBy("sequence_id", "offset").count().filter("count > 1").count() == 0
    placed = packing.best_fit(packing.cut_pieces(docs, TOKENIZER, 64, 0, with_ids=True), 64)
    whole = {r.sequence_id: r.ids for r in packing.packed_sequences(placed).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_plans_hold_every_piece():
    rng = random.Random(4)
    for _ in range(150):
        room = rng.choice([10, 50, 2048])
        histogram = {rng.randint(1, room): rng.randint(1, 500) for _ in range(rng.randint(1, 60))}
        held = {}
        for group in packing.plan(histogram, room):
            used = 0
            for length, times, offset in group.pieces:
                assert offset == used
                used += length * times
                held[length] = held.get(length, 0) + times * group.many
            assert used + group.free == room and group.many > 0
        assert held == histogram
    assert packing.plan({}, 10) == []


# --- chat formatting


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "hi \\ <|im_end|>\n<|im_start|>x", 1.0), (1, 2, 1, "assistant", "a <| <\\| \\", 2.0),
        (1, 3, 1, "assistant", "better", 5.0), (1, 4, 3, "user", None, None), (1, 5, 3, "a\nb<|", "tie", 0.0),
        (2, 1, 9, "user", "orphan", 0.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (3, 3, 2, "user", "cycle", 0.0),
        (4, 1, None, None, "", 0.0), *((5, k, k - 1 if k else None, "user" if k % 2 else "assistant", f"t{k}", 0.0) for k in range(70)),
    ]
    trees = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    paths = chat.root_to_leaf_paths(trees)
    listed = {}
    for r in paths.orderBy("tree", "leaf", F.desc("above")).collect():
        listed.setdefault((r.tree, r.leaf), []).append(r.node)
    assert listed == {(1, 2): [1, 2], (1, 4): [1, 3, 4], (1, 5): [1, 3, 5], (2, 1): [1], (4, 1): [1], (5, 69): list(range(70))}
    ranked = {(r.tree, r.leaf): r.branch_rank for r in chat.ranked_branches(trees, paths, 3).collect() if r.tree == 1}
    assert ranked == {(1, 4): 1, (1, 5): 2, (1, 2): 3}
    made = chat.format_conversations(trees.withColumns({c: F.lit("other") for c in ("turns", "formatted", "above", "up", "head", "label")}))
    read = made.select("tree", "leaf", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {(r.tree, r.leaf): r for r in read.collect()}
    assert set(got) == {(1, 4), (2, 1), (4, 1), (5, 69)}
    assert [(t.role, t.text) for t in got[1, 4].turns] == [("user", rows[0][4]), ("assistant", "better"), ("user", "")]
    assert got[1, 4].loss == "better" and got[1, 4].formatted.count("<|im_start|>") == 3
    assert [(t.role, t.text) for t in got[4, 1].turns] == [("", "")]
    assert got[5, 69].loss == "".join(f"t{k}" for k in range(0, 70, 2))
    every = chat.format_paths(trees, paths)
    other = {r.leaf: r for r in every.filter("tree = 1").select("leaf", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in other[5].turns][-1] == ("a\nb<|", "tie") and other[2].turns[1].text == "a <| <\\| \\"


def test_best_branch_of_scores_that_no_two_sums_agree_on(spark):
    rows = [(t, k, None if k == 0 else 0 if k < 3 else k - 2, [0.1, 0.2, 0.7, 0.3, 0.4][k]) for t in range(50) for k in range(5)]
    trees = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    paths = chat.root_to_leaf_paths(trees)
    got = {r.tree: (r.leaf, round(r.branch_score, 9), r.branch_rank) for r in chat.ranked_branches(trees, paths).collect()}
    assert got == {t: (4, 1.2, 1) for t in range(50)}
    # As if the parts of a sum came in another order each time it is evaluated.
    shaken = F.udf(lambda score: score + random.SystemRandom().random() * 1e-9, "double").asNondeterministic()
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = chat.ranked_branches(trees.withColumn("score", shaken("score")), paths).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted((r.tree, r.leaf) for r in got) == [(t, 4) for t in range(50)]


def test_turns_with_nulls_and_repetitions(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "assistant", "b"), (2, 1, "assistant", "x" * 100_000)]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(chat.turns_in_order(clashing(said)))
    got = {r.tree: r.turns for r in made.select("tree", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in got[1]] == [("", ""), ("user", "a"), ("user", "a")] and len(got[2][0].text) == 100_000
    assert [(t.role, t.text) for t in got[None]] == [("assistant", "b")] and len(got) == 3
    assert chat.format_conversations(chat.turns_in_order(said.limit(0))).count() == 0


# --- URL filters


def test_urls(spark):
    link = '<html><LINK rel="canonical" href="{}"></html>'
    rows = [
        (1, "http://A.Example.org/es/x?q", None), (2, "https://example.org/en/12#f", ""), (3, "http://example.org", None), (4, None, link.format("http://x.com/de/")),
        (5, "no url", None), (6, "http://b.net/p", link.format("http://x.com/de/1")), (7, "http://c.net/p", '<meta http-equiv="refresh" content="0; url=http://b.net/p">'),
        (8, "http://d.net/p", link.format("/q")), (9, "http://d.net/q", link.format("http://x.com/de/2")), (10, "http://e.net/q", link.format("http://x.com/fr/2")),
        (11, "http://e.net/q", link.format("http://x.com/de/3")), (12, "http://f.net/a/b", link.format("c")), (13, "http://f.net/a/c", None), (13, "http://f.net/a/c", None),
        (14, "http://example.org/es/", link.format("http://g.net/")), (15, "http://g.net/", None), (16, "://h.com/fr/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = urls.rule_table(spark, [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")])
    got = urls.judge_urls(clashing(pages), rules, urls.page_links(pages)).collect()
    by_id = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert by_id[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and by_id[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by_id[3] == ("example.org", "", None, "allow") and by_id[4] == by_id[5] == ("", "", None, "allow")
    assert [by_id[i][3] for i in (6, 7, 8, 9, 10, 11, 12, 13, 15)] == ["block"] * 4 + ["allow"] * 4 + ["block"]
    assert by_id[16] == ("h.com", "/fr/", "com/fr/", "allow")
    assert urls.judge_urls(pages.limit(0), rules, urls.page_links(pages.limit(0))).count() == 0
    assert urls.judge_urls(pages, urls.rule_table(spark, []), urls.page_links(pages), "block").filter("verdict = 'block'").count() == len(rows)


def test_very_long_hosts_meet_their_rules(spark):
    long = "a." * 50_000
    rows = [(1, f"http://{long}example.org/es/x", None), (2, f"http://{long}com", None), (3, "http://" + "." * 50_000, None), (4, f"http://{long}.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = urls.rule_table(spark, [("allow", "org/"), ("block", "example.org/es/")])
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, rules, urls.page_links(pages)).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: ("org/", "allow")}


# --- WARC


def test_warc(spark, tmp_path):
    big = "<p>" + prose(1, 60)
    rows = [(5, "http://x/ä b\n", big), (3, None, big), (9, "u", big), (9, "u", big), (3, "v", big), (1, "w", None), (2, "w", ""), (4, "q", "short"), (6, "q", "short"),
            (None, "n", big + "!"), (None, "n", big + "!"), (7, "l", "z" * 3_000_000), (8, "r\r\n\r\n", "a\r\n\r\nWARC/1.1\r\n")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    layout = warc.Layout(shard_bytes=2000, roll_bytes=500, cells=8)
    manifests = [warc.write_warc(pages.repartition(n), str(tmp_path / str(n)), layout) for n in (1, 3)]
    first, second = (sorted((r.file, r.records, r.bytes, r.sha256) for r in m.collect()) for m in manifests)
    assert first == second and len(first) > 2  # equal files, however the pages were dealt out
    assert sorted(p.name for p in (tmp_path / "1").glob("*.gz")) == [f for f, *_ in first] and not list((tmp_path / "1" / "_temporary").iterdir())
    got = warc.read_warc(manifests[0], str(tmp_path / "1")).collect()
    assert sorted((r.page_id or 0, r.url or "") for r in got) == sorted((i or 0, u or "") for i, u, _ in rows)
    by_html = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    for r in got:
        payload = by_html[r.payload_digest]
        assert r.payload_bytes == len(payload) and r.payload == (payload if r.record_type == "response" else None)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.payload_bytes >= 100 and r.page_id != 7)
    assert kinds == [(0, "response", None), (0, "revisit", None), (3, "response", None), (3, "revisit", 3), (5, "revisit", 3), (9, "revisit", 3), (9, "revisit", 3)]
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
    with gzip.open(tmp_path / "1" / first[0][0]) as file:
        assert file.read().startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert warc.read_warc(warc.write_warc(pages.limit(0), str(tmp_path / "none")), str(tmp_path / "none")).count() == 0


# --- nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    made = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(60)]
    copies = [(100 + i, made[0][1]) for i in range(30)]
    bad = [(200, None), (300, [0.0] * 8), (400, [1.0, None, *[0.0] * 6]), (500, [float("nan")] * 8), (600, [float("inf")] * 8), (700, [1.0] * 5), (None, made[1][1])]
    rows = spark.createDataFrame(made + copies + bad + [made[3]], "vec_id long, embedding array<float>")
    for slices in (200_000, 7):
        got = neighbours.nearest(clashing(rows), F.col("vec_id") % 20 == 0, neighbours.Search(slice=slices)).toPandas()
        every = {i: np.array(v) for i, v in made + copies}
        assert set(got["query_id"]) == {i for i in every if i % 20 == 0}
        found = wanted = 0
        for query, own in got.groupby("query_id"):
            own = own.sort_values("rank")
            best = sorted((float(np.sqrt(((v - every[query]) ** 2).sum())), i) for i, v in every.items() if i != query)[:10]
            assert own["rank"].tolist() == list(range(1, 11))
            assert np.allclose(own["score"], [np.sqrt(((every[i] - every[query]) ** 2).sum()) for i in own["vec_id"]])
            found, wanted = found + len(set(own["vec_id"]) & {i for _, i in best}), wanted + 10
            if query in (0, 100, 120):  # ties: the smallest ids of the copies
                assert own["vec_id"].tolist() == [i for i in (0, *range(100, 130)) if i != query][:10]
        assert found / wanted >= 0.9
    few = neighbours.nearest(rows.filter("vec_id < 5"), F.col("vec_id") == 0).toPandas()
    assert few.sort_values("rank")["rank"].tolist() == [1, 2, 3, 4]
    assert neighbours.nearest(rows.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(rows.filter("vec_id >= 200"), F.lit(True)).count() == 0


def test_one_row_of_equal_rows(spark):
    rows = [(1, "a", "en", "t", 2), (1, "a", "en", "s", 1), (1, "b", "en", "s", 1), (None, "a", None, None, None), (None, "a", None, None, None), (2, None, "x", "y", 3), (2, None, "x", "y", 3), (3, "", "x", "y", 4)]
    docs = spark.createDataFrame(rows, DOCS)
    got = minhash.one_of_each(docs)
    assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, {*rows} - {rows[0]}))
    assert minhash.one_of_each(docs.limit(0)).count() == 0
