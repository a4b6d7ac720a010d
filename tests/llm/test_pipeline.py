"""The pipeline on planted documents, stage by stage against brute force."""

import random

import pytest

import corpus_pipeline
from brute import near_components, packed_well, repeated_bytes
from test_edges import DOCS, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, toxic = [(i, prose(i, 120)) for i in range(200)], {}
    rows += [(400 + i, " ".join(f"{w}{w[0]}{k}###%%%" for k, w in enumerate(prose(900 + i, 150).split()))) for i in range(5)]
    for i in range(500, 700):
        words = prose(2000 + i, 90).split(" ")
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            words.insert(rng.randrange(len(words)), "grimble")
        rows.append((i, " ".join(words)))
    rows += [(700 + i, rows[i][1] + " and a tail") for i in range(5)]
    shared = prose(77, 40)
    rows += [(800 + i, prose(3000 + i, 80) + " " + shared + " " + prose(4000 + i, 40)) for i in range(6)]
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), dict(rows), toxic


def test_stages(spark, folder, tmp_path):
    path, rows, toxic = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "toxicity", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"
    ]
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.toPandas())
    left = [set(x["doc_id"]) for x in kept[:4]]
    assert set(rows) - left[0] == set(range(400, 405))
    assert left[0] - left[1] == {i for i, y in toxic.items() if y}
    texts = sorted((i, rows[i]) for i in left[1])
    assert left[2] == {i for i, (_, c) in near_components(texts).items() if i == c} and left[1] - left[2] == set(range(700, 705))
    assert left[3] == left[2]
    want = repeated_bytes(sorted((i, rows[i]) for i in left[2]), 100)
    now = kept[3].set_index("doc_id")
    assert {i: len(now.loc[i, "text"]) for i in left[3]} == {i: n - gone for i, (n, gone, _, _) in want.items()}
    assert (now["n_chars"] == now["text"].str.len()).all() and sum(gone for _, gone, _, _ in want.values()) > 0
    packed_well(kept[4], [(i, now.loc[i, "text"]) for i in now.index])


def test_run(spark, folder):
    path, rows, toxic = folder
    packed = corpus_pipeline.run(spark, path)
    assert packed.select("doc_id").distinct().count() == len(rows) - 5 - sum(toxic.values()) - 5
