"""The registered corpus queries on the smallest tables: against DuckDB, the tokenizers library, or brute force."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from brute import document_rows, packed_well, repeated_bytes, tokenizer
from check_oracles import connect, rows
from conftest import SF
from sensitext.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLES[name]).df())


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op1_multiple_instance"](spark, folder).toPandas()
    assert scored["doc_id"].is_unique and len(scored) == pq.read_metadata(f"{folder}/documents.parquet").num_rows
    assert scored["score"].between(0, 1).all() and (scored["predicted"] == (scored["score"] >= 0.5)).all()
    assert scored["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored["doc_id"]]
    labelled = scored.merge(pq.read_table(f"{folder}/labels.parquet").to_pandas(), on="doc_id")
    away = labelled[labelled["held_out"]]
    assert (away["predicted"] == away["toxic"]).mean() > 0.95
    assert away[away["toxic"] == 0]["predicted"].mean() < 0.02 and away[away["toxic"] == 1]["predicted"].mean() > 0.7


def test_encoding_is_the_library_s(spark):
    got = QUERIES["op5_transducer_lexicon"](spark, SF).toPandas().set_index("doc_id")
    for doc_id, text in document_rows():
        ids = tokenizer().encode(text, add_special_tokens=False).ids
        decoded = tokenizer().decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert tuple(got.loc[doc_id]) == want


def test_packing(spark):
    got = QUERIES["op6_length_histogram"](spark, SF).toPandas()
    packed_well(got, document_rows())


def test_neighbours(spark):
    vectors = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    every = np.stack(vectors["embedding"]).astype(np.float64)
    ids = vectors["vec_id"].to_numpy()
    got = QUERIES["op8_multi_index_hashing"](spark, SF).toPandas()
    found = wanted = 0
    for at in np.nonzero(ids % 100 == 0)[0]:
        apart = np.sqrt(((every - every[at]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, apart)) if i != at][:10]
        own = got[got["query_id"] == ids[at]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(best) + 1))
        by_id = dict(zip(ids, apart))
        assert np.allclose(own["score"], [by_id[i] for i in own["vec_id"]], rtol=1e-12)
        assert own["score"].is_monotonic_increasing and ids[at] not in set(own["vec_id"])
        found, wanted = found + len(set(own["vec_id"]) & set(ids[best])), wanted + len(best)
    assert found / wanted >= 0.9


def test_repeated_passages(spark):
    got = QUERIES["op10_interval_expansion"](spark, SF).toPandas().set_index("doc_id")
    want = repeated_bytes(document_rows(), 100)
    assert {i: tuple(r) for i, r in got.iterrows()} == want
    assert sum(n for _, n, _, _ in want.values()) > 0
