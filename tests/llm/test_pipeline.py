import numpy as np
import pytest

import corpus_pipeline
from oddsgraph.llm import secrets
from oddsgraph.llm.tokens import Encoder, byte_bpe
from tests.llm.test_decontaminate import best_windows
from tests.llm.test_near_copies import roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows each stage returns, by name, and the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, SF)
        if name != "packing":
            assert frame.columns == docs.columns
        rows = frame.collect()
        docs = spark.createDataFrame(rows, frame.schema)
        out[name] = rows
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_language(stages):
    docs = stages["documents"]
    assert set(stages["language"]) <= set(docs) and len(stages["language"]) >= 0.97 * len(docs)


def test_near_duplicates(stages):
    """Of each group of texts linked by an exact five-word similarity of 0.8 or more the smallest id stays."""
    kept = set(roots([(r.doc_id, r.text or "") for r in stages["language"]]).values())
    assert len(kept) < len(stages["language"]) and ids(stages["near_duplicates"]) == sorted(kept)


def test_decontamination(spark, stages):
    rows = stages["near_duplicates"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in best_windows([(r.doc_id, r.text) for r in rows], items)}
    assert bad and ids(stages["decontamination"]) == sorted(r.doc_id for r in rows if r.doc_id not in bad)


def test_secrets(stages):
    before = {r.doc_id: r for r in stages["decontamination"]}
    assert ids(stages["secrets"]) == sorted(before)
    for r in stages["secrets"]:
        hidden = secrets.scan(before[r.doc_id].text)[2]
        assert r.text == secrets.redact(before[r.doc_id].text, hidden, "[SECRET]")
        assert not hidden or r.n_chars == len(r.text)


def test_packing_and_run(spark, stages):
    codec = Encoder(byte_bpe())
    sizes = {r.doc_id: len(codec.encode([r.text])[0]) // 4 + 1 for r in stages["secrets"]}
    got = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, stages["packing"]))
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == sizes
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.05 * np.ceil(sum(sizes.values()) / 1024) + 1


def test_odd_rows(spark):
    text = "the house of the dog and the cat is in the garden of the town"
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, None, None, None), (4, None, "en", "s", 0), (5, "", None, "s", 0), (6, "12 34", "de", "s", 5)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame(rows, schema)
    for limit in (len(rows), 0):
        frame = docs.limit(limit)
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
        assert [r.doc_id for r in frame.orderBy("doc_id").collect()] == ([None, 1] if limit else [])
