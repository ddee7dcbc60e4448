import math
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsgraph.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_over_the_whole_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = langid.op3_langid(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def by_hand(words):
    """Best penalised likelihood over all language sets, by long runs of expectation-maximisation."""
    best = None
    for size in range(1, words.shape[1] + 1):
        for chosen in combinations(range(words.shape[1]), size):
            like = np.exp(words[:, chosen])
            share = np.full(size, 1 / size)
            for _ in range(2000):
                part = like * share
                share = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
            value = np.log((like * share).sum(axis=1)).sum() - 0.5 * math.log(len(words)) * (size - 1)
            if best is None or value > best[0] + 1e-9:
                best = value, chosen, share
    full = np.zeros(words.shape[1])
    full[list(best[1])] = best[2]
    return full


def test_mixtures_equal_the_search_over_all_sets():
    rng, words, starts, want = np.random.default_rng(4), [], [], []
    for shares in ([1, 0, 0], [0.7, 0.3, 0], [0, 0.5, 0.5], [0.2, 0.3, 0.5], [0, 0, 1], [0.9, 0, 0.1]):
        of = rng.choice(3, size=300, p=shares)
        like = rng.normal(-12, 1, (300, 3))
        like[np.arange(300), of] += rng.exponential(6, 300)
        starts.append(300 * len(want))
        words.append(like)
        want.append(by_hand(like))
    got = langid.mixtures(np.concatenate(words), np.array(starts))
    assert np.abs(got - np.array(want)).max() < 0.02
    assert np.allclose(got.sum(axis=1), 1)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog in the house", "en"), ("der hund und die katze in dem haus", "de"), ("le chat et le chien dans la maison", "fr")] * 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_odd_rows(spark, docs):
    model = langid.train(docs.union(spark.createDataFrame([(99, None, "de"), (98, "ja ja", None)], docs.schema)))
    assert model.languages == ["de", "en", "fr"]
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 %& 3", "x"), (None, "the house", "x"), (5, "the dog " * 400_000, "x"), (6, "漢字", "x"), (7, "the house and the dog der hund und die katze", "x"), (7, "the house and the dog der hund und die katze", "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("lang_pred", F.lit(1))
    shared = spark.sparkContext.broadcast(model)
    got = langid.languages(odd, shared).select("doc_id", "__language.*", F.col("lang_pred").alias("mine")).collect()
    assert len(got) == len(rows) and all(r.mine == 1 for r in got)
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert [found[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert found[None][0] == "en" and found[5] == ("en", 1.0) and found[6][0] in model.languages
    assert found[7][1] < 0.9
    assert langid.languages(odd.limit(0), shared).count() == 0


def test_rejecting(spark, docs):
    more = spark.createDataFrame([(100, "??", "en"), (101, None, None), (102, "the dog in the house", None)], docs.schema)
    kept = langid.reject(docs.union(more).withColumn("extra", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "extra"]
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 102]
    unlabelled = docs.union(more).withColumn("lang", F.lit(None).cast("string"))
    assert langid.reject(unlabelled).count() == 61
    assert langid.reject(docs.limit(0)).count() == 0


def test_long_texts_are_cut_at_gaps(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 50
    table = np.random.default_rng(0).normal(size=(1 << langid.BUCKET_BITS, 2)).astype(np.float32)
    codes, _ = langid._codes([text, "end"])
    whole = langid._word_likelihoods(codes, table)
    monkeypatch.setattr(langid, "_LETTERS", 37)
    for a, b in zip(whole, langid._word_likelihoods(codes, table), strict=True):
        assert np.allclose(a, b)
