import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oddsgraph.llm import resample as rs
from oddsgraph.llm.common import utf8

SF = "/root/testdata/sf0.1"
M = (1 << 64) - 1


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [t.encode() for t in re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+|(?:(?![a-z0-9\t\n\x0b\x0c\r ])[\x00-\x7f])+", low)]


def by_hand(text):
    """Buckets of words and pairs with plain integers."""
    def mixed(h):
        h = (h ^ (h >> 31)) * 0xD6E8FEB86659FD93 & M
        return (h ^ (h >> 29)) * 0xC2B2AE3D27D4EB4F & M

    words = [mixed(sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(t)) & M) for t in tokens(text)]
    pairs = [mixed(a * 31 + b & M) for a, b in zip(words, words[1:])]
    return sorted([w >> 47 for w in words] + [(p >> 47) + (1 << 17) for p in pairs])


def test_features():
    some = ["The cat, THE cat!", "", " \n", "é漢 x%%% a", "one", "a  b\tc", "x"]
    found, sizes = rs.features(*utf8(pa.array(some)))
    ends = np.cumsum(sizes)
    assert [sorted(found[e - n : e].tolist()) for e, n in zip(ends, sizes, strict=True)] == [by_hand(t) for t in some]


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    known = labels.where(F.col("doc_id") % 2 == 0)
    drawn = {r.doc_id for r in rs.resample(docs, known).collect()}
    held = [r for r in labels.where(F.col("doc_id") % 2 == 1).collect()]
    share = lambda keep: np.mean([r.doc_id in drawn for r in held if keep(r)])
    assert share(lambda r: r.quality == 1 and r.toxic == 0) > 0.9
    assert share(lambda r: r.toxic == 1) < 0.2
    assert share(lambda r: r.quality == 0) < 0.25


def test_learned_counts_equal_plain_counts_and_go_on_small(spark, monkeypatch):
    """Counts of all tasks meet in few compressed rows: about two bytes for a bucket that a task has seen, where a row of its own took nine."""
    found, sent = [], []
    fit, read = rs.fit, rs._read_part
    monkeypatch.setattr(rs, "fit", lambda counts, *rest: found.append((counts, *rest)) or fit(counts, *rest))
    monkeypatch.setattr(rs, "_read_part", lambda data: sent.append(len(data)) or read(data))
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 9000, 40))) for k in range(1500)]
    rows += [(2000 + k, rows[k % 7][1]) for k in range(300)] + [(9000, None)]
    marks = [(k, int(k % 3 > 0), int(k % 5 == 0)) for k in range(0, 1500, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    rs.learn(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    kind = {}
    for doc, quality, toxic in marks:
        kind[rows[doc][1]] = max(kind.get(rows[doc][1], 0), rs.TOXIC_DOCS if toxic else rs.GOOD if quality else rs.RAW)
    want = np.zeros((4, rs.BUCKETS))
    copies = {}
    for _, body in rows:
        copies[body or ""] = copies.get(body or "", 0) + 1
    for body, n in copies.items():
        at = np.array(by_hand(body), int)
        np.add.at(want[rs.RAW], at, n)
        want[rs.RAW_DOCS][np.unique(at)] += 1
        if kind.get(body) == rs.GOOD:
            np.add.at(want[rs.GOOD], at, 1)
        if kind.get(body) == rs.TOXIC_DOCS:
            want[rs.TOXIC_DOCS][np.unique(at)] += 1
    counts, n_docs, n_toxic, _ = found[0]
    assert np.array_equal(counts, want)
    assert (n_docs, n_toxic) == (len(copies), sum(k == rs.TOXIC_DOCS for k in kind.values()))
    assert len(sent) <= rs.BUCKETS // rs.PART + 1 and sum(sent) < 3 * np.count_nonzero(want)


def test_weights_equal_plain_sums(spark):
    rng = np.random.default_rng(0)
    models = rs.Models(rng.normal(size=rs.BUCKETS).astype(np.float32), rng.normal(size=rs.BUCKETS).astype(np.float32), -2.0)
    rows = [(1, None), (2, ""), (3, "idiot words here"), (3, "idiot words here"), (None, "x"), (5, "w " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("mine"))
    got = rs.weights(docs, spark.sparkContext.broadcast(models)).collect()
    assert len(got) == len(rows)
    for r in got:
        at = by_hand(next(t for d, t in rows if d == r.doc_id))
        assert r.n_features == len(at)
        assert r.log_weight == pytest.approx(float(models.good[at].astype(float).sum()), abs=1e-6)
        assert r.log_toxic == pytest.approx(float(models.toxic[at].astype(float).sum()) - 2, abs=1e-6)
        assert math.isfinite(r.key)
    assert len({r.key for r in got if r.doc_id == 3}) == 1


@pytest.mark.parametrize("few", [1_000_000, 50])
def test_largest(spark, monkeypatch, few, tmp_path):
    monkeypatch.setattr(rs, "FEW", few)
    rng = np.random.default_rng(1)
    values = [(k, float(x)) for k, x in enumerate(np.round(rng.normal(size=3000), 2))]
    spark.createDataFrame(values, "id long, key double").write.parquet(f"{tmp_path}/v")
    rows = spark.read.parquet(f"{tmp_path}/v")
    want = sorted(values, key=lambda v: (-v[1], v[0]))
    for k in (0, 1, 700, 2999, 3000, 5000):
        got = sorted((r.key for r in rs.largest(rows, "key", k, ["id"]).collect()), reverse=True)
        assert got == [v for _, v in want[:k]]


def test_gumbel_draws_follow_the_weights(spark):
    """Of two kinds of rows, drawn one by one without replacement, the heavier come e times as often at first."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "heavy").otherwise("light").alias("text"))
    good = np.zeros(rs.BUCKETS, np.float32)
    good[by_hand("heavy")] = 1.0
    found = rs.weights(docs, spark.sparkContext.broadcast(rs.Models(good, np.zeros(rs.BUCKETS, np.float32), -9.0)))
    first = found.orderBy(F.col("key").desc()).limit(2000).collect()
    ratio = sum(r.doc_id % 2 == 0 for r in first) / sum(r.doc_id % 2 == 1 for r in first)
    assert 2.3 < ratio < 3.1


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "fine text"), (2, "fine text"), (None, "more")], "doc_id long, text string").withColumn("kind", F.lit(1))
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert rs.resample(docs, labels, 1.0).count() == 4 and rs.resample(docs, labels, 0.5).count() == 2
    assert rs.resample(docs, labels.limit(0)).count() == 4
    assert rs.resample(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("labelled", [False, True])
def test_copies_of_a_toxic_text_hide_no_word(spark, labelled):
    words = [f"w{k}" for k in range(50)]
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(words, 30)) + (" idiot" if k % 10 == 0 else "")) for k in range(2000)]
    marks = [(k, int(k % 10 != 0), int(k % 10 == 0)) for k in range(0, 2000, 2)]
    copies = [(5000 + k, rows[0][1]) for k in range(1000)]
    marks += [(d, 0, 1) for d, _ in copies] * labelled
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    drawn = {r.doc_id for r in rs.resample(docs, labels).collect()}
    assert drawn and not [d for d, text in rows + copies if "idiot" in text and d in drawn]
    alone = rs.learn(docs.where("doc_id < 5000"), labels)
    models = rs.learn(docs, labels)
    assert np.array_equal(alone.toxic, models.toxic) and alone.prior == models.prior
