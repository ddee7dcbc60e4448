from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from oddsgraph.llm import simhash
from oddsgraph.llm.components import components

SF = "/root/testdata/sf0.001"


def by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(marks):
    """doc_id -> smallest id reachable, by comparing all pairs."""
    root = {d: d for d, _ in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(marks, 2):
        if bin(x ^ y).count("1") <= 2:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {d: find(d) for d, _ in marks}


def test_whole_table_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    marks = [(r.doc_id, by_hand(r.text)) for r in docs]
    want = groups(marks)
    got = simhash.op10_simhash(spark, SF).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {d: (f, want[d]) for d, f in marks}
    assert all(len(r.fingerprint) == 16 for r in got) and len(got) == len(docs)


@pytest.mark.parametrize("limit", [2048, 2])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "HOT_BUCKET", limit)
    base = 0x0123456789ABCDEF
    marks = sorted({base ^ (1 << a) ^ (1 << b) ^ (c << 50) for a in range(0, 40, 7) for b in range(3, 40, 9) for c in range(3)} | {0, 3, 7})
    got = {(r.a, r.b) for r in simhash.near_fingerprints(spark.createDataFrame([(m,) for m in marks], "fp long"), 2).collect()}
    assert got == {(a, b) for a, b in combinations(marks, 2) if bin(a ^ b).count("1") <= 2}


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n\t", "z"), (4, "one two three four", "a"), (5, "ONE two\nthree  four", "b"),
            (5, "ONE two\nthree  four", "b"), (None, "one two three four", "c"), (None, "other words here now", "d"), (9, "a" * 300_000, "e"), (8, "Ω", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("mine"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (None, 4), (None, None), (9, 9), (8, 8)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 8, 9, None, None], key=str)
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    got = components(links).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 301)}


def test_links_pass_through_rows_without_id(spark, monkeypatch):
    marks = spark.createDataFrame([(1, 0), (None, 3), (2, 15), (None, 1 << 40 | 0xFF00FF), (7, -1)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: marks)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(marks).collect()}
    assert got == {(1, 0): 1, (None, 3): 1, (2, 15): 1, (None, 1 << 40 | 0xFF00FF): None, (7, -1): 7}
