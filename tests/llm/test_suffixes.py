import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsgraph.llm import suffixes as sx

SF = "/root/testdata/sf0.001"


def by_hand(rows):
    """Every 400-byte string counted, the bytes under the repeated ones removed."""
    bodies = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(b[i : i + 400] for _, b in bodies for i in range(len(b) - 399))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if counts[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\x01" * 400
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_whole_table(spark, monkeypatch, crowd):
    monkeypatch.setattr(sx, "CROWD", crowd)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = by_hand(rows)
    same(sx.op7_suffixes(spark, SF).collect(), want)
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_pieces_of_many_lengths(spark, monkeypatch, crowd):
    monkeypatch.setattr(sx, "CROWD", crowd)
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    pool = [noise(rng.choice([390, 399, 400, 401, 450, 700, 1500])) for _ in range(12)]
    rows = [(k, noise(rng.choice([0, 5, 300])) + "".join(rng.choice(pool) + noise(rng.choice([0, 1, 200])) for _ in range(rng.randint(0, 3)))) for k in range(60)]
    # Strings that agree around an anchor on one side with one text, on the other with another.
    a, b, c = noise(300), noise(260), noise(300)
    rows += [(100, noise(50) + a + b + c + noise(50)), (101, noise(90) + a + b + noise(400)), (102, noise(400) + b + c + noise(90)), (103, a[-140:] + b + noise(30))]
    same(sx.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect(), by_hand(rows))


def test_odd_rows(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdé") for _ in range(900))
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text[100:]), (None, "x"), (5, "z" * 3000), (6, "ab" * 1000), (7, text[:399]), (8, "q" * 400), (9, "漢" * 200 + "字" * 134)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("mine")).withColumn("text_hash", F.lit(1))
    same(sx.remove_repeats(docs).collect(), by_hand(rows))
    assert sx.remove_repeats(docs.limit(0)).count() == 0


def test_loser_tree_merges_and_shares():
    rng = random.Random(5)
    for k in (1, 2, 3, 7, 16):
        runs = []
        for _ in range(k):
            strings = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 40)))
            runs.append((strings, sx.front_coded(strings)[0].tolist()))
        got = [(runs[r][0][i], n) for r, i, n in sx.merge_runs(runs)]
        want = sorted(s for strings, _ in runs for s in strings)
        assert [s for s, _ in got] == want
        assert [n for _, n in got][1:] == [sx.shared_prefix(x, y) for x, y in zip(want, want[1:])]


def test_front_coding_round_trip():
    strings = sorted([b"", b"a", b"ab", b"ab", b"abc" * 100, b"abd", b"b"])
    shared, rest = sx.front_coded(strings)
    assert sx._decoded(shared, np.array([len(s) for s in strings], np.uint16), rest) == strings
    assert len(rest) < sum(map(len, strings))


def test_every_string_has_an_anchor_of_its_own_content():
    rng = np.random.default_rng(6)
    body = rng.integers(97, 123, 5000).astype(np.uint8)
    at, _ = sx.anchors(body)
    for s in range(len(body) - 399):
        inner, _ = sx.anchors(body[s : s + 400])
        assert len(inner) and set(inner + s) <= set(at)
    assert len(at) < 5000 / 60
