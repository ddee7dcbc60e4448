import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsgraph.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, vector array<long>, floor string"


def by_hand(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """The contract word by word over distinct rows."""
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None})
    out = []
    for a in rows:
        if a[0] % every:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2], strict=False))  # noqa: B023, E731
        others = sorted((-score(r), r[0], r) for r in rows if r != a)
        near = [x for x in others if x[2][1] == a[1]][:positives]
        for ps, positive, _ in near:
            fit = [x for x in others if x[2][1] != a[1] and low * -ps <= 100 * -x[0] <= high * -ps][:negatives]
            out += [(a[0], positive, k, neg, -ps, -ns) for k, (ns, neg, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=50):
    df = spark.createDataFrame([(i, lab, v, "clash") for i, lab, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % every == 0).collect())


@pytest.mark.parametrize(("block", "anchors", "seed"), [(2048, 4096, 1024), (16, 3, 7), (50, 4096, 0)])
def test_equals_brute_force(spark, monkeypatch, block, anchors, seed):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "ANCHORS_AT_ONCE", anchors)
    monkeypatch.setattr(hn, "SEED_ROWS", seed)
    rng = np.random.default_rng(block)
    # Lengths from 1 to 100, many ties, one label with a third of the rows, one vector many times.
    vectors = rng.integers(-6, 7, (300, 5)) * rng.integers(1, 9, (300, 1))
    labels = np.where(rng.random(300) < 0.33, 0, rng.integers(0, 6, 300))
    rows = [(int(k), int(lab), v.tolist()) for k, (lab, v) in enumerate(zip(labels, vectors, strict=True))]
    rows += [(1000 + k, 2, [9, 9, 9, 9, 9]) for k in range(60)]
    want = by_hand(rows, 10)
    assert len(want) > 100 and mined(spark, rows, 10) == want


def test_odd_rows(spark):
    rows = [
        (0, 1, [4, 0]), (0, 1, [4, 0]), (0, 1, [2, 2]), (1, 1, [5, 1]), (2, 1, [0, 0]), (3, 2, [3, 0]), (4, 2, [2, 7]), (5, 3, [3]), (6, 3, []),
        (7, None, [9, 9]), (None, 1, [9, 9]), (8, 1, None), (50, 7, [1, 1]), (100, 1, [-4, 0]), (9, 2, [3, 0]), (150, 2, [0, 0]),
    ]
    want = by_hand(rows)
    assert {r[0] for r in want} >= {0, 150} and mined(spark, rows) == want


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1]), (2, 2, [1])]) == []
    assert mined(spark, [(1, None, [1]), (50, 2, None)]) == []


def test_large_components_are_exact(spark):
    big = 1 << 30
    rows = [(0, 1, [big, 1]), (1, 1, [big, 3]), (2, 2, [big * 3 // 4, 0]), (3, 2, [big * 3 // 4, 1]), (4, 1, [big, 2])]
    assert mined(spark, rows) == by_hand(rows)


def test_candidates_hold_every_row_that_reaches_the_floor():
    rng = np.random.default_rng(1)
    pruned = 0
    for spread in (1.0, 4.0):
        vectors = np.round(rng.standard_normal((500, 8)) * np.exp(-spread * np.arange(8) / 4) * 100).astype(np.int64)
        block = hn.Block(vectors)
        for k in range(0, 500, 7):
            scores = vectors @ vectors[k]
            for floor in (np.sort(scores)[-5], np.sort(scores)[-40], 1):
                found = block.candidates(vectors[k], float(floor))
                if found is not None:
                    pruned += len(found) < 250
                    assert set(np.flatnonzero(scores >= floor)) <= set(found.tolist())
        assert len(block.candidates(vectors[0], math.inf)) == 0
    assert pruned > 50


def test_quantized(spark):
    given = [[0.5, -0.001], [float("nan")], [float("inf"), 1.0], [None, 1.0], None, []]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(given)], "k int, v array<float>")
    assert [r.q for r in df.orderBy("k").select(hn.quantized(F.col("v")).alias("q")).collect()] == [[128, -1], None, None, None, None, []]
