import random

import numpy as np
import pytest
from conftest import rows

from oddsgraph.operators import candidates as c
from oddsgraph.operators import metric_tree


@pytest.mark.parametrize("block_rows,same_event", [(1024, True), (7, True), (9, False)])
def test_search_equals_brute_force(spark, block_rows, same_event):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 16))
    data = []
    for i in range(120):
        v = centres[i % 6] + 0.25 * r.normal(size=16)
        data.append((f"m{i:03d}", f"e{i % 4}", [float(x) for x in np.float32(v / np.linalg.norm(v))]))
    hot = data[0][2]
    data += [(f"x{i:03d}", "e0", hot) for i in range(30)]  # one group of copies
    df = spark.createDataFrame(data, "condition_id string, event_id string, embedding array<float>")
    got = rows(c.nearest_neighbours(df, k=4, threshold=0.82, same_event=same_event, block_rows=block_rows), "source_id", "target_id")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in data}
    event = {i: e for i, e, _ in data}
    want = []
    for i in unit:
        near = [(-round(float(unit[i] @ unit[j]), 9), j) for j in unit if j != i and (not same_event or event[i] == event[j])]
        want += [(i, j) for s, j in sorted(near)[:4] if -s >= 0.82]
    assert got == sorted(want) and len(want) > 200


def test_exclusions(spark):
    pairs = spark.createDataFrame(
        [("a", "b", 0.9), ("a", "c", 0.9), ("d", "e", 0.95), ("f", "g", 0.9), ("h", "i", 0.9), ("a", "z", 0.85)],
        "low_condition_id string, high_condition_id string, similarity double",
    )
    rel = spark.createDataFrame([("c", "b", "implies"), ("b", "a", "implies"), ("e", "d", "complement")], "from_condition_id string, to_condition_id string, type string")
    members = spark.createDataFrame([("g1", "f"), ("g1", "g")], "group_id string, condition_id string")
    done = spark.createDataFrame([("h", "i")], "low_condition_id string, high_condition_id string")
    left = c.uncovered_pairs(pairs, rel, members, done)
    assert rows(left, "low_condition_id", "high_condition_id") == [("a", "z")]
    assert c.ordered_candidates(pairs, 1).collect()[0][:2] == ("d", "e")
    assert c.ordered_candidates(pairs, 3, "spread").count() == 3
    pairs2 = spark.createDataFrame([("b", "a", 0.9), ("a", "b", 0.95), ("c", "a", 0.5)], "source_id string, target_id string, similarity double")
    assert rows(c.fold_pairs(pairs2)) == [("a", "b", 0.95)]


@pytest.mark.parametrize("spread,alike,floor", [(1.0, True, 0.2), (0.02, False, 0.8)])
def test_vectors_that_a_tree_cannot_divide_are_not_copied_to_its_cells(spark, monkeypatch, spread, alike, floor):
    r = np.random.default_rng(4)
    centres = np.eye(40, 64)
    made = (0 if alike else centres[np.arange(400) % 40]) + spread * r.normal(size=(400, 64))
    data = [("s", f"m{i:03d}", [float(x) for x in v]) for i, v in enumerate(made)]
    sent, descend = [], metric_tree.descend
    monkeypatch.setattr(metric_tree, "descend", lambda tree, asking: (sent.append(asking.count()), descend(tree, asking))[1])
    monkeypatch.setattr(metric_tree, "PART_ROWS", 90)
    got = metric_tree.nearest(spark.createDataFrame(data, "scope string, rep string, vector array<double>"), 3, floor, cell_rows=16, pivots=8)
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    best = {}
    for x in got.collect():
        best.setdefault(x.rep, set()).add((-x.similarity, x.other))
    for i, row in enumerate(scores):
        want = sorted((-row[j], f"m{j:03d}") for j in range(400) if j != i and row[j] >= floor)[:3]
        assert [n for _, n in sorted(best.get(f"m{i:03d}", ()))[:3]] == [n for _, n in want]
    assert sent[0] < 200 and (sent[1] == 0 or not alike)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_unlike_vectors_are_searched_in_blocks_before_a_tree_is_grown(spark, monkeypatch, kind):
    r = np.random.default_rng(7)
    made = r.normal(size=(420, 24)).astype(np.float32).astype(np.float64)
    made[400:410] = 2 * made[0]  # equal directions: ties go by name
    made[410:415] = 0
    made[415:420, 3] = np.nan
    data = [("s", f"m{(11 * i) % 420:03d}", [float(x) for x in v]) for i, v in enumerate(made)]
    grown, grow = [], metric_tree.grow
    monkeypatch.setattr(metric_tree, "grow", lambda vectors, *a: (grown.append(vectors.count()), grow(vectors, *a))[1])
    for name, value in (("PART_ROWS", 40), ("SAMPLE_ROWS", 100), ("SCORED_AT_ONCE", 7), ("EXACT_AT_ONCE", 11), ("ASKING_BLOCKS", 2), ("HELD_BLOCKS", 3), ("RECTANGLES", 8)):
        monkeypatch.setattr(metric_tree, name, value, raising=False)
    df = spark.createDataFrame(data, f"scope string, rep string, vector array<{kind}>")
    best = {}
    for x in metric_tree.nearest(df, 4, 0.2, cell_rows=16, pivots=8).collect():
        best.setdefault(x.rep, []).append((-x.similarity, x.other))
    unit = metric_tree.unit_rows(made)
    scores = np.round(unit @ unit.T, 9)
    names = [n for _, n, _ in data]
    for i, row in enumerate(scores):
        want = sorted((-row[j], names[j]) for j in range(420) if j != i and row[j] >= 0.2)[:4]
        got = sorted(best.get(names[i], ()))[:4]
        assert [n for _, n in got] == [n for _, n in want] and np.allclose([s for s, _ in got], [s for s, _ in want], atol=2e-9)
    assert sum(grown) < 250
