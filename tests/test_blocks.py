import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_elimination import closure, edge_rows

from oddsgraph.operators import blocks, elimination
from oddsgraph.operators import graph as g


@pytest.fixture(params=[(8, 128)], ids=["blocks"])
def small(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_NODES", request.param[0])
    monkeypatch.setattr(blocks, "MOST_GATES", request.param[1])
    monkeypatch.setattr(elimination, "CORE_EDGES", 40)


def near(seed, n=40, cyclic=False):
    """Two strands of short edges, with a few that lead back."""
    r = random.Random(seed)
    pairs = {(a, b) for a in range(n) for b in (a + 2, a + 4) if b < n and r.random() < 0.9}
    if cyclic:
        pairs |= {(b, a) for a, b in ((a, a + 2 * r.randint(1, 5)) for a in r.sample(range(n), 3)) if b < n}
    return sorted((f"n{a:03d}", f"n{b:03d}") for a, b in pairs)


@pytest.mark.parametrize("pairs", [near(1)], ids=["near"])
def test_levels_and_reachability_by_blocks(spark, small, pairs):
    want = closure(pairs)
    level: dict = {}
    for node in sorted(want, key=lambda x: len(want[x]), reverse=True):
        level[node] = max((level[a] + 1 for a, b in pairs if b == node), default=0)
    df = edge_rows(spark, pairs)
    assert dict(rows(g.topological_levels(df), "node", "level")) == level
    asked = [(a, b) for a in want for b in want if a != b]
    assert rows(g.reachable(g.reach_index(df), edge_rows(spark, asked))) == sorted(p for p in asked if p[1] in want[p[0]])


@pytest.mark.parametrize("pairs", [near(2, cyclic=True)], ids=["near"])
def test_cycles_by_blocks(spark, small, pairs):
    reach = closure(pairs)
    want = {n: min(x for x in reach[n] if n in reach[x]) for n in reach if n in reach[n]}
    assert want and dict(rows(g.cycle_components(edge_rows(spark, pairs)), "node", "component")) == want
    asked = [(a, b) for a in reach for b in reach if a != b]
    found = g.reachable(g.reach_index(edge_rows(spark, pairs), acyclic=False), edge_rows(spark, asked))
    assert rows(found) == sorted(p for p in asked if p[1] in reach[p[0]])


def line(spark, n):
    pairs = spark.range(n).select(F.col("id").cast("string").alias("src"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("dst"))
    return pairs.where(F.col("dst") < n).select("src", F.col("dst").cast("string").alias("dst"))


def test_only_gates_are_taken_apart(spark, monkeypatch):
    """A line with shortcuts: levels and cycles leave a few edges to the layers, reachability none."""
    monkeypatch.setattr(blocks, "BLOCK_NODES", 512)
    taken, whole = [], elimination.eliminate
    monkeypatch.setattr(elimination, "eliminate", lambda edges: taken.append(edges.count()) or whole(edges))
    n = 3000
    df = line(spark, n)
    level = g.topological_levels(df)
    assert level.count() == n and level.where(F.col("node").cast("long") != F.col("level")).count() == 0
    back = df.unionByName(spark.createDataFrame([("2990", "3")], "src string, dst string"))
    found = g.cycle_components(back)
    assert found.count() == 2990 - 3 + 1 and [r.component for r in found.select("component").distinct().collect()] == ["10"]
    assert max(taken) < 400
    taken.clear()
    asked = spark.range(n - 7).select(F.col("id").cast("string").alias("src"), (F.col("id") + 7).cast("string").alias("dst"))
    both = asked.unionByName(asked.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    got = g.reachable(g.reach_index(df), both)
    assert got.count() == n - 7 and got.where("int(dst) < int(src)").count() == 0 and not taken
