import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from oddsgraph.operators import elimination as el
from oddsgraph.operators import graph as g


def closure(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    changed = True
    while changed:
        changed = False
        for n, reach in out.items():
            more = set().union(*[out[m] for m in reach]) - reach if reach else set()
            if more:
                reach |= more
                changed = True
    return out


def edge_rows(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src string, dst string")


def tangled(seed, n=18, m=34, cyclic=False):
    """Chains, stars, junctions and, if wanted, edges that lead back."""
    r = random.Random(seed)
    pairs = {(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, n - 1, 1) if r.random() < 0.7}
    while len(pairs) < m:
        a, b = sorted(r.sample(range(n), 2))
        pairs.add((f"n{a:03d}", f"n{b:03d}"))
    pairs |= {(f"n{3:03d}", f"leaf{i}") for i in range(5)} | {(f"top{i}", f"n{n // 2:03d}") for i in range(5)}
    if cyclic:
        pairs |= {(f"n{b:03d}", f"n{a:03d}") for a, b in (sorted(r.sample(range(n), 2)) for _ in range(6)) if b - a < 12}
    return sorted(pairs)


@pytest.fixture(params=[(2000, 4096), (8, 4096), (0, 4)], ids=["small remainder", "layers", "dense remainder"])
def bounds(request, monkeypatch):
    monkeypatch.setattr(el, "CORE_EDGES", request.param[0])
    monkeypatch.setattr(el, "MOST_PATHS", request.param[1])
    monkeypatch.setattr(el, "PATHS", min(el.PATHS, request.param[1]))


def test_levels_and_reachability(spark, bounds):
    pairs = tangled(1)
    df = edge_rows(spark, pairs)
    want = closure(pairs)
    level: dict = {}
    for node in sorted(want, key=lambda x: len(want[x]), reverse=True):  # what reaches more comes first
        level[node] = max((level[a] + 1 for a, b in pairs if b == node), default=0)
    assert dict(rows(g.topological_levels(df), "node", "level")) == level
    nodes = sorted(want)
    r = random.Random(4)
    asked = sorted({(r.choice(nodes), r.choice(nodes)) for _ in range(250)})
    index = g.reach_index(df)
    assert rows(g.reachable(index, edge_rows(spark, asked))) == sorted(p for p in asked if p[1] in want[p[0]])
    starts = nodes[:2] + ["top3"]
    got = rows(g.descendants(index, spark.createDataFrame([(n,) for n in starts], "node string")), "start", "node")
    assert got == sorted((s, d) for s in starts for d in want[s])


def test_cycles(spark, bounds):
    pairs = tangled(2, cyclic=True)
    reach = closure(pairs)
    want = {n: min(x for x in reach[n] if n in reach[x]) for n in reach if n in reach[n]}
    assert len(set(want.values())) > 1
    assert dict(rows(g.cycle_components(edge_rows(spark, pairs)), "node", "component")) == want


def test_rounds_follow_the_logarithm_of_the_depth(spark):
    """Every node has two ways in and out, and the longest path goes through all 6,000 of them."""
    n = 6000
    line = spark.range(n).select(F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("dst"), F.col("id").alias("src")).where(F.col("dst") < n)
    layers = el.eliminate(line.select(F.lpad(F.col("src").cast("string"), 6, "0").alias("src"), F.lpad(F.col("dst").cast("string"), 6, "0").alias("dst"), F.lit(1).cast("long").alias("w")))
    assert layers.small and layers.rounds <= 20
    level = el.longest_distances(layers)
    assert level.where(F.col("level") != F.col("node").cast("long")).count() == 0 and level.count() == n - 1
    # Edges kept by all layers stay in proportion to the graph.
    assert sum(m.count() for m in layers.marked) < 6 * 2 * n


def test_empty_graph_and_loops(spark):
    none = edge_rows(spark, [("a", "a")])
    assert g.topological_levels(none).count() == 0 and g.cycle_components(none).count() == 0
    assert g.reachable(g.reach_index(none), edge_rows(spark, [("a", "a"), ("a", "b")])).count() == 0
