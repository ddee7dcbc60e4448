import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from oddsgraph.operators import graph as g

EDGE = "from_condition_id string, to_condition_id string, type string, source string"


def edges(spark, pairs, kind="implies", source="ladder"):
    return spark.createDataFrame([(a, b, kind, source) for a, b in pairs], EDGE)


def closure(pairs):
    nodes = {x for p in pairs for x in p}
    out = {}
    for n in nodes:
        seen, stack = set(), [n]
        while stack:
            for a, b in pairs:
                if a == stack[-1] and b not in seen:
                    break
            else:
                stack.pop()
                continue
            seen.add(b)
            stack.append(b)
        out[n] = seen
    return out


def random_dag(seed, n=24, m=40):
    r = random.Random(seed)
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(0, 10)]
    extra = set()
    while len(extra) < m - 10:
        a, b = sorted(r.sample(range(n), 2))
        extra.add((f"n{a:02d}", f"n{b:02d}"))
    return sorted(set(chain) | extra)


@pytest.mark.parametrize("pairs", [random_dag(1), [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(90)]])
def test_reachability_reduction_and_levels(spark, pairs):
    df = edges(spark, pairs)
    index = g.reach_index(df)
    want = closure(pairs)
    nodes = sorted(want)
    r = random.Random(7)
    asked = [(r.choice(nodes), r.choice(nodes)) for _ in range(150)]
    asked = sorted({p for p in asked if p[0] != p[1]})
    got = rows(g.reachable(index, spark.createDataFrame(asked, "src string, dst string")))
    assert got == sorted(p for p in asked if p[1] in want[p[0]])

    starts = spark.createDataFrame([(n,) for n in nodes[:3]], "node string")
    got = rows(g.descendants(index, starts), "start", "node")
    assert got == sorted((s, d) for s in nodes[:3] for d in want[s])

    red = rows(g.transitive_reduction(df, index), "src", "dst")
    assert red == sorted((a, b) for a, b in pairs if not any(b in want[c] for x, c in pairs if x == a and c != b))
    assert closure(red) == {n: want[n] for n in closure(red)}

    level = dict(rows(g.topological_levels(df), "node", "level"))
    assert set(level) == set(nodes) and all(level[a] < level[b] for a, b in pairs)


def test_cycles_are_found_and_policy_applied(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)]
    knot = [("k1", "k2"), ("k2", "k3"), ("k3", "k1"), ("k2", "k1"), ("k3", "z"), ("a", "k1")]
    between = [("r0", "k1")]
    loop = [("h", "p"), ("p", "q"), ("q", "h"), ("h", "out"), ("in", "h")]
    df = edges(spark, ring + knot + between + loop + [("x", "x"), ("s", "t")])
    comp = dict(rows(g.cycle_components(df), "node", "component"))
    assert comp == {
        **{f"r{i}": "r0" for i in range(5)}, "k1": "k1", "k2": "k1", "k3": "k1", "h": "h", "p": "h", "q": "h",
    }
    witness = g.cycle_witness(df, g.cycle_components(df)).collect()
    by = {}
    for w in witness:
        by.setdefault(w["component"], {})[w["from_condition_id"]] = w["to_condition_id"]
    assert set(by) == {"r0", "k1", "h"}
    for step in by.values():
        at = start = next(iter(step))
        for _ in range(len(step)):
            at = step[at]
        assert at == start
    none = spark.createDataFrame([], "group_id string, condition_id string")
    with pytest.raises(g.RelationCycleError):
        g.build_graph(df, none)
    built = g.build_graph(df, none, tolerate_cycles=True)
    left = rows(built.implies, "from_condition_id", "to_condition_id")
    # Edges between two cycles go too.
    assert left == [("a", "k1"), ("h", "out"), ("in", "h"), ("k3", "z"), ("s", "t")]
    stats = built.stats.collect()[0]
    assert stats["cycles_found"] == 3 and stats["cycles_dropped"] == 13


def test_related_markets(spark):
    df = edges(spark, [("a", "b"), ("b", "c"), ("a", "c")]).unionByName(
        edges(spark, [("b", "d")], "complement", "complement")
    )
    members = spark.createDataFrame([("g", "b"), ("g", "e")], "group_id string, condition_id string")
    built = g.build_graph(df, members)
    got = rows(g.related_markets(built, spark.createDataFrame([("b",), ("a",)], "condition_id string")))
    assert got == sorted([
        ("a", "b", "implies", "ladder", True), ("a", "c", "implies", "transitive", False),
        ("b", "c", "implies", "ladder", True), ("b", "a", "implied-by", "ladder", True),
        ("b", "d", "complement", "complement", True), ("b", "e", "partition", "neg-risk-event", True),
    ], key=lambda t: tuple(str(x) for x in t))
    assert built.stats.select("nodes", "reduced_edges").collect()[0] == (5, 2)
