"""Graph questions in a number of rounds that follows the logarithm of the graph's size.

Walking a graph edge by edge takes a round for each step of its longest path. Here nodes are
taken out instead. A round picks nodes of few paths through them, no two of them neighbours,
keeps their edges of that moment as a *layer*, and puts a shortcut in place of each path
through them. A fixed share of a sparse graph goes in each round whatever its depth, and what
is left, when it is small, is answered by one lookup table that every task holds.

Layers are read in one of two directions. Upwards, from a node through edges of ever later
layers: everything a node can reach is reached over one highest node, so two nodes are
connected when an upward walk of one and an upward walk against the edges of the other meet.
Downwards, from what is left to the first layer: a node's answer (longest distance, cycle,
reached or not) follows from those of its neighbours at the moment it was taken out.

A dense remainder, where every node has many paths through it, is left to plain walking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsgraph.session import cut

CORE_EDGES = 2000
"""A remainder of so many edges is shipped to tasks as a table."""
PATHS, MOST_PATHS = 16, 4096
"""Paths through a node that may be taken out: at first, and when nothing smaller is left."""


@dataclass
class Layers:
    marked: list[DataFrame]  # by round: src, dst, w, src_out, dst_out (which end was taken out)
    core: DataFrame  # src, dst, w
    core_edges: int

    @property
    def rounds(self) -> int:
        return len(self.marked)

    @property
    def small(self) -> bool:
        return self.core_edges <= CORE_EDGES


def _chosen(edges: DataFrame, round_number: int, paths: int) -> DataFrame:
    """Nodes with few paths through them, none next to another: of two neighbours the one of lower rank goes."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    through = (F.sum("o") * F.sum("i")).alias("through")
    rank = F.struct(F.ceil(F.log2(F.col("through") + 1)).alias("size"), F.xxhash64("node", F.lit(round_number)).alias("draw"), "node")
    able = cut(ends.groupBy("node").agg(through).where(F.col("through") <= paths).select("node", rank.alias("rank")))
    a = able.select(F.col("node").alias("src"), F.col("rank").alias("a"))
    b = able.select(F.col("node").alias("dst"), F.col("rank").alias("b"))
    beaten = edges.join(a, "src").join(b, "dst").select(F.greatest("a", "b")["node"].alias("node"))
    return able.select("node").join(beaten, "node", "left_anti")


def eliminate(edges: DataFrame) -> Layers:
    """Take a graph apart. ``edges`` has src, dst and a length w; loops are left out, of equal edges the longest counts."""
    flat = edges.where("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w"))
    rest = cut(flat)
    n, paths, marked = rest.count(), PATHS, []
    while n > CORE_EDGES and paths <= MOST_PATHS:
        chosen = cut(_chosen(rest, len(marked), paths))
        if not chosen.limit(1).count():
            paths *= 4
            continue
        a = chosen.select(F.col("node").alias("src"), F.lit(True).alias("src_out"))
        b = chosen.select(F.col("node").alias("dst"), F.lit(True).alias("dst_out"))
        here = cut(
            rest.join(a, "src", "left").join(b, "dst", "left")
            .select("src", "dst", "w", F.coalesce("src_out", F.lit(False)).alias("src_out"), F.coalesce("dst_out", F.lit(False)).alias("dst_out"))
        )
        first = here.where("dst_out").select("src", F.col("dst").alias("via"), F.col("w").alias("w1"))
        second = here.where("src_out").select(F.col("src").alias("via"), "dst", F.col("w").alias("w2"))
        shortcut = first.join(second, "via").where("src <> dst").select("src", "dst", (F.col("w1") + F.col("w2")).alias("w"))
        plain = here.where("not src_out and not dst_out").select("src", "dst", "w")
        rest = cut(plain.unionByName(shortcut).groupBy("src", "dst").agg(F.max("w").alias("w")))
        marked.append(here.where("src_out or dst_out"))
        before, n = n, rest.count()
        if n > 0.9 * before:
            paths *= 4
    return Layers(marked, rest, n)


# --- what is left ---------------------------------------------------------------------------


def _strong(edges: list[tuple]) -> list[list]:
    """Strongly connected components of a small graph, those that reach nothing further first."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    number: dict = {}
    low: dict = {}
    open_nodes: list = []
    waiting: set = set()
    found = []
    for start in out:
        work = [] if start in number else [(start, iter(out[start]))]
        while work:
            node, left = work[-1]
            if node not in number:
                number[node] = low[node] = len(number)
                open_nodes.append(node)
                waiting.add(node)
            following = next(left, None)
            if following is not None:
                if following not in number:
                    work.append((following, iter(out[following])))
                elif following in waiting:
                    low[node] = min(low[node], number[following])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[node])
            if low[node] == number[node]:
                group = []
                while not group or group[-1] != node:
                    group.append(open_nodes.pop())
                    waiting.discard(group[-1])
                found.append(group)
    return found


def _closure(edges: list[tuple]) -> tuple[dict, list[int]]:
    """Component number of each node, and for each component the bits of those it reaches, its own included."""
    groups = _strong(edges)
    number = {node: k for k, group in enumerate(groups) for node in group}
    following: list[set] = [set() for _ in groups]
    for a, b in edges:
        following[number[a]].add(number[b])
    bits: list[int] = []
    for k in range(len(groups)):
        bits.append(1 << k)
        for other in following[k] - {k}:
            bits[k] |= bits[other]
    return number, bits


def _core_edges(layers: Layers) -> list[tuple]:
    """At most CORE_EDGES rows."""
    return [tuple(r) for r in layers.core.select("src", "dst").limit(CORE_EDGES).collect()]


def _in_one_task(edges: DataFrame, work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``work`` over a small remainder: at most CORE_EDGES edges, and a row for each of their nodes."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for batch in batches for row in batch.itertuples(index=False, name=None)]
        yield pd.DataFrame(work(rows), columns=names)

    return edges.coalesce(1).mapInPandas(run, schema)


# --- answers --------------------------------------------------------------------------------


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _core_levels(edges: list[tuple]) -> list[tuple]:
    """Edges without a source stand for paths that start among the nodes taken out."""
    into: dict = {}
    for a, b, w in edges:
        into.setdefault(b, []).append((a, w))
    level: dict = {}
    for (node,) in reversed(_strong([(a, b) for a, b, _ in edges])):  # without cycles each stands alone
        level[node] = max((level[a] + w for a, w in into.get(node, ())), default=0)
    level.pop(None, None)
    return list(level.items())


def _walked_levels(core: DataFrame, begun: DataFrame) -> DataFrame:
    """A round for each step: for a remainder too dense to take apart."""
    nodes = core.select(F.explode(F.array("src", "dst")).alias("node"), F.lit(0).cast("long").alias("level"))
    level = cut(nodes.unionByName(begun).groupBy("node").agg(F.max("level").alias("level")))
    while True:
        offers = core.join(level, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), (F.col("level") + F.col("w")).alias("level"))
        best = level.unionByName(offers).groupBy("node").agg(F.max("level").alias("new"))
        merged = cut(level.join(best, "node"))
        moved = merged.where("new > level").limit(1).count()
        level = merged.select("node", F.col("new").alias("level"))
        if not moved:
            return level


def longest_distances(layers: Layers) -> DataFrame:
    """(node, level): longest distance from a source, for nodes whose distance is not 0. The graph has no cycle.

    Upwards each node hands on the longest path that starts below it; downwards it takes
    the longest that comes from above.
    """
    kind = dict(layers.core.dtypes)["src"]
    parts: list[DataFrame] = []
    for here in layers.marked:
        out = here.where("src_out").select("src", F.col("dst").alias("node"), "w")
        if parts:
            begun = _union(parts).groupBy(F.col("node").alias("src")).agg(F.max("level").alias("level"))
            out = out.join(begun, "src", "left").withColumn("w", F.col("w") + F.coalesce("level", F.lit(0)))
        parts.append(cut(out.groupBy("node").agg(F.max("w").alias("level"))))
    if layers.small:
        core = layers.core
        if parts:
            inside = core.select(F.explode(F.array("src", "dst")).alias("dst")).distinct()
            begun = _union(parts).groupBy(F.col("node").alias("dst")).agg(F.max("level").alias("w")).join(inside, "dst", "left_semi")
            core = core.unionByName(begun.select(F.lit(None).cast(kind).alias("src"), "dst", "w"))
        core = _in_one_task(core, _core_levels, f"node {kind}, level long")
    else:
        core = _walked_levels(layers.core, _union(parts) if parts else layers.core.select(F.col("src").alias("node"), F.col("w").alias("level")).limit(0))
    parts.append(cut(core))
    for here in reversed(layers.marked):
        known = _union(parts).groupBy(F.col("node").alias("src")).agg(F.max("level").alias("level"))
        reached = here.where("dst_out").join(known, "src", "left")
        parts.append(cut(reached.groupBy(F.col("dst").alias("node")).agg(F.max(F.coalesce("level", F.lit(0)) + F.col("w")).alias("level"))))
    return _union(parts).groupBy("node").agg(F.max("level").alias("level"))


def _core_components(edges: list[tuple]) -> list[tuple]:
    return [(node, min(group)) for group in _strong([(a, b) for a, b, _ in edges]) for node in group]


def strong_components(layers: Layers, dense: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of nodes that share a cycle with another node. ``dense`` answers a remainder too dense to take apart."""
    kind = dict(layers.core.dtypes)["src"]
    core = _in_one_task(layers.core, _core_components, f"node {kind}, component {kind}") if layers.small else dense(layers.core.select("src", "dst"))
    parts = [cut(core)]
    for here in reversed(layers.marked):
        known = _union(parts)
        at = known.select(F.col("node").alias("other"), "component")

        def sided(out: str, node: str, other: str) -> DataFrame:
            ends = here.where(out).select(F.col(node).alias("node"), F.col(other).alias("other"))  # noqa: B023
            return ends.join(at, "other", "left").select("node", F.coalesce("component", "other").alias("component")).distinct()  # noqa: B023

        # A node lies on a cycle when it is entered from and left to one component of what was left then.
        both = sided("dst_out", "dst", "src").join(sided("src_out", "src", "dst"), ["node", "component"])
        named = cut(both.groupBy("node").agg(F.min("component").alias("component")))
        # The component's first node may not be on record yet: it had no edges left of its own.
        parts += [named, cut(named.select(F.col("component").alias("node"), "component").distinct().join(known, "node", "left_anti"))]
    everything = _union(parts).distinct()
    shared = everything.groupBy("component").agg(F.count("*").alias("nodes")).where("nodes > 1")
    return everything.join(shared, "component", "left_semi").select("node", "component")


def climb(layers: Layers, starts: DataFrame, forward: bool) -> DataFrame:
    """(start, node): the starts and all they reach over edges to ever later layers."""
    out, near, far = ("src_out", "src", "dst") if forward else ("dst_out", "dst", "src")
    parts = [cut(starts.select(F.col("node").alias("start"), "node").distinct())]
    for here in layers.marked:
        edges = here.where(out).select(F.col(near).alias("node"), F.col(far).alias("next"))
        parts.append(cut(_union(parts).join(edges, "node").select("start", F.col("next").alias("node")).distinct()))
    return _union(parts).distinct()


def connected(layers: Layers, pairs: DataFrame, walk: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The (src, dst) of ``pairs`` where a path of one edge or more, or none if they are equal, leads from src to dst.

    ``walk(edges, starts)`` finds (start, node) in a remainder too dense to take apart.
    """
    asked = cut(pairs.select("src", "dst").distinct())
    up = cut(climb(layers, asked.select(F.col("src").alias("node")), True))
    down = cut(climb(layers, asked.select(F.col("dst").alias("node")), False))
    ups = up.select(F.col("start").alias("src"), F.col("node").alias("hub"))
    downs = down.select(F.col("start").alias("dst"), F.col("node").alias("hub"))
    met = asked.join(ups, "src").join(downs, ["dst", "hub"], "left_semi").select("src", "dst").distinct()
    if not layers.core_edges:
        return met
    if not layers.small:
        in_core = layers.core.select(F.col("src").alias("node")).distinct()
        leaves = up.join(in_core, "node", "left_semi")
        over = walk(layers.core, leaves.select("node")).select(F.col("start").alias("node"), F.col("node").alias("hub"))
        further = leaves.join(over, "node").select(F.col("start").alias("src"), "hub").distinct()
        return met.unionByName(asked.join(further, "src").join(downs, ["dst", "hub"], "left_semi").select("src", "dst")).distinct()
    number, bits = _closure(_core_edges(layers))
    kind = dict(layers.core.dtypes)["src"]
    held = layers.core.sparkSession.createDataFrame(list(number.items()), f"node {kind}, place int")  # at most two a core edge
    lists = lambda df, name: df.join(F.broadcast(held), "node").groupBy("start").agg(F.collect_set("place").alias(name))

    @F.pandas_udf("boolean")
    def meets(leave: pd.Series, enter: pd.Series) -> pd.Series:
        answers = []
        for a, b in zip(leave, enter, strict=True):
            reach = 0
            for x in a:
                reach |= bits[x]
            answers.append(any(reach >> int(y) & 1 for y in b))
        return pd.Series(answers, dtype=bool)

    across = (
        asked.join(lists(up, "leave").withColumnRenamed("start", "src"), "src")
        .join(lists(down, "enter").withColumnRenamed("start", "dst"), "dst")
        .where(meets("leave", "enter")).select("src", "dst")
    )
    return met.unionByName(across).distinct()


def reached(layers: Layers, starts: DataFrame, walk: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(start, node): everything each start reaches over one edge or more, the start itself only where it lies on a cycle's way back."""
    up = cut(climb(layers, starts, True))
    if layers.core_edges:
        in_core = layers.core.select(F.col("src").alias("node")).distinct()
        leaves = up.join(in_core, "node", "left_semi")
        if layers.small:
            edges = _core_edges(layers)
            number, bits = _closure(edges)
            groups: dict[int, list] = {}
            for node, k in number.items():
                groups.setdefault(k, []).append(node)

            @F.pandas_udf(f"array<{dict(layers.core.dtypes)['src']}>")
            def beyond(nodes: pd.Series) -> pd.Series:
                found = []
                for node in nodes:
                    reach = bits[number[node]]
                    found.append([x for k, group in groups.items() if reach >> k & 1 for x in group])
                return pd.Series(found, dtype=object)

            over = leaves.select("start", F.explode(beyond("node")).alias("node"))
        else:
            over = leaves.join(walk(layers.core, leaves.select("node")).toDF("node", "hub"), "node").select("start", F.col("hub").alias("node"))
        up = up.unionByName(over).distinct()
    parts = [cut(up)]
    for here in reversed(layers.marked):
        down = here.where("dst_out").select(F.col("src").alias("node"), F.col("dst").alias("next"))
        parts.append(cut(_union(parts).join(down, "node").select("start", F.col("next").alias("node")).distinct()))
    return _union(parts).distinct().where("start <> node")
