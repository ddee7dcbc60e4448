"""Graph questions answered block by block: nodes that follow one another in the order of their names.

Ids are mostly given in the order in which things arise, so edges are short in that order.
Nodes are cut into blocks of at most ``BLOCK_NODES`` in it (shorter names first, so that plain
numbers keep their order). A node with an edge to another block is a *gate*. Each block is read
in one task, which leaves edges between its gates only; a graph of gates some hundred times
smaller is divided again, and what is small, or does not divide, is left to ``elimination``.
On the way back each block takes the answers of its gates and works out those of its nodes.

Where names say nothing of the neighbourhood most nodes are gates, and the whole graph goes
to ``elimination`` as it is. A block with too many gates or edges keeps its edges, and all its
nodes are gates. Tasks hold one block at a time and the driver counts only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsgraph.operators import elimination
from oddsgraph.session import cut

BLOCK_NODES = 4096
TASK_NODES = 1 << 18
"""Nodes of a range, which is cut into blocks."""
MOST_GATES, MOST_EDGES = 128, 16
"""Gates of a block, and edges for each node a block may hold; others are left as they are."""


@dataclass
class Division:
    inner: DataFrame  # block, src, dst, w: edges inside of blocks; a gate stands as an edge without src
    cross: DataFrame  # src, dst, w: all other edges


def _placed(edges: DataFrame) -> DataFrame:
    """(node, block)"""
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    order = [F.length("node"), F.col("node")]
    ranges = nodes.repartitionByRange(max(1, -(-nodes.count() // TASK_NODES)), *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    return cut(ranges.select("node", F.floor(row / BLOCK_NODES).alias("block")))


def divide(edges: DataFrame) -> Division:
    """``edges`` (src, dst, w) by blocks."""
    at = _placed(edges)
    a = at.select(F.col("node").alias("src"), F.col("block").alias("a"))
    b = at.select(F.col("node").alias("dst"), F.col("block").alias("b"))
    both = cut(edges.join(a, "src").join(b, "dst").select("src", "dst", "w", "a", "b"))
    apart = both.where("a <> b")
    gates = cut(apart.select(F.col("src").alias("node"), F.col("a").alias("block")).union(apart.select("dst", "b")).distinct())
    many = gates.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > MOST_GATES).select("block")
    thick = both.where("a = b").groupBy(F.col("a").alias("block")).agg(F.count("*").alias("n")).where(F.col("n") > MOST_EDGES * BLOCK_NODES).select("block")
    closed = at.select("block").distinct().join(many.union(thick), "block", "left_anti")
    inside = both.where("a = b").select(F.col("a").alias("block"), "src", "dst", "w")
    marks = gates.select("block", F.lit(None).cast("string").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("w"))
    inner = cut(inside.union(marks).join(closed, "block", "left_semi"))
    left = inside.join(closed, "block", "left_anti").select("src", "dst", "w")
    return Division(inner, apart.select("src", "dst", "w").union(left))


def _shrunk(edges: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame]) -> tuple[Division, DataFrame] | None:
    """The division and the graph of gates; None if that is not much smaller, or the graph is small already."""
    n = edges.count()
    if n <= elimination.CORE_EDGES:
        return None
    parts = divide(edges)
    short = parts.inner.groupBy("block").applyInPandas(work, "src string, dst string, w long")
    rest = cut(parts.cross.unionByName(short).groupBy("src", "dst").agg(F.max("w").alias("w")))
    return None if rest.count() > n / 2 else (parts, rest)


class _Block:
    """A block in numbers: ``out`` lists (successor, w) of each node, ``base`` the w of its loop."""

    def __init__(self, rows: pd.DataFrame) -> None:
        marks = rows["src"].isna()
        codes, self.names = pd.factorize(pd.concat([rows.loc[~marks, "src"], rows["dst"]]).to_numpy())
        real = int((~marks).sum())
        src, dst = codes[:real], codes[real:][(~marks).to_numpy()]
        self.gates = codes[real:][marks.to_numpy()].tolist()
        self.gate_rows = rows[marks]
        self.size = len(self.names)
        self.out: list[list] = [[] for _ in range(self.size)]
        self.base = [0] * self.size
        self.entries = [0] * self.size
        for a, b, w in zip(src.tolist(), dst.tolist(), rows.loc[~marks, "w"].tolist(), strict=True):
            if a == b:
                self.base[a] = w
            else:
                self.out[a].append((b, w))
                self.entries[b] += 1

    def order(self) -> list[int]:
        """Topological; nodes on or behind cycles are left out."""
        left = list(self.entries)
        ready = [v for v in range(self.size) if not left[v]]
        for v in ready:
            for u, _ in self.out[v]:
                left[u] -= 1
                if not left[u]:
                    ready.append(u)
        return ready


# --- levels ---------------------------------------------------------------------------------


def _level_shortcuts(rows: pd.DataFrame) -> pd.DataFrame:
    """Longest paths between gates over other nodes, and as a loop the longest that begins inside and ends at a gate."""
    block = _Block(rows)
    slot = {v: k for k, v in enumerate(block.gates)}
    none = len(slot)
    best = np.full((block.size, none + 1), -(1 << 60), np.int64)
    best[:, none] = block.base
    out: list[tuple] = []
    for v in block.order():
        row = best[v]
        if v in slot:
            name = block.names[v]
            out += [(block.names[block.gates[k]], name, int(row[k])) for k in np.flatnonzero(row[:none] >= 0)]
            if row[none] > 0:
                out.append((name, name, int(row[none])))
            row[:] = -(1 << 60)
            row[slot[v]] = 0
        for u, w in block.out[v]:
            np.maximum(best[u], row + w, out=best[u])
    return pd.DataFrame(out, columns=["src", "dst", "w"])


def _levels_inside(rows: pd.DataFrame) -> pd.DataFrame:
    """Levels of a block's nodes, those of its gates given as their w."""
    block = _Block(rows)
    given = dict(zip(block.gates, block.gate_rows["w"].tolist(), strict=True))
    level = list(block.base)
    for v in block.order():
        level[v] = given.get(v, level[v])
        for u, w in block.out[v]:
            level[u] = max(level[u], level[v] + w)
    return pd.DataFrame({"node": block.names, "level": level})


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): longest distance from a source. A loop (src = dst) says that a node has at least level w."""
    smaller = _shrunk(edges, _level_shortcuts)
    if smaller is None:
        begun = edges.where("src = dst").select(F.concat(F.lit("\0"), "src").alias("src"), "dst", "w")
        far = elimination.longest_distances(elimination.eliminate(edges.where("src <> dst").unionByName(begun)))
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        return cut(nodes.join(far, "node", "left").select("node", F.coalesce("level", F.lit(0).cast("long")).alias("level")))
    parts, rest = smaller
    top = levels(rest)
    marks = parts.inner.where("src is null").drop("w").join(top.select(F.col("node").alias("dst"), F.col("level").alias("w")), "dst")
    known = parts.inner.where("src is not null").unionByName(marks)
    inside = known.groupBy("block").applyInPandas(_levels_inside, "node string, level long")
    return cut(inside.unionByName(top).groupBy("node").agg(F.max("level").alias("level")))


# --- cycles ---------------------------------------------------------------------------------


def _gate_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Which gates are reached from which over other nodes only."""
    block = _Block(rows)
    bit = {v: 1 << k for k, v in enumerate(block.gates)}
    inner = [(v, u) for v in range(block.size) if v not in bit for u, _ in block.out[v] if u not in bit]
    mask: dict[int, int] = dict(bit)
    for group in elimination._strong(inner):  # what is reached comes first
        found = 0
        for v in group:
            for u, _ in block.out[v]:
                found |= mask.get(u, 0) if u in mask or u in bit else 0
        mask.update(dict.fromkeys(group, found))
    for v in range(block.size):
        if v not in mask:  # no neighbour but gates
            mask[v] = sum({bit[u] for u, _ in block.out[v] if u in bit})
    out = []
    for v in block.gates:
        found = 0
        for u, _ in block.out[v]:
            found |= mask[u]
        out += [(block.names[v], block.names[u], 1) for u in block.gates if u != v and found & bit[u]]
    return pd.DataFrame(out, columns=["src", "dst", "w"])


def _components_inside(rows: pd.DataFrame) -> pd.DataFrame:
    """Components of a block's nodes; gates of one component (``named``) are one node."""
    block = _Block(rows)
    named = {v: c for v, c in zip(block.gates, block.gate_rows["named"].tolist(), strict=True) if isinstance(c, str)}
    seen = {c: v for v, c in named.items()}
    one = [seen[named[v]] if v in named else v for v in range(block.size)]
    out = []
    for group in elimination._strong([(one[v], one[u]) for v in range(block.size) for u, _ in block.out[v]]):
        if len(group) > 1:
            name = next((named[v] for v in group if v in named), None) or min(block.names[v] for v in group)
            out += [(block.names[v], name) for v in group if v not in named]
    return pd.DataFrame(out, columns=["node", "component"])


def strong_components(edges: DataFrame, dense: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of nodes that share a cycle with another node, as ``elimination.strong_components``."""
    edges = edges.where("src <> dst")
    smaller = _shrunk(edges, _gate_links)
    if smaller is None:
        return elimination.strong_components(elimination.eliminate(edges), dense)
    parts, rest = smaller
    top = cut(strong_components(rest, dense))
    known = parts.inner.join(top.select(F.col("node").alias("dst"), F.col("component").alias("named")), "dst", "left")
    named = F.when(F.col("src").isNull(), F.col("named")).alias("named")
    inside = known.select("block", "src", "dst", "w", named).groupBy("block").applyInPandas(_components_inside, "node string, component string")
    return cut(inside).unionByName(top)


# --- lines ----------------------------------------------------------------------------------


def _lines_inside(rows: pd.DataFrame) -> pd.DataFrame:
    """Each node's place on a path of its block, and the block's connected part that it lies in."""
    block = _Block(rows)
    order = block.order()
    turn = {v: k for k, v in enumerate(order)}
    following: dict[int, int] = {}
    taken: set[int] = set()
    root = list(range(block.size))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for v in range(block.size):
        for u, _ in block.out[v]:
            root[find(u)] = find(v)
    for v in order:
        free = [u for u, _ in block.out[v] if u not in taken and u in turn]
        if free:
            following[v] = min(free, key=turn.__getitem__)
            taken.add(following[v])
    out = []
    for head in range(block.size):
        if head not in taken:
            v, pos = head, 0
            while v is not None:
                after = following.get(v)
                out.append((block.names[v], block.names[head], pos, after is None, block.names[find(v)]))
                v, pos = after, pos + 1
    return pd.DataFrame(out, columns=["node", "line", "pos", "last", "part"])


def _joined(pieces: DataFrame, links: DataFrame) -> DataFrame:
    """(piece, line, before): the first piece of each row of pieces, and the nodes before one, by pointer jumping."""
    size = pieces.select(F.col("piece").alias("a"), F.col("size").alias("before"))
    up = links.join(size, "a").select(F.col("b").alias("piece"), F.col("a").alias("line"), "before")
    state = cut(
        pieces.join(up, "piece", "left")
        .select("piece", F.coalesce("line", "piece").alias("line"), F.coalesce("before", F.lit(0).cast("long")).alias("before"), F.col("line").isNull().alias("done"))
    )
    reach, n = 1, pieces.count()
    while reach < 2 * n and state.where("not done").limit(1).count():
        far = state.select(F.col("piece").alias("line"), F.col("line").alias("f"), F.col("before").alias("more"), F.col("done").alias("end"))
        jump = state.where("not done").join(far, "line").select("piece", F.col("f").alias("line"), (F.col("before") + F.col("more")).alias("before"), F.col("end").alias("done"))
        state = cut(state.where("done").unionByName(jump))
        reach *= 2
    ring = F.col("done")  # pieces in a ring stand alone
    return state.select("piece", F.when(ring, F.col("line")).otherwise(F.col("piece")).alias("line"), F.when(ring, F.col("before")).otherwise(0).alias("before"))


def _connected(links: DataFrame) -> DataFrame:
    """(part, whole): the smallest name reachable over links (a, b), for parts that are not the smallest, by alternating stars."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        new = cut(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least).toDF("u", "v").distinct())
        same = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        edges = new
        if same:
            break
    return edges.select(F.col("u").alias("part"), F.col("v").alias("whole"))


def lines(edges: DataFrame) -> DataFrame | None:
    """(node, line, pos, part): paths of the graph that share no node, the place of each node on its
    path, and the connected part of the graph. None where names say nothing of the neighbourhood.

    On one line a node reaches all later ones; nodes of different parts never reach each other.
    """
    edges = cut(edges.where("src <> dst").select("src", "dst", F.lit(1).cast("long").alias("w")))
    n = edges.count()
    parts = divide(edges)
    cross = cut(parts.cross)
    if cross.count() > n / 4:
        return None
    held = cut(parts.inner.groupBy("block").applyInPandas(_lines_inside, "node string, line string, pos long, last boolean, part string"))
    alone = cross.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(held, "node", "left_anti")
    zero = F.lit(0).cast("long").alias("pos")
    held = cut(held.unionByName(alone.select("node", F.col("node").alias("line"), zero, F.lit(True).alias("last"), F.col("node").alias("part"))))
    a = held.select(F.col("node").alias("src"), F.col("line").alias("a"), F.col("last"), F.col("part").alias("pa"))
    b = held.select(F.col("node").alias("dst"), F.col("line").alias("b"), F.col("pos"), F.col("part").alias("pb"))
    met = cut(cross.join(a, "src").join(b, "dst"))
    # Of each end the nearest beginning, of each beginning the nearest of the ends that chose it.
    chosen = met.where("last and pos = 0").groupBy("a").agg(F.min(F.struct(F.length("b"), "b"))["b"].alias("b"))
    chosen = chosen.groupBy("b").agg(F.max(F.struct(F.length("a"), "a"))["a"].alias("a"))
    rows = _joined(held.where("last").select(F.col("line").alias("piece"), (F.col("pos") + 1).alias("size")), chosen)
    whole = _connected(met.select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    return cut(
        held.join(rows.withColumnRenamed("line", "first"), F.col("line") == F.col("piece")).join(whole, "part", "left")
        .select("node", F.col("first").alias("line"), (F.col("pos") + F.col("before")).alias("pos"), F.coalesce("whole", "part").alias("part"))
    )
