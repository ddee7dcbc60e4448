"""The implication graph: cycles, reduction, levels and reachability.

Most of the graph is long chains (ladders and deadline series). A node with one
edge in and one out is *interior*; a run of interior nodes is a chain with a
position per node, found by pointer jumping in log(length) rounds. What is left
is a *skeleton* of junctions with one edge per chain. Reachability inside a chain
compares positions; between chains cycles and levels are found block by block
(``blocks``), and reachability by places on lines. What these leave open is taken
apart in layers (``elimination``), so rounds follow the logarithm of the graph, not
its depth, and no table of all reachable pairs is ever built.

Loops bring only counts to the driver, and at most ``elimination.CORE_EDGES`` edges
of a remainder, and cut lineage with a table in the shared checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsgraph.operators import blocks, elimination
from oddsgraph.operators.elimination import Layers
from oddsgraph.operators.relations import canonical_pair, one_row
from oddsgraph.session import cut


class RelationCycleError(ValueError):
    """The implications contain cycles and the caller did not tolerate them."""


def implication_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the implications, self-edges left out."""
    out = edges.where(F.col("type") == "implies") if "type" in edges.columns else edges
    if "src" not in out.columns:
        out = out.select(F.col("from_condition_id").alias("src"), F.col("to_condition_id").alias("dst"))
    return out.select("src", "dst").where("src <> dst").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


@dataclass
class Chains:
    interior: DataFrame  # node, first, head, pos, tail — acyclic chains only
    rings: DataFrame  # node, component — cycles made of interior nodes alone
    skeleton: DataFrame  # src, dst, first (null for a plain edge), length


def chains(edges: DataFrame) -> Chains:
    """Contract every run of one-in-one-out nodes. ``edges`` must be distinct."""
    edges = cut(edges)
    degrees = _degrees(edges)
    inner = degrees.where("in_degree = 1 and out_degree = 1").select("node")
    inner = cut(inner)
    n = inner.count()
    mark = inner.select(F.col("node").alias("__n"), F.lit(True).alias("__inner"))
    step = (
        edges.join(inner, edges["dst"] == inner["node"], "left_semi")
        .join(mark, F.col("src") == F.col("__n"), "left")
        .select(
            F.col("dst").alias("node"),
            F.col("src").alias("up"),
            F.col("dst").alias("first"),
            F.lit(1).cast("long").alias("pos"),
            F.col("__inner").isNull().alias("done"),
            F.col("dst").alias("low"),
        )
    )
    state = cut(step)
    reach = 1
    while reach < 2 * n and state.where("not done").limit(1).count():
        for _ in range(2):  # two jumps per checkpoint
            far = state.select(
                F.col("node").alias("f_node"),
                *[F.col(c).alias("f_" + c) for c in ("up", "first", "pos", "done", "low")],
            )
            joined = state.join(far, (F.col("up") == F.col("f_node")) & ~F.col("done"), "left")
            hop = F.col("f_node").isNotNull()
            state = joined.select(
                "node",
                F.when(hop, F.col("f_up")).otherwise(F.col("up")).alias("up"),
                F.when(hop, F.col("f_first")).otherwise(F.col("first")).alias("first"),
                F.when(hop, F.col("pos") + F.col("f_pos")).otherwise(F.col("pos")).alias("pos"),
                F.when(hop, F.col("f_done")).otherwise(F.col("done")).alias("done"),
                F.when(hop, F.least("low", "f_low")).otherwise(F.col("low")).alias("low"),
            )
            reach *= 2
        state = cut(state)
    rings = state.where("not done").select("node", F.col("low").alias("component"))
    runs = state.where("done").select("node", "first", F.col("up").alias("head"), "pos")
    # The last node of a run is the one whose edge leaves the interior.
    exits = edges.join(mark, F.col("dst") == F.col("__n"), "left_anti")
    last = exits.join(runs, F.col("src") == F.col("node")).select(
        F.col("first").alias("l_first"), F.col("dst").alias("tail"), F.col("pos").alias("length")
    )
    interior = cut(
        runs.join(last, F.col("first") == F.col("l_first")).select("node", "first", "head", "pos", "tail", "length")
    )
    plain = exits.join(mark, F.col("src") == F.col("__n"), "left_anti").select(
        "src", "dst", F.lit(None).cast("string").alias("first"), F.lit(0).cast("long").alias("length")
    )
    heads = interior.where("pos = 1").select(
        F.col("head").alias("src"), F.col("tail").alias("dst"), "first", "length"
    )
    return Chains(interior.drop("length"), rings, cut(plain.unionByName(heads)))


# --- cycles ---------------------------------------------------------------------------------


def _peel(edges: DataFrame) -> tuple[DataFrame, int]:
    """Drop edges that start at a source or end at a sink until none is left to drop."""
    count = edges.count()
    while count:
        tos = edges.select(F.col("dst").alias("src")).distinct()
        froms = edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(tos, "src", "left_semi").join(froms, "dst", "left_semi").select("src", "dst"))
        left = edges.count()
        if left == count:
            break
        count = left
    return edges, count


def cycle_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every strongly connected component of two or more nodes.

    The component is named by its smallest node.
    """
    return _components(chains(implication_edges(edges)))


def _components(parts: Chains) -> DataFrame:
    loops = parts.skeleton.where("src = dst").select(F.col("src").alias("node")).distinct()
    real = blocks.strong_components(weighted(parts.skeleton), _dense_components)
    alone = loops.join(real, "node", "left_anti").withColumn("component", F.col("node"))
    members = real.unionByName(alone)
    # A chain lies on a cycle when both its ends lie on the same one.
    at_head = members.select(F.col("node").alias("head"), F.col("component").alias("head_c"))
    at_tail = members.select(F.col("node").alias("tail"), F.col("component").alias("tail_c"))
    inner = (
        parts.interior.join(at_head, "head").join(at_tail, "tail").where("head_c = tail_c")
        .select("node", F.col("head_c").alias("component"))
    )
    everything = members.unionByName(inner).unionByName(parts.rings.select("node", "component"))
    named = everything.groupBy("component").agg(F.min("node").alias("name"))
    return everything.join(named, "component").select("node", F.col("name").alias("component"))


def _dense_components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes that may lie on cycles, by peeling and colouring."""
    core, left = _peel(cut(edges))
    found = []
    while left:
        named = _strong_components(core)
        found.append(named)
        core = core.join(named.select(F.col("node").alias("src")), "src", "left_anti")
        core = core.join(named.select(F.col("node").alias("dst")), "dst", "left_anti")
        core, left = _peel(cut(core.select("src", "dst")))
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    out = found[0]
    for named in found[1:]:
        out = out.unionByName(named)
    return out


def _strong_components(edges: DataFrame) -> DataFrame:
    """Components named by the smallest label that reaches them (forward colouring, then
    backward from each root inside its colour). At least one component is found per call."""
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()
    colour = cut(nodes.withColumn("colour", F.col("node")))
    while True:
        offers = edges.join(colour, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "colour")
        best = colour.unionByName(offers).groupBy("node").agg(F.min("colour").alias("new"))
        merged = cut(colour.join(best, "node"))
        moved = merged.where("new < colour").limit(1).count()
        colour = merged.select("node", F.col("new").alias("colour"))
        if not moved:
            break
    colour = cut(colour)
    a = colour.select(F.col("node").alias("src"), F.col("colour").alias("ca"))
    b = colour.select(F.col("node").alias("dst"), F.col("colour").alias("cb"))
    inside = cut(edges.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
    seen = cut(colour.where("node = colour").select("node", F.col("colour").alias("component")))
    frontier = seen
    while True:
        back = inside.join(frontier, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "component")
        frontier = cut(back.distinct().join(seen, "node", "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = cut(seen.unionByName(frontier))


def cycle_witness(edges: DataFrame, components: DataFrame) -> DataFrame:
    """One cycle per component as edge rows: (component, from, to, source).

    Every node points to its smallest successor inside the component; the pointers
    run into a ring, found by doubling. The ring with the smallest node is shown.
    """
    c1 = components.select(F.col("node").alias("from_condition_id"), F.col("component"))
    c2 = components.select(F.col("node").alias("to_condition_id"), F.col("component").alias("c2"))
    inside = (
        edges.where(F.col("type") == "implies").join(c1, "from_condition_id").join(c2, "to_condition_id")
        .where((F.col("component") == F.col("c2")) & (F.col("from_condition_id") != F.col("to_condition_id")))
    )
    pointer = cut(
        inside.groupBy("component", F.col("from_condition_id").alias("node")).agg(
            F.min(F.struct(F.col("to_condition_id").alias("to"), "source")).alias("s")
        ).select("component", "node", "s.to", "s.source")
    )
    n = pointer.count()
    jump = pointer.select("component", "node", F.col("to").alias("at"), F.col("to").alias("low"))
    reach = 1
    while reach < n:
        far = jump.select(F.col("node").alias("f"), F.col("at").alias("f_at"), F.col("low").alias("f_low"))
        jump = cut(
            jump.join(far, F.col("at") == F.col("f")).select(
                "component", "node", F.col("f_at").alias("at"), F.least("low", "f_low").alias("low")
            )
        )
        reach *= 2
    on_ring = jump.select(F.col("at").alias("node")).distinct()
    ring = jump.join(on_ring, "node", "left_semi")
    # On a ring of at most n nodes every node has seen all of it.
    chosen = ring.groupBy("component").agg(F.min("low").alias("low"))
    ring = ring.join(chosen, ["component", "low"], "left_semi").select("node")
    return pointer.join(ring, "node", "left_semi").select(
        "component", F.col("node").alias("from_condition_id"), F.col("to").alias("to_condition_id"), "source"
    )


# --- reachability ---------------------------------------------------------------------------


def weighted(skeleton: DataFrame) -> DataFrame:
    """(src, dst, w): parallel chains by the longest."""
    return cut(skeleton.groupBy("src", "dst").agg((F.max("length") + 1).alias("w")))


def skeleton_layers(skeleton: DataFrame) -> Layers:
    return elimination.eliminate(weighted(skeleton))


@dataclass
class ReachIndex:
    interior: DataFrame
    skeleton: DataFrame
    acyclic: bool = True

    @cached_property
    def layers(self) -> Layers:
        return skeleton_layers(self.skeleton)

    @cached_property
    def lines(self) -> DataFrame | None:
        """Places of the skeleton's nodes, where it is too large for a remainder."""
        small = self.skeleton.limit(elimination.CORE_EDGES + 1).count() <= elimination.CORE_EDGES
        return None if small else blocks.lines(self.skeleton)


def reach_index(edges: DataFrame, acyclic: bool = True) -> ReachIndex:
    parts = chains(implication_edges(edges))
    return ReachIndex(parts.interior, parts.skeleton, acyclic)


def _walk(skeleton: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): nodes reached from each start over one or more edges, a round for each edge.

    Only for a remainder too dense to take apart."""
    hops = cut(skeleton.select("src", "dst").distinct())
    frontier = cut(starts.select(F.col("node").alias("start"), "node").distinct())
    seen = None
    while True:
        step = frontier.join(hops, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen, ["start", "node"], "left_anti")
        frontier = cut(step)
        if not frontier.limit(1).count():
            return frontier if seen is None else seen
        seen = frontier if seen is None else cut(seen.unionByName(frontier))


def reachable(index: ReachIndex, pairs: DataFrame) -> DataFrame:
    """The (src, dst) pairs of ``pairs`` where dst can be reached from src; no node counts as reaching itself.

    Most pairs of a deep graph are told by their ends' lines; the others are asked of the layers.
    """
    pairs = pairs.select("src", "dst").where("src <> dst")
    a = index.interior.select(
        F.col("node").alias("src"), F.col("first").alias("a_first"), F.col("pos").alias("a_pos"), F.col("tail").alias("a_tail")
    )
    b = index.interior.select(
        F.col("node").alias("dst"), F.col("first").alias("b_first"), F.col("pos").alias("b_pos"), F.col("head").alias("b_head")
    )
    placed = pairs.join(a, "src", "left").join(b, "dst", "left").select(
        "src", "dst",
        F.coalesce((F.col("a_first") == F.col("b_first")) & (F.col("a_pos") < F.col("b_pos")), F.lit(False)).alias("along"),
        F.coalesce("a_tail", "src").alias("leave"),
        F.coalesce("b_head", "dst").alias("enter"),
    )
    direct = F.col("along") | (F.col("leave") == F.col("enter"))
    if index.lines is None:
        placed = cut(placed.select("src", "dst", "leave", "enter", direct.alias("told")).distinct())
    else:
        at = index.lines.select(F.col("node").alias("leave"), F.struct("line", "pos", "part").alias("__a"))
        to = index.lines.select(F.col("node").alias("enter"), F.struct("line", "pos", "part").alias("__b"))
        one, two = F.col("__a"), F.col("__b")
        line = F.coalesce(one["line"] == two["line"], F.lit(False))
        sure = direct | (line & (one["pos"] < two["pos"]))
        never = (one["part"] != two["part"]) | (line & F.lit(index.acyclic))
        told = placed.join(at, "leave", "left").join(to, "enter", "left").select("src", "dst", "leave", "enter", sure.alias("told"), F.coalesce(never, F.lit(False)).alias("never"))
        placed = cut(told.where("told or not never").drop("never").distinct())
    yes, open_pairs = placed.where("told"), placed.where("not told")
    # Only ends that have skeleton edges on the needed side can be connected.
    outs = index.skeleton.select(F.col("src").alias("leave")).distinct()
    ins = index.skeleton.select(F.col("dst").alias("enter")).distinct()
    open_pairs = cut(open_pairs.join(outs, "leave", "left_semi").join(ins, "enter", "left_semi"))
    if open_pairs.isEmpty():
        return yes.select("src", "dst")
    joined = elimination.connected(index.layers, open_pairs.select(F.col("leave").alias("src"), F.col("enter").alias("dst")), _walk)
    hit = open_pairs.join(joined.toDF("leave", "enter"), ["leave", "enter"], "left_semi")
    return yes.select("src", "dst").unionByName(hit.select("src", "dst"))


def descendants(index: ReachIndex, starts: DataFrame) -> DataFrame:
    """(start, node): everything each start implies. Ancestors: use the reversed index."""
    starts = starts.select(F.col("node").alias("start")).distinct()
    place = index.interior.select(
        F.col("node").alias("start"), F.col("first").alias("s_first"), F.col("pos").alias("s_pos"), F.col("tail").alias("s_tail")
    )
    placed = cut(starts.join(place, "start", "left"))
    rest = placed.join(index.interior, F.col("s_first") == F.col("first")).where("pos > s_pos").select("start", "node")
    leave = placed.select("start", F.coalesce("s_tail", "start").alias("at"))
    walked = elimination.reached(index.layers, leave.select(F.col("at").alias("node")), _walk)
    beyond = leave.join(walked.select(F.col("start").alias("at"), "node"), "at").select("start", "node")
    junctions = cut(beyond.unionByName(leave.select("start", F.col("at").alias("node"))).distinct())
    inner = junctions.select("start", F.col("node").alias("head")).join(
        index.interior.select("head", "node"), "head"
    ).select("start", "node")
    everything = rest.unionByName(junctions).unionByName(inner).distinct()
    return everything.where("start <> node")


def transitive_reduction(acyclic: DataFrame, index: ReachIndex | None = None) -> DataFrame:
    """The fewest (src, dst) with the same reachability.

    An edge u→v can be redundant only if u has another successor and v another
    predecessor, which rules out every chain edge. Each remaining edge is checked
    from whichever end has fewer neighbours.
    """
    edges = cut(implication_edges(acyclic))
    index = reach_index(edges) if index is None else index
    d = _degrees(edges)
    sized = (
        edges.join(d.select(F.col("node").alias("src"), F.col("out_degree").alias("o")), "src")
        .join(d.select(F.col("node").alias("dst"), F.col("in_degree").alias("i")), "dst")
        .where("o > 1 and i > 1")
    )
    sized = cut(sized)
    via_out = sized.where("o <= i").select("src", "dst").join(
        edges.select(F.col("src"), F.col("dst").alias("mid")), "src"
    ).where("mid <> dst").select("src", "dst", F.col("mid").alias("p"), F.col("dst").alias("q"))
    via_in = sized.where("o > i").select("src", "dst").join(
        edges.select(F.col("src").alias("mid"), F.col("dst")), "dst"
    ).where("mid <> src").select("src", "dst", F.col("src").alias("p"), F.col("mid").alias("q"))
    asked = cut(via_out.unionByName(via_in))
    yes = reachable(index, asked.select(F.col("p").alias("src"), F.col("q").alias("dst")))
    redundant = asked.join(
        yes.select(F.col("src").alias("p"), F.col("dst").alias("q")), ["p", "q"], "left_semi"
    ).select("src", "dst").distinct()
    return edges.join(redundant, ["src", "dst"], "left_anti")


def topological_levels(acyclic: DataFrame) -> DataFrame:
    """(node, level): longest distance from a source; edges always go up."""
    parts = chains(implication_edges(acyclic))
    ends = F.explode(F.array("src", "dst")).alias("node")
    nodes = parts.skeleton.select(ends).distinct()
    far = blocks.levels(weighted(parts.skeleton))
    level = cut(nodes.join(far, "node", "left").select("node", F.coalesce("level", F.lit(0).cast("long")).alias("level")))
    inner = parts.interior.join(
        level.select(F.col("node").alias("head"), F.col("level").alias("base")), "head"
    ).select("node", (F.col("base") + F.col("pos")).alias("level"))
    return level.unionByName(inner)


# --- the whole graph ------------------------------------------------------------------------


@dataclass
class RelationGraph:
    implies: DataFrame  # edge rows kept after the cycle policy
    reduced: DataFrame  # src, dst
    complements: DataFrame
    members: DataFrame  # group_id, condition_id
    components: DataFrame  # node, component
    index: ReachIndex
    stats: DataFrame


def build_graph(
    edges: DataFrame, members: DataFrame, tolerate_cycles: bool = False
) -> RelationGraph:
    """Check cycles, reduce and index. Cycles raise unless tolerated; then every edge
    with both ends on any cycle is dropped."""
    edges = edges.where("from_condition_id <> to_condition_id")
    implies = edges.where(F.col("type") == "implies")
    complements = edges.where(F.col("type") != "implies")
    components = cut(cycle_components(edges))
    n_cycles = components.select("component").distinct().count()
    if n_cycles and not tolerate_cycles:
        raise RelationCycleError(f"the implications contain {n_cycles} cycle(s)")
    kept = implies
    if n_cycles:
        at = components.select(F.col("node").alias("__a"), F.lit(1).alias("__f"))
        to = components.select(F.col("node").alias("__b"), F.lit(1).alias("__t"))
        kept = (
            implies.join(at, F.col("from_condition_id") == F.col("__a"), "left")
            .join(to, F.col("to_condition_id") == F.col("__b"), "left")
            .where("__f is null or __t is null")
            .drop("__a", "__b", "__f", "__t")
        )
    index = reach_index(kept)
    reduced = transitive_reduction(kept, index)
    ends = edges.select(F.explode(F.array("from_condition_id", "to_condition_id")).alias("node"))
    nodes = ends.unionAll(members.select(F.col("condition_id").alias("node"))).distinct()
    stats = one_row(
        nodes.agg(F.count("*").alias("nodes")),
        kept.agg(F.count("*").alias("implies_edges")),
        reduced.agg(F.count("*").alias("reduced_edges")),
        complements.agg(F.count("*").alias("complement_edges")),
        members.agg(F.count_distinct("group_id").alias("partitions")),
        components.agg(F.count_distinct("component").alias("cycles_found")),
        implies.agg(F.count("*").alias("__all")),
    )
    stats = stats.withColumn("cycles_dropped", F.col("__all") - F.col("implies_edges")).drop("__all")
    return RelationGraph(kept, reduced, complements, members, components, index, stats)


def related_markets(graph: RelationGraph, starts: DataFrame) -> DataFrame:
    """(condition_id, related_id, relation, source, direct) for the given markets."""
    nodes = starts.select(F.col("condition_id").alias("node")).distinct()
    source = graph.implies.groupBy(
        F.col("from_condition_id").alias("src"), F.col("to_condition_id").alias("dst")
    ).agg(F.min("source").alias("source"))
    direct = graph.reduced.join(source, ["src", "dst"])

    def sided(found: DataFrame, forward: bool, name: str) -> DataFrame:
        a, b = ("start", "node") if forward else ("node", "start")
        edge = direct.select(F.col("src").alias(a), F.col("dst").alias(b), "source")
        return found.join(edge, ["start", "node"], "left").select(
            F.col("start").alias("condition_id"),
            F.col("node").alias("related_id"),
            F.lit(name).alias("relation"),
            F.coalesce("source", F.lit("transitive")).alias("source"),
            F.col("source").isNotNull().alias("direct"),
        )

    down = sided(descendants(graph.index, nodes), True, "implies")
    back = reach_index(reversed_edges(implication_edges(graph.implies)))
    up = sided(descendants(back, nodes), False, "implied-by")
    low, high = canonical_pair(F.col("from_condition_id"), F.col("to_condition_id"))
    pair = graph.complements.select(low.alias("low"), high.alias("high"), "source")
    both_ways = pair.select(F.col("low").alias("node"), F.col("high").alias("other"), "source").unionByName(
        pair.select(F.col("high").alias("node"), F.col("low").alias("other"), "source")
    )
    opposite = both_ways.join(nodes, "node", "left_semi").select(
        F.col("node").alias("condition_id"), F.col("other").alias("related_id"),
        F.lit("complement").alias("relation"), "source", F.lit(True).alias("direct"),
    )
    mine = graph.members.join(nodes, F.col("condition_id") == F.col("node"), "left_semi")
    peers = mine.select("group_id", "condition_id").join(
        graph.members.select("group_id", F.col("condition_id").alias("related_id")), "group_id"
    ).where("condition_id <> related_id").select(
        "condition_id", "related_id", F.lit("partition").alias("relation"),
        F.lit("neg-risk-event").alias("source"), F.lit(True).alias("direct"),
    )
    return down.unionByName(up).unionByName(opposite).unionByName(peers)
