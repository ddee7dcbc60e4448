"""Exact nearest neighbours by angle over a metric tree.

A cell with too many vectors is split around pivots drawn from it, so pivots grow with the
table; each vector goes to the cell of its nearest pivot and every cell knows its radius. One
level is one pass over the vectors of wide cells, in groups of bounded size.

The search has two passes. Each vector is compared within its own cell, and the k-th best
found there, or the threshold, bounds how far a better partner can be: its reach. Then it
descends from the root again into every cell that its reach overlaps, by the cell's radius
and by the plane between the cell's pivot and the vector's nearest one. Vectors meet by an
equal-key join on the cell; pairs of cells are never listed. A cell that pivots cannot divide
(its vectors are all about as near to one another) is dealt into parts of bounded size.

Whether a tree would divide a scope is asked before it is grown: a few vectors are compared with
all rows, and their reach goes down the tree of a sample. Where it takes in most of the sample the
scope is compared in blocks of ``PART_ROWS`` instead, with the same result. A task holds a bounded
rectangle of blocks, its best lists rise while it goes on, and only their rows leave it; products
in single precision pass over what is surely below them, the rest is scored in double precision.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsgraph.session import cut

PIVOTS = 32
CELL_ROWS = 1024
ROWS_AT_ONCE = 8192
"""Vectors of one wide cell that a task places at a time."""
STUCK = 0.9
"""A child cell with more than this share of its parent is not split again."""
PART_ROWS = 8192
"""Rows of a block where a scope is compared without the tree."""
ASKING_BLOCKS, HELD_BLOCKS = 4, 32
"""Most blocks on either side of a task's rectangle."""
RECTANGLES = 64
"""A scope of fewer blocks is dealt into about so many smaller rectangles."""
SCORED_AT_ONCE = 256
EXACT_AT_ONCE = 1 << 16
PROBES = 64
"""About so many vectors of a scope tell whether a tree divides it; they decide the way, not the result."""
SAMPLE_ROWS = 8192
"""About so many rows of a scope make the tree that the probes go down."""
BLUNT = 0.5
"""A scope whose probes reach more than this share of the sample is compared in blocks."""
DIGITS = 9  # similarity is compared and ordered at this precision
SLACK = 1e-7
_KEY = ["scope", "cell"]


@dataclass
class MetricTree:
    homes: DataFrame  # scope, cell, rep, vector: each vector in its last cell
    levels: list[DataFrame]  # by depth: scope, cell, child, pivot, radius


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1.0, norms)


def _stacked(vectors: Sequence) -> np.ndarray:
    return unit_rows(np.array([np.asarray(v, np.float64) for v in vectors]))


def _angles(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ others.T, -1.0, 1.0))


def _salted(rows: DataFrame, cells: DataFrame, count: str) -> DataFrame:
    """Rows of the given cells in groups of about ROWS_AT_ONCE."""
    salts = F.ceil(F.col(count) / ROWS_AT_ONCE)
    return rows.join(cells.select(*_KEY, salts.alias("salts")), _KEY).withColumn("salt", F.expr("pmod(xxhash64(rep), salts)")).drop("salts")


def _place(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Each vector with the child of its nearest pivot and the angle to it."""
    out = rows[["scope", "cell", "rep", "vector"]].copy()
    if rows.empty or pivots.empty:
        return out.assign(child=pd.Series(dtype="int64"), angle=pd.Series(dtype="float64")).iloc[:0]
    angles = _angles(_stacked(rows["vector"]), _stacked(pivots["pivot"]))
    nearest = angles.argmin(1)
    return out.assign(child=pivots["child"].to_numpy()[nearest], angle=angles[np.arange(len(rows)), nearest])


def _fresh(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows under new column identities, so that both sides of a cogroup may stem from one table."""
    return df.select(*[F.col(c).alias(f"to_{c}" if c in keys else c) for c in df.columns])


def _by_salt(rows: DataFrame, nodes: DataFrame, cells: DataFrame, count: str, work, schema: str) -> DataFrame:
    """``work`` on groups of rows of a cell with the nodes of that cell beside each group."""
    at = [*_KEY, "salt"]
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(count) / ROWS_AT_ONCE) - 1)).alias("salt")
    beside = nodes.join(cells.select(*_KEY, salts), _KEY)
    left, right = _salted(rows, cells, count), _fresh(beside, *at)
    return left.groupBy(*at).cogroup(right.groupBy(*[f"to_{c}" for c in at])).applyInPandas(work, schema)


def grow(vectors: DataFrame, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS) -> MetricTree:
    """The tree over (scope, rep, vector). Each scope has a root of its own."""
    kind = dict(vectors.dtypes)["vector"]
    rest = vectors.select("scope", F.lit(0).cast("long").alias("cell"), "rep", "vector", F.lit(None).cast("long").alias("parent_rows"))
    finished, levels = [], []
    while True:
        sizes = rest.groupBy(*_KEY).agg(F.count("*").alias("n"), F.first("parent_rows").alias("parent_rows"))
        wide = cut(sizes.where((F.col("n") > cell_rows) & (F.col("parent_rows").isNull() | (F.col("n") <= STUCK * F.col("parent_rows")))).select(*_KEY, "n"))
        finished.append(rest.join(wide, _KEY, "left_anti").select(*_KEY, "rep", "vector"))
        if not wide.limit(1).count():
            break
        split = cut(rest.join(wide, _KEY).select(*_KEY, "rep", "vector", "n"))
        draw = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.xxhash64("rep", F.lit(len(levels))), "rep"))
        drawn = cut(
            split.withColumn("draw", draw).where(F.col("draw") <= pivots)
            .select(*_KEY, (F.col("cell") * (pivots + 1) + F.col("draw")).alias("child"), F.col("vector").alias("pivot"))
        )
        placed = cut(_by_salt(split.drop("n"), drawn, wide, "n", _place, f"scope string, cell long, rep string, vector {kind}, child long, angle double"))
        radii = placed.groupBy(*_KEY, "child").agg(F.max("angle").alias("radius"))
        levels.append(cut(drawn.join(radii, [*_KEY, "child"])))
        rest = placed.join(wide, _KEY).select("scope", F.col("child").alias("cell"), "rep", "vector", F.col("n").alias("parent_rows"))
    homes = finished[0]
    for more in finished[1:]:
        homes = homes.unionByName(more)
    return MetricTree(cut(homes) if levels else homes, levels)


def _overlaps(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Each vector once for every child that its reach overlaps."""
    columns = ["scope", "cell", "rep", "vector", "reach"]
    if rows.empty or nodes.empty:
        return rows[columns].iloc[:0]
    angles = _angles(_stacked(rows["vector"]), _stacked(nodes["pivot"]))
    reach = rows["reach"].to_numpy()[:, None]
    meets = (angles <= nodes["radius"].to_numpy() + reach + SLACK) & (angles <= angles.min(1, keepdims=True) + 2 * reach + SLACK)
    row, child = np.nonzero(meets)
    return rows[columns].iloc[row].assign(cell=nodes["child"].to_numpy()[child])


def descend(tree: MetricTree, asking: DataFrame) -> DataFrame:
    """(scope, cell, rep, vector): the last cells that the reach of each of (scope, rep, vector, reach) overlaps."""
    kind = dict(asking.dtypes)["vector"]
    here = asking.select("scope", F.lit(0).cast("long").alias("cell"), "rep", "vector", "reach")
    arrived = []
    for nodes in tree.levels:
        split = nodes.select(*_KEY).distinct()
        arrived.append(here.join(split, _KEY, "left_anti").drop("reach"))
        going = here.join(split, _KEY, "left_semi")
        sizes = cut(going.groupBy(*_KEY).agg(F.count("*").alias("n")))
        here = cut(_by_salt(going, nodes, sizes, "n", _overlaps, f"scope string, cell long, rep string, vector {kind}, reach double"))
    out = here.drop("reach")
    for more in arrived:
        out = out.unionByName(more)
    return out


def _best(asking: pd.DataFrame, homes: pd.DataFrame, k: int, threshold: float) -> pd.DataFrame:
    """Of each vector the best k others of its cell; cells are told apart within the group."""
    out: list[tuple] = []
    cells = dict(iter(homes.groupby(_KEY, sort=False)))
    for key, own in asking.groupby(_KEY, sort=False):
        others = cells.get(key)
        if others is None:
            continue
        names, asked = others["rep"].to_numpy(), own["rep"].to_numpy()
        rows, columns = _stacked(own["vector"]), _stacked(others["vector"]).T
        for at in range(0, len(rows), SCORED_AT_ONCE):
            scores = np.round(rows[at : at + SCORED_AT_ONCE] @ columns, DIGITS)
            for rep, row in zip(asked[at : at + SCORED_AT_ONCE], scores, strict=True):
                hits = np.flatnonzero((row >= threshold) & (names != rep))
                if len(hits) > k:
                    hits = hits[row[hits] >= np.partition(row[hits], len(hits) - k)[len(hits) - k]]
                best = sorted((-row[h], names[h]) for h in hits)[:k]
                out.extend((key[0], rep, name, -negative) for negative, name in best)
    return pd.DataFrame(out, columns=["scope", "rep", "other", "similarity"])


def compare(asking: DataFrame, homes: DataFrame, k: int, threshold: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(scope, rep, other, similarity): the best k of each cell for the vectors that ask there.

    Both sides are dealt into parts of at most about ``cell_rows``; small cells share a group.
    """
    parts = homes.groupBy(*_KEY).agg(F.count("*").alias("n"))
    chunks = asking.groupBy(*_KEY).agg(F.count("*").alias("m"))
    cells = parts.join(chunks, _KEY).select(
        *_KEY, F.ceil(F.col("n") / cell_rows).alias("parts"), F.ceil(F.col("m") / cell_rows).alias("chunks"),
        (F.col("n") + F.col("m") > cell_rows / 4).alias("large"),
    )
    total = homes.count()
    shared = F.pmod(F.xxhash64(*_KEY), F.lit(max(1, total // cell_rows)))
    place = F.when(F.col("large"), F.xxhash64(*_KEY, "part")).otherwise(shared).alias("place")

    def dealt(rows: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other_name)
        return (
            rows.join(cells, _KEY).withColumn(own_name, F.expr(f"pmod(xxhash64(rep), {own})"))
            .select(*_KEY, "rep", "vector", own_name, "large", numbers).select(*_KEY, "rep", "vector", "chunk", place)
        )

    held = dealt(homes, "parts", "chunks", "part", "chunk")
    asked = _fresh(dealt(asking, "chunks", "parts", "chunk", "part"), "place", "chunk")
    work = partial(_best, k=k, threshold=threshold)
    return asked.groupBy("to_place", "to_chunk").cogroup(held.groupBy("place", "chunk")).applyInPandas(
        lambda a, b: work(a, b), "scope string, rep string, other string, similarity double"
    )


def reaches(found: DataFrame, vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """(scope, rep, vector, reach): how far a partner may be that could still belong to the best k."""
    best = F.row_number().over(Window.partitionBy("scope", "rep").orderBy(F.desc("similarity"), "other"))
    found = found.withColumn("place", best).where(F.col("place") <= k)
    kth = found.groupBy("scope", "rep").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    floor = F.when(F.col("n") >= k, F.greatest("least", F.lit(threshold))).otherwise(threshold)
    widest: Column = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(floor, F.lit(threshold)) - 2 * 10.0**-DIGITS)))
    return vectors.join(kth, ["scope", "rep"], "left").select("scope", "rep", "vector", (widest + SLACK).alias("reach"))


def blunt_scopes(tree: MetricTree, probes: DataFrame) -> DataFrame:
    """(scope): those whose tree leaves the probes (scope, rep, vector, reach) most of the rows to compare."""
    sizes = tree.homes.groupBy(*_KEY).agg(F.count("*").alias("held"))
    whole = sizes.groupBy("scope").agg(F.sum("held").alias("n"))
    met = descend(tree, probes).join(sizes, _KEY).groupBy("scope").agg(F.sum("held").alias("met"))
    asked = probes.groupBy("scope").agg(F.count("*").alias("probes")).join(whole, "scope")
    return met.join(asked, "scope").where(F.col("met") > BLUNT * F.col("probes") * F.col("n")).select("scope")


def _pack(rows: pa.Table) -> pa.Table:
    """The vectors of a group as one row of plain numbers."""
    values = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in rows.column("vector").chunks]
    reps = pa.array([rows.column("rep").to_pylist()], pa.list_(pa.string()))
    return pa.table({"scope": rows.column("scope")[:1], "part": rows.column("part")[:1], "reps": reps, "data": pa.array([np.concatenate(values).tobytes()], pa.binary())})


def packed(vectors: DataFrame) -> DataFrame:
    """(scope, part, reps, data): the vectors of each scope in blocks of about PART_ROWS."""
    kind = "float" if dict(vectors.dtypes)["vector"] == "array<float>" else "double"
    parts = vectors.groupBy("scope").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    rows = vectors.join(parts, "scope").select("scope", F.expr("pmod(xxhash64(rep), parts)").alias("part"), "rep", F.col("vector").cast(f"array<{kind}>").alias("vector"))
    return rows.groupBy("scope", "part").applyInArrow(_pack, "scope string, part long, reps array<string>, data binary")


def _unpack(reps: list[str], data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Names and unit rows of a block, without rows that have no direction to compare (null, NaN, infinite)."""
    values = np.frombuffer(data, kind)
    with np.errstate(invalid="ignore", over="ignore"):
        rows = unit_rows(values.reshape(len(reps), len(values) // len(reps)).astype(np.float64))
    whole = np.isfinite(rows).all(axis=1)
    return np.array(reps, object)[whole], rows[whole]


def _put(best: np.ndarray, who: np.ndarray, row: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
    """Hits put into the lists of their rows, the highest first, ties by name."""
    touched, at = np.unique(row, return_inverse=True)
    k = best.shape[1]
    at = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
    score, name = np.concatenate([best[touched].ravel(), score]), np.concatenate([who[touched].ravel(), name])
    order = np.lexsort((name, -score, at))
    at = at[order]
    kept = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
    best[touched], who[touched] = score[kept].reshape(-1, k), name[kept].reshape(-1, k)


def _rectangle(group: pa.Table, k: int, threshold: float, kind: str) -> pa.Table:
    """Of each vector of the asking blocks the best k others among the held blocks."""
    asks, reps, data = (group.column(c).to_pylist() for c in ("asks", "reps", "data"))
    own = [_unpack(r, d, kind) for a, r, d in zip(asks, reps, data, strict=True) if a]
    held = [(r, d) for a, r, d in zip(asks, reps, data, strict=True) if not a]
    names = np.array(sorted({x for r, _ in held for x in r}), object)
    rank = {x: n for n, x in enumerate(names)}
    asked = np.concatenate([x for x, _ in own]) if own else np.array([], object)
    itself = np.array([rank.get(x, -1) for x in asked], np.int64)
    best, who = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1, np.int64)
    for block in held if len(asked) else []:
        others, columns = _unpack(*block, kind)
        if not len(others):
            continue
        ranks, thin = np.array([rank[x] for x in others], np.int64), columns.astype(np.float32)
        margin = (columns.shape[1] + 8) * 2.0**-22  # several times what single precision can be off
        start = 0
        for _, mine in own:
            for a in range(0, len(mine), SCORED_AT_ONCE):
                rows = mine[a : a + SCORED_AT_ONCE]
                here = slice(start + a, start + a + len(rows))
                scores = rows.astype(np.float32) @ thin.T
                floor = np.maximum(best[here, -1], threshold) - margin
                hits = scores >= floor.astype(np.float32)[:, None]
                if len(others) > k + 1 and np.count_nonzero(hits) > 2 * k * len(rows):
                    # The row itself may be one of these k + 1.
                    floor = np.maximum(floor, np.partition(scores, -k - 1, axis=1)[:, -k - 1] - 2 * margin)
                    hits = scores >= floor.astype(np.float32)[:, None]
                row, column = np.divmod(np.flatnonzero(hits), len(others))
                for at in range(0, len(row), EXACT_AT_ONCE):
                    r, c = row[at : at + EXACT_AT_ONCE], column[at : at + EXACT_AT_ONCE]
                    exact = np.round(np.einsum("ij,ij->i", rows[r], columns[c]), DIGITS)
                    right = (exact >= np.maximum(best[here, -1][r], threshold)) & (ranks[c] != itself[here][r])
                    _put(best[here], who[here], r[right], exact[right], ranks[c[right]])
            start += len(mine)
    row, place = np.nonzero(best > -np.inf)
    scope = pa.array([group.column("scope")[0].as_py()] * len(row), pa.string())
    found = [pa.array(asked[row], pa.string()), pa.array(names[who[row, place]], pa.string()), pa.array(best[row, place])]
    return pa.Table.from_arrays([scope, *found], ["scope", "rep", "other", "similarity"])


def compare_blocks(asking: DataFrame, held: DataFrame, k: int, threshold: float, kind: str) -> DataFrame:
    """(scope, rep, other, similarity): the best k of each rectangle of ``packed`` blocks of a scope."""
    counts = [rows.groupBy("scope").agg((F.max("part") + 1).alias(n)) for rows, n in ((asking, "q"), (held, "p"))]
    high = F.greatest(F.lit(1), F.least(F.lit(ASKING_BLOCKS), F.floor(F.col("q") / 16)))
    wide = F.greatest(F.lit(1), F.least(F.lit(HELD_BLOCKS), F.floor(F.col("p") * F.col("q") / (F.col("high") * RECTANGLES))))
    grid = counts[0].join(counts[1], "scope").withColumn("high", high).withColumn("wide", wide)
    grid = cut(grid.select("scope", "high", "wide", F.ceil(F.col("q") / F.col("high")).alias("chunks"), F.ceil(F.col("p") / F.col("wide")).alias("slabs")))
    tasks = grid.agg(F.sum(F.col("chunks") * F.col("slabs"))).head()[0] or 1

    def dealt(rows: DataFrame, asks: bool) -> DataFrame:
        size, own, other, count = ("high", "chunk", "slab", "slabs") if asks else ("wide", "slab", "chunk", "chunks")
        numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias(other)
        return rows.join(grid, "scope").select("scope", F.floor(F.col("part") / F.col(size)).alias(own), "reps", "data", F.lit(asks).alias("asks"), numbers)

    both = dealt(asking, True).unionByName(dealt(held, False))
    at = ["scope", "chunk", "slab"]
    # As many partitions as rectangles: their work is the square of their bytes, by which they would be put together.
    work = partial(_rectangle, k=k, threshold=threshold, kind=kind)
    return both.repartition(int(min(tasks, 4096)), *at).groupBy(*at).applyInArrow(
        lambda group: work(group), "scope string, rep string, other string, similarity double"
    )


def nearest(vectors: DataFrame, k: int, threshold: float, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(scope, rep, other, similarity): at least the best k others of each vector in its scope, at or above the threshold.

    ``vectors`` has scope, rep and vector, all of one length in a scope; reps are unique in
    it. Ties go to the smaller name. A threshold of 0 or less reaches every vector, so nothing
    is divided then.
    """
    if threshold <= 0:
        flat = vectors.select("scope", F.lit(0).cast("long").alias("cell"), "rep", "vector")
        return compare(flat, flat, k, threshold, cell_rows)
    kind = "f4" if dict(vectors.dtypes)["vector"] == "array<float>" else "f8"
    wide = cut(vectors.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows))
    counted = vectors.join(wide, "scope")
    blocks = cut(packed(counted.drop("n")))
    probes = counted.where(F.expr(f"pmod(xxhash64(rep), ceil(n / {PROBES})) = 0")).drop("n")
    reach = cut(reaches(compare_blocks(packed(probes), blocks, k, threshold, kind), probes, k, threshold))
    sample = cut(counted.where(F.expr(f"pmod(xxhash64(rep, 1), ceil(n / {SAMPLE_ROWS})) = 0")).drop("n"))
    blunt = cut(blunt_scopes(grow(sample, cell_rows, pivots), reach))

    sharp = vectors.join(blunt, "scope", "left_anti")
    tree = grow(sharp, cell_rows, pivots)
    found = cut(compare(tree.homes, tree.homes, k, threshold, cell_rows))
    bounded = cut(reaches(found, sharp.join(wide, "scope", "left_semi"), k, threshold))
    visits = cut(descend(tree, bounded))
    # At home the vector was compared already.
    away = visits.join(tree.homes.select(*_KEY, "rep"), [*_KEY, "rep"], "left_anti")
    found = found.unionByName(compare(away, tree.homes, k, threshold, cell_rows))
    blocks = blocks.join(blunt, "scope", "left_semi")
    return found.unionByName(compare_blocks(blocks, blocks, k, threshold, kind))
