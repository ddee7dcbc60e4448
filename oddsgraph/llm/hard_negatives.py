"""Hard-negative mining (operator 12): exact inner-product search with coordinate pruning.

Vectors lie in buckets of like length, cut into blocks of bounded size. A bucket whose longest
vector cannot reach an anchor's floor is not visited. In a block each coordinate of the unit
vectors has a sorted list. An anchor's floor and the block's longest vector give a least cosine
t; with it a unit vector's coordinate f must lie within a*t -/+ sqrt((1 - t^2)(1 - a^2)) of the
anchor's coordinate a (open where a alone reaches t). The anchor's largest coordinates are its
focus: the narrowest range of their lists gives the candidates, the other ranges are intersected
with it, and what is left is verified by exact integer products.

The floor of an anchor is the score of the last row it can still need, found in a sample of
rows that every task holds; it rises no result out and only saves work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsgraph.llm.common import cut
from oddsgraph.scale import order_limits

BLOCK_ROWS = 2048
ANCHORS_AT_ONCE = 4096
MOST_LENGTHS = 64
"""Buckets of length; beyond them buckets are cut by hash, so blocks stay of one size."""
SEED_ROWS, SEED_NUMBERS = 1024, 1 << 20
"""Rows, and numbers in them, of the sample from which floors are taken."""
FOCUS = 3
SLACK = 1e-9

FOUND = pa.schema([(n, pa.int64()) for n in ("row", "anchor_id", "positive_id", "score")])
MINED = pa.schema([(n, pa.int64()) for n in ("row", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])


def quantized(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null where a component is null or not finite, or the vector is."""
    value = F.transform(vector, lambda x: x.cast("double"))
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, F.transform(value, lambda x: F.floor(x * factor)))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), max(width, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with rows."""
    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if largest < 2.0**53:
        return np.rint(left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    exact = left.astype(object) @ right.astype(object).T
    return exact.astype(np.int64)  # raises where a score is beyond a long


class Block:
    """Vectors of like length with a sorted list for each coordinate."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        exact = vectors.astype(np.float64)
        lengths = np.sqrt((exact * exact).sum(1))
        self.longest = float(lengths.max(initial=0.0))
        self.unit = exact / np.where(lengths > 0, lengths, 1)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._lists[f] = order, self.unit[order, f]
        return self._lists[f]

    def candidates(self, anchor: np.ndarray, floor: float) -> np.ndarray | None:
        """Places of all vectors whose product with ``anchor`` may reach ``floor``; None for no pruning."""
        length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        if floor <= 0:
            return None
        most = length * self.longest
        if floor > most * (1 + SLACK):
            return np.zeros(0, np.int64)
        t, ranges = min(1.0, floor / most), []
        for f in np.argsort(-np.abs(anchor), kind="stable")[:FOCUS]:
            a = anchor[f] / length
            reach = np.sqrt(max(0.0, (1 - t * t) * (1 - a * a)))
            low = -1.0 if a <= -t else a * t - reach
            high = 1.0 if a >= t else a * t + reach
            order, values = self._list(int(f))
            first = np.searchsorted(values, low - SLACK, "left")
            last = np.searchsorted(values, high + SLACK, "right")
            ranges.append((last - first, int(f), first, last, low, high))
        count, f, first, last, _, _ = min(ranges)
        if 2 * count > len(self.vectors):
            return None
        found = self._list(f)[0][first:last]
        for _, other, _, _, low, high in ranges:
            if other != f:
                value = self.unit[found, other]
                found = found[(value >= low - SLACK) & (value <= high + SLACK)]
        return found

    def scores(self, anchors: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor its number, the places of candidates, and their exact scores."""
        whole = []
        for k in range(len(anchors)):
            found = self.candidates(anchors[k], floors[k])
            if found is None:
                whole.append(k)
            elif len(found):
                yield k, found, _products(self.vectors[found], anchors[k : k + 1])[:, 0]
        everything = np.arange(len(self.vectors))
        for a in range(0, len(whole), 256):
            some = whole[a : a + 256]
            for k, row in zip(some, _products(anchors[some], self.vectors), strict=True):
                yield k, everything, row


def _first(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` by falling score, then id."""
    places = np.arange(len(scores))
    if len(scores) > count:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    return places[np.lexsort((ids[places], -scores[places]))][:count]


def _within(scores: np.ndarray, low: int, high: int, count: int) -> slice:
    """Of falling scores the first ``count`` from ``high`` down to ``low``."""
    first = int(np.searchsorted(-scores, -high, "left"))
    return slice(first, min(first + count, int(np.searchsorted(-scores, -low, "right"))))


def _both(anchors: pa.Table, probes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    a, p = _matrix(anchors.column("vector")), _matrix(probes.column("vector"))
    width = max(a.shape[1], p.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, p))


def _numbers(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [table.column(name).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(name).to_numpy() for name in names]


def _find_positives(anchors: pa.Table, probes: pa.Table, count: int) -> pa.Table:
    vectors, others = _both(anchors, probes)
    row, anchor_id, floor = _numbers(anchors, "row", "vec_id", "floor")
    rows, ids = _numbers(probes, "row", "vec_id")
    out: list[list[np.ndarray]] = [[], [], [], []]
    for k, places, scores in Block(others).scores(vectors, floor):
        keep = (scores >= floor[k]) & (rows[places] != row[k])
        places, scores = places[keep], scores[keep]
        best = _first(scores, ids[places], count)
        for column, part in zip(out, (np.full(len(best), row[k]), np.full(len(best), anchor_id[k]), ids[places[best]], scores[best]), strict=True):
            column.append(part)
    return pa.Table.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for c in out], schema=FOUND)


def _bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _find_negatives(anchors: pa.Table, probes: pa.Table, count: int, low: int, high: int) -> pa.Table:
    vectors, others = _both(anchors, probes)
    row, anchor_id, label, floor = _numbers(anchors, "row", "vec_id", "label", "floor")
    ids, labels = _numbers(probes, "vec_id", "label")
    positives, positive_scores = anchors.column("positives").to_pylist(), anchors.column("positive_scores").to_pylist()
    out: list[list[np.ndarray]] = [[] for _ in MINED]
    for k, places, scores in Block(others).scores(vectors, floor):
        keep = (scores >= floor[k]) & (labels[places] != label[k])
        places, scores = places[keep], scores[keep]
        order = np.lexsort((ids[places], -scores))
        places, scores = places[order], scores[order]
        for j, (positive, score) in enumerate(zip(positives[k], positive_scores[k], strict=True)):
            some = _within(scores, *_bounds(score, low, high), count)
            n = max(0, some.stop - some.start)
            if n:
                same = [np.full(n, x) for x in (row[k], j, anchor_id[k], positive, score)]
                for column, part in zip(out, (*same, ids[places[some]], scores[some]), strict=True):
                    column.append(part)
    return pa.Table.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for c in out], schema=MINED)


def _add_floor(batches: Iterator[pa.RecordBatch], seed: pa.Table, count: int, bounds: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """A floor for each anchor: no row below it can be in its result.

    Without ``bounds`` it is the score of the ``count``-th row of the label in the sample; with
    them, over all positives, the lowest ``count``-th score of another label within bounds.
    """
    seed_rows, seed_labels = _numbers(seed, "row", "label")
    for batch in batches:
        table = pa.Table.from_batches([batch])
        row, label = _numbers(table, "row", "label")
        vectors, others = _both(table, seed)
        floors = np.full(len(row), -np.inf)
        scored = (s for a in range(0, len(row), 256) for s in _products(vectors[a : a + 256], others))
        given = table.column("positive_scores").to_pylist() if bounds else [None] * len(row)
        for k, (scores, positive_scores) in enumerate(zip(scored, given, strict=True)):
            if bounds is None:
                scores = scores[(seed_labels == label[k]) & (seed_rows != row[k])]
                if len(scores) >= count:
                    floors[k] = np.partition(scores, len(scores) - count)[len(scores) - count]
                continue
            scores = -np.sort(-scores[seed_labels != label[k]])
            least = np.inf
            for score in positive_scores:
                low, high = _bounds(score, *bounds)
                some = scores[_within(scores, low, high, count)] if low <= high else scores[:0]
                least = min(least, some[-1] if len(some) == count else low if low <= high else np.inf)
            floors[k] = least
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors)], names=[*batch.schema.names, "floor"])


def _with_floor(anchors: DataFrame, seed: pa.Table, count: int, bounds: tuple[int, int] | None = None) -> DataFrame:
    schema = ", ".join(f"{name} {kind}" for name, kind in [*anchors.dtypes, ("floor", "double")])
    return anchors.mapInArrow(partial(_add_floor, seed=seed, count=count, bounds=bounds), schema)


def _numbers_below(most: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), most - 1))


def _meet(asked: DataFrame, held: DataFrame, at: list[str], work, schema: pa.Schema) -> DataFrame:
    """``work`` on each group of both sides. The keys of one get names of their own, since both stem from one table."""
    asked = asked.select(*[F.col(c).alias(f"to_{c}" if c in at else c) for c in asked.columns])
    return asked.groupBy(*[f"to_{c}" for c in at]).cogroup(held.groupBy(*at)).applyInArrow(work, ", ".join(f"{f.name} long" for f in schema))


def _search_labels(anchors: DataFrame, probes: DataFrame, work) -> DataFrame:
    """Each anchor against every block of its label that its floor doesn't rule out."""
    sizes = probes.groupBy("label", "bucket").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"), (F.max("length") * (1 + SLACK)).alias("longest")
    )
    chunks = anchors.groupBy("label").agg(F.ceil(F.count("*") / ANCHORS_AT_ONCE).alias("chunks"))
    asked = (
        anchors.join(chunks, "label").withColumn("chunk", F.expr("pmod(xxhash64(row), chunks)")).drop("chunks")
        .join(sizes, "label").where("floor <= length * longest")
        .withColumn("part", _numbers_below(F.col("parts"))).drop("parts", "longest")
    )
    held = (
        probes.join(sizes.drop("longest"), ["label", "bucket"]).withColumn("part", F.expr("pmod(xxhash64(row), parts)"))
        .join(chunks, "label").withColumn("chunk", _numbers_below(F.col("chunks"))).drop("parts", "chunks")
    )
    return _meet(asked, held, ["label", "bucket", "part", "chunk"], work, FOUND)


def _search_all(anchors: DataFrame, probes: DataFrame, work) -> DataFrame:
    """Each anchor against every block of any label that its floor doesn't rule out.

    At most MOST_LENGTHS bucket sizes come to the driver; an anchor's blocks follow from them in place, without a join.
    """
    sizes = probes.groupBy("bucket").agg(F.count("*"), F.max("length")).collect()
    chunks = max(1, -(-anchors.count() // ANCHORS_AT_ONCE))
    parts = {bucket: -(-n // BLOCK_ROWS) for bucket, n, _ in sizes}
    buckets = [F.struct(F.lit(b).alias("bucket"), F.lit(float(longest) * (1 + SLACK)).alias("longest"), F.lit(parts[b]).cast("long").alias("parts")) for b, _, longest in sizes]
    if not buckets:
        return anchors.sparkSession.createDataFrame([], ", ".join(f"{f.name} long" for f in MINED))
    in_reach = F.filter(F.array(*buckets), lambda b: F.col("floor") <= F.col("length") * b["longest"])
    asked = (
        anchors.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
        .withColumn("to", F.explode(in_reach)).withColumn("bucket", F.col("to.bucket"))
        .withColumn("part", _numbers_below(F.col("to.parts"))).drop("to")
    )
    known = F.create_map(*[x for b, n in parts.items() for x in (F.lit(b), F.lit(n).cast("long"))])
    held = probes.withColumn("part", F.pmod(F.xxhash64("row"), known[F.col("bucket")])).withColumn("chunk", _numbers_below(F.lit(chunks).cast("long")))
    return _meet(asked, held, ["bucket", "part", "chunk"], work, MINED)


def _leading(df: DataFrame, keys: list[str], score: str, tie: str, count: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    return df.withColumn("rank", place).where(F.col("rank") <= count)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    ``rows`` has vec_id, label and ``vector``, an array of whole numbers; ``anchor`` says which
    rows are anchors. Rows without an id, label or vector take no part. Rows equal in all three
    count once; different rows of one id all take part. Where vectors differ in length the
    shorter ends in zeros. An anchor's positives are the first other rows of its label by
    falling product, ties by smaller id; its negatives for a positive are the first rows of
    other labels with ``low`` * positive <= 100 * negative <= ``high`` * positive. A score
    beyond a long raises. An empty table, or one without anchors, gives no rows.
    """
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    named = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>"), anchor.alias("anchor"))
    named = cut(named.dropna(subset=["vec_id", "label", "vector"]).distinct().withColumns({"length": length, "row": F.monotonically_increasing_id()}))
    total, widest = named.agg(F.count("*"), F.max(F.size("vector"))).head()
    limits = order_limits(named, F.col("length"), min(MOST_LENGTHS, -(-total // BLOCK_ROWS)))
    longer = F.array(*[F.lit(x) for x in limits]) if limits else F.array().cast("array<double>")
    probes = named.withColumn("bucket", F.size(F.filter(longer, lambda x: x >= F.col("length")))).drop("anchor")
    seed_rows = min(SEED_ROWS, SEED_NUMBERS // max(1, widest or 0))
    seed = named.orderBy(F.xxhash64("row")).limit(seed_rows).select("row", "label", "vector").toArrow()
    asking = named.where("anchor").drop("anchor")

    found = _search_labels(_with_floor(asking, seed, positives), probes, partial(_find_positives, count=positives))
    found = _leading(found, ["row"], "score", "positive_id", positives)
    listed = F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score")))  # at most ``positives`` of an anchor
    found = found.groupBy("row").agg(listed.alias("found")).select("row", F.col("found.positive_id").alias("positives"), F.col("found.score").alias("positive_scores"))
    asking = cut(_with_floor(asking.join(found, "row"), seed, negatives, (low, high)).where(F.col("floor") < float("inf")))

    mined = _search_all(asking, probes, partial(_find_negatives, count=negatives, low=low, high=high))
    return _leading(mined, ["row", "place"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every fiftieth row of ``embeddings`` among all its rows; odd rows as in ``mine``.

    Where vec_id is divisible by 7 the label moves on to the next of ten, which makes false
    labels; components are floor(256 x), and a vector with a null or a number that isn't finite
    takes no part.
    """
    label = F.col("label").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        quantized(F.col("embedding")).alias("vector"),
    )
    return mine(rows, F.col("vec_id") % 50 == 0)


SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM given a JOIN given b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, positive_score, s.other_id AS negative_id, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INT AS rank
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.alike
 AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""
