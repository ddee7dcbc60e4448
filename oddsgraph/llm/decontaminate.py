"""Benchmark passages in documents, by SimHash of windows the size of an item.

Lengths are counted in shingles of five words. Every window of a document that is as long
as some item and shares at least one shingle with an item of that length gets a
fingerprint; a window that shares none cannot be similar, so nothing is lost. Multi-index
Hamming blocks find all items of that length whose fingerprint is within the radius, and
the exact similarity of the two shingle multisets decides. All of it is DataFrame work.

At a similarity of 0.8 two fingerprints differ in 9.7 of 64 bits on average, with a
deviation of 2.9; the radius of 17 bits misses three such windows in a thousand, and the
closer ones far less often.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsgraph.llm.common import cut, let, read_documents

WORDS = 5
SIMILARITY = 0.8
RADIUS = 17
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
"""(first bit, bits) of each block: within the radius, one block differs in at most radius // 6 bits."""
BROADCAST_ROWS = 1_000_000
_LANES = 16
_LANE_ONES = 0x0001000100010001


def word_list(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column, words: int = WORDS) -> Column:
    """A hash for each run of ``words`` words, in order; of fewer words one of all, of none none."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        one = F.when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= words, each).otherwise(one)

    return let(word_list(F.coalesce(text, F.lit(""))), runs)


def _tally(hashes: Column) -> Column:
    """How often each bit is set, in 16 numbers of four lanes of 16 bits."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"s{j}") for j in range(_LANES)])

    def add(acc: Column, h: Column) -> Column:
        return F.struct(*[(acc[f"s{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANE_ONES))).alias(f"s{j}") for j in range(_LANES)])

    return F.aggregate(hashes, zero, add)


def _majority(tally: Column, n: Column) -> Column:
    """The bits set in over half of ``n`` hashes. Lanes hold up to 65,535 shingles, the longest item allowed."""

    def bit(j: int, lane: int) -> Column:
        count = F.shiftrightunsigned(tally[f"s{j}"], 16 * lane).bitwiseAND(F.lit(0xFFFF))
        place = j + 16 * lane
        return F.when(count * 2 > n, F.lit(1 << place if place < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))

    return reduce(lambda a, b: a.bitwiseOR(b), [bit(j, lane) for lane in range(4) for j in range(_LANES)])


def numbered(hashes: Column) -> Column:
    """Repeats made different by their occurrence number, so that a multiset becomes a set."""
    earlier = lambda h, i: F.size(F.filter(F.slice(hashes, 1, i), lambda x: x == h))
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.when(i > 0, earlier(h, i)).otherwise(0)))


def _fingerprinted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fp`` of the shingles in ``part``."""
    return rows.withColumn("__tally", _tally(F.col("part"))).withColumn("fp", _majority(F.col("__tally"), F.size("part"))).drop("__tally")


def _block(fp: Column, k: int) -> Column:
    first, bits = BLOCKS[k]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _within(bits: int, radius: int) -> Column:
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]
    return F.array(*[F.lit(m).cast("long") for m in masks])


def _bounded(table: DataFrame) -> DataFrame:
    """Broadcast only if its rows, which are already written, are counted and few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _parts(anchors: DataFrame) -> list[DataFrame]:
    """The anchors in parts small enough to broadcast. A benchmark of any size costs a pass for each million."""
    n = max(1, -(-anchors.count() // BROADCAST_ROWS))
    return [anchors.where(F.pmod("h", F.lit(n)) == k) for k in range(n)]


def benchmark_index(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items with shingles, their distinct shingles by length, fingerprint blocks with their Hamming balls)."""
    base = items.select(F.col("item_id").cast("long").alias("item_id"), shingles(F.col("text")).alias("part"))
    base = base.where(F.col("item_id").isNotNull() & F.size("part").between(1, 65_535)).dropDuplicates(["item_id", "part"])
    known = cut(_fingerprinted(base).select("item_id", F.size("part").alias("m"), "fp", numbered(F.col("part")).alias("goal"), "part"))
    anchors = cut(known.select("m", F.explode("part").alias("h")).distinct())

    def ball(k: int) -> Column:
        values = F.transform(_within(BLOCKS[k][1], RADIUS // len(BLOCKS)), lambda x: _block(F.col("fp"), k).bitwiseXOR(x))
        return F.struct(F.lit(k).alias("block"), values.alias("values"))

    balls = F.array(*[ball(k) for k in range(len(BLOCKS))])
    index = known.select("m", "fp", "item_id", F.explode(balls).alias("ball"))
    index = index.select("m", F.col("fp").alias("goal_fp"), "item_id", "ball.block", F.explode("ball.values").alias("value"))
    return known.select("item_id", "goal"), anchors, cut(index)


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, first_shingle): the best window for each document and item in it.

    ``items`` has item_id and text. Similarity is the weighted Jaccard similarity of the
    shingle multisets, a shingle weighing as often as it occurs. A document shorter than an
    item is one window. Null and empty texts match nothing; an item of fewer than five
    words matches only a document of just those words. Items without item_id are not sought;
    repeated items count once. A row without doc_id is named by its
    text_hash alone, and repeated rows come out once.
    """
    goals, anchors, index = benchmark_index(items)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    # The shingles of a row stay beside each of its places, unread unless an anchor matches there.
    settled = base.select("doc_id", "text_hash", F.explode(F.array(shingles(F.col("text")))).alias("all"))
    places = settled.select("*", F.posexplode("all").alias("pos", "h"))
    m, first = F.col("m"), F.greatest(F.col("pos") - F.col("m") + 1, F.lit(0))
    around = F.slice("all", first + 1, F.col("pos") + m - first)
    hits = reduce(DataFrame.union, [places.join(F.broadcast(part), "h").select("doc_id", "text_hash", "m", "pos", first.alias("first"), around.alias("some"), F.size("all").alias("n")) for part in _parts(anchors)])
    # A window belongs to the first hit in it: those that begin after the hit before. A repeated row brings none.
    before = F.lag("pos").over(Window.partitionBy("doc_id", "text_hash", "m").orderBy("pos"))
    parts = hits.withColumn("low", F.greatest(F.coalesce(before + 1, F.lit(0)), F.col("first")))
    # The last window ends with the document; one window if the document is shorter than the item.
    last = F.least(F.col("pos"), F.greatest(F.col("n") - F.col("m"), F.lit(0)))
    starts = F.when(F.col("low") <= last, F.sequence(F.col("low"), last)).otherwise(F.array().cast("array<int>"))
    window = lambda s: F.struct(s.alias("start"), F.slice("some", s - F.col("first") + 1, F.col("m")).alias("part"))
    windows = parts.select("doc_id", "text_hash", "m", F.explode(F.transform(starts, window)).alias("w"))
    windows = _fingerprinted(windows.select("doc_id", "text_hash", "m", "w.start", "w.part"))
    keys = F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col("fp"), k).alias("value")) for k in range(len(BLOCKS))])
    probes = windows.select("*", F.explode(keys).alias("k")).select(*windows.columns, "k.block", "k.value")
    apart = F.col("fp").bitwiseXOR(F.col("goal_fp"))
    # Several blocks may find one item; the first of them reports it.
    earlier = [(F.col("block") > k) & (F.bit_count(_block(apart, k)) <= RADIUS // len(BLOCKS)) for k in range(len(BLOCKS) - 1)]
    close = probes.join(_bounded(index), ["m", "block", "value"]).where((F.bit_count(apart) <= RADIUS) & ~reduce(lambda a, b: a | b, earlier))
    both = close.join(_bounded(goals), "item_id").withColumn("common", F.size(F.array_intersect(numbered(F.col("part")), F.col("goal"))))
    share = F.col("common") / (F.size("part") + F.size("goal") - F.col("common"))
    sure = both.select("doc_id", "text_hash", "item_id", "start", share.alias("similarity")).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return sure.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id", "text_hash", "item_id", "best.similarity", (-F.col("best.back")).alias("first_shingle")
    )


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    found = cut(contaminated(docs, items, similarity).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(found, same, "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(read_documents(spark, sf_dir), items).drop("text_hash")
