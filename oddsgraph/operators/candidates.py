"""Candidate pairs from vector similarity, minus everything already known.

The search is exact. Identical vectors are folded first; the rest is searched in a
``metric_tree``. Only the best ``k`` partners per row leave a task, never the
compared pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsgraph.functions.text import collapse_spaces
from oddsgraph.operators import metric_tree
from oddsgraph.operators.graph import implication_edges, reach_index, reachable
from oddsgraph.operators.relations import canonical_pair, one_row
from oddsgraph.scale import top
from oddsgraph.session import cut

# Similarity floor and neighbours per market.
THRESHOLD = 0.82
NEIGHBOURS = 8
BLOCK_ROWS = metric_tree.CELL_ROWS


def embedding_text(question: Column) -> Column:
    return collapse_spaces(question)


def stale_embeddings(markets: DataFrame, stored: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Markets whose vector is missing for this model or was made from other content."""
    wanted = markets.select("condition_id", "content_hash", embedding_text(F.col("question")).alias("text"))
    if force:
        return wanted
    have = stored.where(F.col("model") == model).select("condition_id", "content_hash")
    return wanted.join(have, ["condition_id", "content_hash"], "left_anti")


def merge_embeddings(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored vectors with the fresh ones put in; one per market."""
    return stored.join(fresh, "condition_id", "left_anti").unionByName(fresh)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; 0 when the lengths differ."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return F.when(F.size(a) == F.size(b), dot).otherwise(0.0)


def nearest_neighbours(
    embeddings: DataFrame,
    k: int = NEIGHBOURS,
    threshold: float = THRESHOLD,
    same_event: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(source_id, target_id, similarity): each market's k best partners at or above the threshold."""
    scope = F.coalesce(F.col("event_id").cast("string"), F.lit("")) if same_event else F.lit("")
    vectors = embeddings.where(F.col("embedding").isNotNull())
    if same_event:
        vectors = vectors.where(scope != "")
    # Vectors of different lengths have no similarity.
    vectors = vectors.select(
        F.col("condition_id").cast("string").alias("condition_id"), F.concat_ws(":", F.size("embedding"), scope).alias("scope"), "embedding"
    )
    # Copies: any source needs at most the k + 1 smallest ids of a group, so only those travel.
    copies = Window.partitionBy("scope", "embedding").orderBy("condition_id")
    targets = vectors.withColumn("rank", F.row_number().over(copies)).where(F.col("rank") <= k + 1)
    reps = vectors.groupBy("scope", "embedding").agg(F.min("condition_id").alias("rep"))
    targets = targets.join(reps, ["scope", "embedding"]).select("scope", "rep", F.col("condition_id").alias("target_id"))
    members = vectors.join(reps, ["scope", "embedding"]).select("scope", "rep", F.col("condition_id").alias("source_id"))

    reps = cut(reps)
    hits = metric_tree.nearest(reps.withColumnRenamed("embedding", "vector"), k, threshold, block_rows)
    own = reps.select("scope", "rep", F.col("rep").alias("other"), F.lit(1.0).alias("similarity"))
    best = Window.partitionBy("scope", "rep").orderBy(F.desc("similarity"), "target_id")
    lists = (
        hits.unionByName(own)
        .join(targets.withColumnRenamed("rep", "other"), ["scope", "other"])
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k + 1)
        .select("scope", "rep", "target_id", "similarity")
    )
    mine = Window.partitionBy("source_id").orderBy(F.desc("similarity"), "target_id")
    return (
        members.join(lists, ["scope", "rep"])
        .where("source_id <> target_id")
        .withColumn("rank", F.row_number().over(mine))
        .where(F.col("rank") <= k)
        .select("source_id", "target_id", "similarity")
    )


def fold_pairs(neighbours: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(low_condition_id, high_condition_id, similarity): each unordered pair once."""
    low, high = canonical_pair(F.col("source_id"), F.col("target_id"))
    return (
        neighbours.where(F.col("similarity") >= threshold)
        .groupBy(low.alias("low_condition_id"), high.alias("high_condition_id"))
        .agg(F.max("similarity").alias("similarity"))
    )


def uncovered_pairs(pairs: DataFrame, relations: DataFrame, members: DataFrame, proposals: DataFrame) -> DataFrame:
    """Pairs not linked by an edge or an implication path, not in one partition, never proposed.

    Reachability is asked for the given pairs only, both ways round.
    """
    key = ["low_condition_id", "high_condition_id"]
    low, high = canonical_pair(F.col("from_condition_id"), F.col("to_condition_id"))
    edges = relations.select(low.alias(key[0]), high.alias(key[1])).distinct()
    left = pairs.join(edges, key, "left_anti")
    left = left.join(proposals.select(*key).distinct(), key, "left_anti")
    at_low = members.select("group_id", F.col("condition_id").alias(key[0]))
    at_high = members.select("group_id", F.col("condition_id").alias(key[1]))
    together = left.select(*key).join(at_low, key[0]).join(at_high, ["group_id", key[1]], "left_semi").select(*key).distinct()
    left = left.join(together, key, "left_anti")
    index = reach_index(implication_edges(relations), acyclic=False)
    asked = left.select(F.col(key[0]).alias("src"), F.col(key[1]).alias("dst"))
    both = asked.unionByName(asked.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    linked = reachable(index, both)
    pair_low, pair_high = canonical_pair(F.col("src"), F.col("dst"))
    return left.join(linked.select(pair_low.alias(key[0]), pair_high.alias(key[1])).distinct(), key, "left_anti")


def ordered_candidates(pairs: DataFrame, limit: int | None = None, order: str = "similarity") -> DataFrame:
    """All pairs, or the first: most similar, or a uniform sample by the hash of the pair ('spread')."""
    key = ["low_condition_id", "high_condition_id"]
    if order == "spread":
        return top(pairs, limit, F.md5(F.concat(*key)), *key)
    return top(pairs, limit, F.desc("similarity"), *key)


def embedding_counts(markets: DataFrame, pending: DataFrame) -> DataFrame:
    both = one_row(markets.agg(F.count("*").alias("total")), pending.agg(F.count("*").alias("embedded")))
    return both.select("embedded", (F.col("total") - F.col("embedded")).alias("skipped"))
