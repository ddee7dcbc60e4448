"""The cheap screen: constraints, prices and violation magnitudes.

Constraints are a long table (constraint_key, kind, pos, condition_id). Prices
arrive with one shuffle on condition_id, sums with one shuffle on constraint_key;
both sides combine before they travel, so a partition with a third of all members
is one partial sum per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsgraph.operators.relations import live_markets
from oddsgraph.scale import top

# Fixed value: half a cent.
DEFAULT_EPSILON = 0.005


def constraint_members(relations: DataFrame, groups: DataFrame, members: DataFrame, markets: DataFrame) -> DataFrame:
    """Members of every constraint that are live markets, in entailment order.

    ``relations`` has id, from, to and type; pairwise members keep pos 0 and 1.
    Constraints that lost a member are dropped by ``evaluate``.
    """
    kind = F.when(F.col("type") == "complement", "complement").otherwise("implies")
    ends = F.array(
        F.struct(F.lit(0).alias("pos"), F.col("from_condition_id").alias("condition_id")),
        F.struct(F.lit(1).alias("pos"), F.col("to_condition_id").alias("condition_id")),
    )
    pairwise = relations.select(
        F.concat(kind, F.lit(":"), F.col("id").cast("string")).alias("constraint_key"),
        kind.alias("kind"),
        F.inline(ends),
    )
    parts = groups.where(F.col("type") == "partition").select("group_id")
    group_key = F.col("group_id").cast("string")
    grouped = members.join(parts, "group_id", "left_semi").select(
        F.when(group_key.startswith("partition:"), group_key)
        .otherwise(F.concat(F.lit("partition:"), group_key))
        .alias("constraint_key"),
        F.lit("partition").alias("kind"),
        F.lit(0).alias("pos"),
        "condition_id",
    )
    live = live_markets(markets).select("condition_id")
    return pairwise.unionByName(grouped).join(live, "condition_id", "left_semi")


def complete_constraints(members: DataFrame) -> DataFrame:
    """Keys that still have all the members they need, with the member count."""
    counted = members.groupBy("constraint_key", "kind").agg(F.count("*").alias("members"))
    return counted.where(
        F.when(F.col("kind") == "partition", F.col("members") > 1).otherwise(F.col("members") == 2)
    )


def cached_quotes(quotes: DataFrame) -> DataFrame:
    """Finite stored prices of the first outcome."""
    price = F.col("yes_price").cast("double")
    return quotes.select("condition_id", price.alias("price")).where(
        F.col("price").isNotNull() & ~F.isnan("price") & (F.abs("price") != float("inf"))
    )


def pricing_tokens(markets: DataFrame) -> DataFrame:
    """The token of the first outcome, which every relation is about."""
    return markets.select(
        "condition_id", F.try_element_at("clob_token_ids", F.lit(1)).alias("token_id")
    ).where(F.col("token_id").isNotNull() & (F.col("token_id") != ""))


def screen_prices(markets: DataFrame, quotes: DataFrame, live_mids: DataFrame | None = None) -> DataFrame:
    """(condition_id, price, price_source): live mid where there is one, else the quote."""
    cached = cached_quotes(quotes)
    if live_mids is None:
        return cached.withColumn("price_source", F.lit("cached"))
    mids = live_mids.where(F.col("mid").isNotNull() & ~F.isnan("mid")).select("token_id", "mid")
    live = pricing_tokens(markets).join(mids, "token_id").select("condition_id", "mid")
    both = cached.join(live, "condition_id", "full_outer")
    return both.select(
        "condition_id",
        F.coalesce("mid", "price").alias("price"),
        F.when(F.col("mid").isNotNull(), "live").otherwise("cached").alias("price_source"),
    )


def price_source_counts(prices: DataFrame) -> DataFrame:
    return prices.agg(
        F.count_if(F.col("price_source") == "live").alias("live"),
        F.count_if(F.col("price_source") == "cached").alias("fallback"),
    )


def attach_prices(members: DataFrame, prices: DataFrame) -> DataFrame:
    """Price per member; null where there is none, never a default."""
    return members.join(prices.select("condition_id", "price"), "condition_id", "left")


def evaluate(priced: DataFrame, epsilon: float = DEFAULT_EPSILON) -> DataFrame:
    """One row per constraint: magnitude, direction, violated, unscreenable, total.

    implies is signed P(A) − P(B); complement and partition are |sum − 1|.
    """
    price = F.when(~F.isnan("price"), F.col("price"))
    per_key = priced.groupBy("constraint_key", "kind").agg(
        F.count("*").alias("members"),
        F.count_if(price.isNull()).alias("unpriced"),
        F.sum(price).alias("total"),
        F.max(F.when(F.col("pos") == 0, price)).alias("p_from"),
        F.max(F.when(F.col("pos") == 1, price)).alias("p_to"),
        F.min_by("condition_id", F.struct("pos", "condition_id")).alias("first_condition_id"),
    )
    per_key = per_key.where(
        F.when(F.col("kind") == "partition", F.col("members") > 1).otherwise(F.col("members") == 2)
    )
    implies = F.col("kind") == "implies"
    screenable = F.col("unpriced") == 0
    gap = F.when(implies, F.col("p_from") - F.col("p_to")).otherwise(F.col("total") - 1)
    size = F.when(implies, gap).otherwise(F.abs(gap))
    violated = screenable & (size > epsilon)
    return per_key.select(
        "constraint_key",
        "kind",
        "members",
        "first_condition_id",
        F.when(screenable, size).otherwise(0.0).alias("magnitude"),
        F.when(violated, F.when(gap > 0, "over").otherwise("under")).alias("direction"),
        violated.alias("violated"),
        (~screenable).alias("unscreenable"),
        F.when(screenable & ~implies, F.col("total")).alias("total"),
    )


def violations(evaluations: DataFrame) -> DataFrame:
    """Violated constraints; ``magnitude`` is also the gross edge per unit."""
    return evaluations.where("violated").withColumn("gross_edge", F.col("magnitude"))


def screen_stats(evaluations: DataFrame) -> DataFrame:
    return evaluations.agg(
        F.count("*").alias("evaluated"),
        F.count_if(~F.col("violated") & ~F.col("unscreenable")).alias("satisfied"),
        F.count_if("violated").alias("violated"),
        F.count_if("unscreenable").alias("unscreenable"),
    )


def promote(evaluations: DataFrame, budget: int | None = None) -> DataFrame:
    """The violations to confirm: all, or the worst ``budget`` of them."""
    return top(violations(evaluations), budget, F.desc("magnitude"), "constraint_key")


def basket_legs(promoted: DataFrame, members: DataFrame) -> DataFrame:
    """Legs to buy: (constraint_key, leg, condition_id, outcome_index, payout).

    implies buys No(A) and Yes(B); an underpriced set every Yes; an overpriced set
    every No, which pays n − 1.
    """
    chosen = promoted.select("constraint_key", "direction", F.col("members").alias("n"))
    legs = members.join(chosen, "constraint_key")
    implies = F.col("kind") == "implies"
    no = F.when(implies, F.col("pos") == 0).otherwise(F.col("direction") == "over")
    payout = F.when(implies | (F.col("direction") == "under"), 1.0).otherwise((F.col("n") - 1).cast("double"))
    return legs.select(
        "constraint_key",
        "kind",
        "direction",
        F.struct("pos", "condition_id").alias("leg"),
        "condition_id",
        F.when(no, 1).otherwise(0).alias("outcome_index"),
        payout.alias("payout"),
    )
