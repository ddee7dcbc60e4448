"""Pricing on order-book depth.

Books are a long table (token_id, side, price, size) with side 'bid' or 'ask'.
Equal prices are merged first, as the venue does, so a book side holds at most as
many rows as the tick grid of (0, 1] (1,000 at the finest tick), however many
orders rest on it. Walks and sweeps are running totals over those rows and
single-pass aggregates, never iterative solvers. A basket has no such bound on its
legs, so its sweep uses order buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsgraph.functions.fees import (
    DEFAULT_TAKER_FEE_RATE,
    FALLBACK_MIN_ORDER_SIZE,
    taker_fee,
    unit_cost,
)
from oddsgraph.scale import last_before, next_row, running_totals
from oddsgraph.session import cut

# What counts as a meaningful trade.
MIN_NET_PROFIT = 1.0
MIN_NET_EDGE = 0.005
FILL_TOLERANCE = 1e-9


def usable(price: Column, size: Column) -> Column:
    return (price > 0) & (price <= 1) & (size > 0) & ~F.isnan(price) & ~F.isnan(size)


def merged_levels(levels: DataFrame) -> DataFrame:
    """Usable levels with equal prices of a side added up."""
    return (
        levels.where(usable(F.col("price"), F.col("size")))
        .groupBy("token_id", "side", "price")
        .agg(F.sum("size").alias("size"))
    )


def cumulative_levels(levels: DataFrame, buckets: int | None = 1) -> DataFrame:
    """Levels best first with ``cum`` and ``cum_notional`` up to and including each."""
    ranked = merged_levels(levels).select(
        "*",
        F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price")).alias("rank_price"),
        (F.col("price") * F.col("size")).alias("notional"),
    )
    return running_totals(
        ranked, ["token_id", "side"], "rank_price", ["size", "notional"], "cum_", "total_", buckets
    )


def walk_orders(orders: DataFrame, levels: DataFrame, buckets: int | None = 1) -> DataFrame:
    """What each order would cost, level by level.

    ``orders``: order_id, token_id, action ('buy' takes asks, 'sell' hits bids),
    size, and optionally fee_rate and limit_price.
    """
    if "fee_rate" not in orders.columns:
        orders = orders.withColumn("fee_rate", F.lit(DEFAULT_TAKER_FEE_RATE))
    if "limit_price" not in orders.columns:
        orders = orders.withColumn("limit_price", F.lit(None).cast("double"))
    side = F.when(F.col("action") == "buy", "ask").otherwise("bid")
    asked = orders.select(
        "order_id", "token_id", "action", side.alias("side"),
        F.when((F.col("size") > 0) & ~F.isnan("size"), F.col("size")).otherwise(0.0).alias("wanted"),
        "fee_rate", "limit_price",
    )
    book = cumulative_levels(levels, buckets).select(
        "token_id", "side", "price", "size", "rank_price", F.col("cum_size").alias("cum")
    )
    filled = asked.join(book, ["token_id", "side"], "left")
    before = F.col("cum") - F.col("size")
    within = F.col("limit_price").isNull() | F.when(
        F.col("action") == "buy", F.col("price") <= F.col("limit_price")
    ).otherwise(F.col("price") >= F.col("limit_price"))
    take = F.when(within, F.greatest(F.lit(0.0), F.least(F.col("size"), F.col("wanted") - before))).otherwise(0.0)
    filled = filled.withColumn("take", F.coalesce(take, F.lit(0.0)))
    hit = F.col("take") > 0
    per = filled.groupBy("order_id", "token_id", "action", "wanted").agg(
        F.sum("take").alias("filled"),
        F.sum(F.coalesce(F.col("take") * F.col("price"), F.lit(0.0))).alias("notional"),
        F.sum(F.coalesce(taker_fee(F.col("take"), F.col("price"), F.col("fee_rate")), F.lit(0.0))).alias("fee"),
        F.min_by("price", "rank_price").alias("touch"),
        F.max_by(F.when(hit, F.col("price")), F.when(hit, F.col("rank_price"))).alias("worst_price"),
        F.count_if(hit).alias("levels_consumed"),
    )
    some = F.col("filled") > 0
    avg = F.col("notional") / F.col("filled")
    total = F.when(F.col("action") == "buy", F.col("notional") + F.col("fee")).otherwise(
        F.col("notional") - F.col("fee")
    )
    return per.select(
        "order_id",
        "token_id",
        "action",
        F.col("wanted").alias("size"),
        F.when(some, avg).alias("avg_price"),
        "filled",
        F.greatest(F.lit(0.0), F.col("wanted") - F.col("filled")).alias("unfilled"),
        F.when(some, slippage(avg, F.col("touch"), F.col("action"))).alias("slippage"),
        "notional",
        "fee",
        F.when(some, total).otherwise(0.0).alias("total_cost"),
        F.when(some, total / F.col("filled")).alias("effective_price"),
        F.when(some, F.col("worst_price")).alias("worst_price"),
        "levels_consumed",
        (some & (F.col("filled") < F.col("wanted"))).alias("partial"),
    )


def slippage(avg_price: Column, touch: Column, action: Column) -> Column:
    """Signed fraction by which the fill is worse than the touch; positive is worse."""
    worse = F.when(action == "buy", avg_price - touch).otherwise(touch - avg_price)
    return F.when(touch > 0, worse / touch)


def available_depth(levels: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Shares resting per (token_id, side), optionally out to a (token_id, side, limit_price)."""
    ok = levels.where(usable(F.col("price"), F.col("size")))
    if limits is not None:
        ok = ok.join(limits, ["token_id", "side"]).where(
            F.when(F.col("side") == "ask", F.col("price") <= F.col("limit_price")).otherwise(
                F.col("price") >= F.col("limit_price")
            )
        )
    return ok.groupBy("token_id", "side").agg(F.sum("size").alias("depth"))


def size_within_slippage(levels: DataFrame, max_slippage: float, buckets: int | None = 1) -> DataFrame:
    """Largest size per (token_id, side) whose average price stays within the slippage.

    The average price rises with size, so inside each level the limit is a linear
    equation; the answer is the furthest level that still satisfies it.
    """
    book = cumulative_levels(levels, buckets)
    touch = book.groupBy("token_id", "side").agg(F.min("rank_price").alias("t"))
    q, end = F.col("rank_price"), F.col("cum_size")
    before = end - F.col("size")
    spent = F.when(F.col("side") == "ask", 1.0).otherwise(-1.0) * (F.col("cum_notional") - F.col("notional"))
    target = F.col("t") + F.abs("t") * max_slippage
    cut_off = (q * before - spent) / (q - target)
    reach = F.when(q <= target, end).otherwise(F.least(end, cut_off))
    return (
        book.join(touch, ["token_id", "side"])
        .where(reach >= before)
        .groupBy("token_id", "side")
        .agg(F.max(reach).alias("size"))
    )


# --- tops and snapshots ---------------------------------------------------------------------


def top_of_levels(levels: DataFrame) -> DataFrame:
    """bid, ask, mid and spread per token; mid and spread only when two-sided."""
    ok = levels.where(usable(F.col("price"), F.col("size")))
    top = ok.groupBy("token_id").agg(
        F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("bid"),
        F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("ask"),
    )
    return top.select(
        "*", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread")
    )


def top_of_book(bids: Column, asks: Column) -> Column:
    """The same for best-first arrays: struct(bid, ask, mid, spread)."""
    bid = F.try_element_at(bids, F.lit(1))["price"]
    ask = F.try_element_at(asks, F.lit(1))["price"]
    return F.struct(
        bid.alias("bid"), ask.alias("ask"), ((bid + ask) / 2).alias("mid"), (ask - bid).alias("spread")
    )


def _side_depth(side: Column) -> Column:
    return F.aggregate(F.coalesce(side, F.array()), F.lit(0.0), lambda acc, x: acc + x["size"])


def snapshot_rows(books: DataFrame, ts: Column, depth: int | None = None, source: str = "book") -> DataFrame:
    """Books to stored rows: whole sides or their best ``depth`` levels, depth totals over the whole book."""
    top = top_of_book(F.col("bids"), F.col("asks"))
    scaled = [F.col("__top")[c].cast("decimal(18,8)").alias(c) for c in ("bid", "ask", "mid", "spread")]
    rows = books.where(F.col("condition_id").isNotNull() & (F.col("condition_id") != ""))
    rows = rows.withColumn("__top", top)
    out = rows.select(
        "condition_id",
        "token_id",
        ts.alias("ts"),
        *scaled,
        *[(F.col(side) if depth is None else F.slice(side, 1, depth)).alias(side) for side in ("bids", "asks")],
        _side_depth(F.col("bids")).cast("decimal(24,8)").alias("bid_depth"),
        _side_depth(F.col("asks")).cast("decimal(24,8)").alias("ask_depth"),
        F.col("timestamp").alias("book_ts"),
        F.col("hash").alias("book_hash"),
        F.lit(source).alias("source"),
    )
    return out.dropDuplicates(["condition_id", "token_id", "ts"])


def levels_of(books: DataFrame, *keep: str) -> DataFrame:
    """Book or snapshot arrays back to levels, ready for every operator here."""
    sides = F.array(
        F.struct(F.lit("bid").alias("side"), F.col("bids").alias("levels")),
        F.struct(F.lit("ask").alias("side"), F.col("asks").alias("levels")),
    )
    out = books.select("token_id", *keep, F.inline(sides))
    return out.select("token_id", *keep, "side", F.inline("levels")).select(
        "token_id", *keep, "side", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size")
    )


def books_as_of(snapshots: DataFrame, at: Column) -> DataFrame:
    """The last stored book of each token at or before ``at``."""
    cols = [c for c in snapshots.columns if c not in ("token_id",)]
    last = snapshots.where(F.col("ts") <= at).groupBy("token_id").agg(
        F.max_by(F.struct(*cols), F.col("ts")).alias("s")
    )
    return last.select("token_id", "s.*")


def books_at(orders: DataFrame, snapshots: DataFrame, buckets: int | None = None) -> DataFrame:
    """Orders (token_id, ts, ...) with the stored book of their token at their own time.

    Adds ``book_`` + each column of the snapshot but token_id; null where none was stored yet.
    """
    carry = [c for c in snapshots.columns if c != "token_id"]
    return last_before(orders, snapshots, ["token_id"], "ts", carry, "book_", buckets)


# --- correcting baskets ---------------------------------------------------------------------


def locate_legs(legs: DataFrame, markets: DataFrame, book_meta: DataFrame) -> DataFrame:
    """Token, outcome label and book facts of every leg.

    ``book_meta`` has one row per returned book: token_id, min_order_size.
    """
    tokens = markets.select(
        "condition_id",
        F.posexplode("clob_token_ids").alias("outcome_index", "token_id"),
        "outcomes",
    ).select(
        "condition_id", "outcome_index", "token_id",
        F.try_element_at("outcomes", F.col("outcome_index") + 1).alias("outcome"),
    )
    meta = book_meta.select("token_id", F.col("min_order_size").cast("double"), F.lit(True).alias("has_book"))
    return legs.join(tokens, ["condition_id", "outcome_index"], "left").join(meta, "token_id", "left")


def price_baskets(
    legs: DataFrame,
    levels: DataFrame,
    fee_rate: float = DEFAULT_TAKER_FEE_RATE,
    min_size: float = FALLBACK_MIN_ORDER_SIZE,
    min_net_profit: float = MIN_NET_PROFIT,
    min_net_edge: float = MIN_NET_EDGE,
    buckets: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Best correcting trade per constraint: (one row per constraint, one row per leg).

    ``legs`` come from ``locate_legs``. Profit N·payout − Σ cost is concave and
    piecewise linear in N, so its slope changes at level ends are collected per
    constraint; running sums of the changes give profit and slope at every
    breakpoint, and the best and the largest profitable size are aggregates.
    """
    legs = cut(legs)  # legs, levels and sizes are each read by several branches below
    wanted_tokens = legs.select("token_id").distinct()
    offered = levels.where("side = 'ask'").join(wanted_tokens, "token_id", "left_semi")
    asks = cumulative_levels(offered)
    asks = next_row(asks, ["token_id", "side"], "rank_price", ["price"], buckets=buckets)
    asks = cut(
        asks.select(
            "token_id", "price", "size", F.col("cum_size").alias("cum"), "next_price",
            F.col("total_size").alias("depth"),
        )
    )
    depths = asks.groupBy("token_id").agg(F.max("depth").alias("depth"), F.min("price").alias("touch"))
    placed = legs.join(depths, "token_id", "left")
    problem = (
        F.when(F.col("token_id").isNull(), "missing-token")
        .when(F.col("has_book").isNull(), "missing-book")
        .when(F.col("depth").isNull(), "empty-book")
    )
    where = F.struct("condition_id", "outcome_index")
    basket = placed.groupBy("constraint_key", "kind", "direction").agg(
        F.max("payout").alias("payout"),
        F.count("*").alias("legs"),
        F.min_by(F.when(problem.isNotNull(), F.struct(problem.alias("code"), where.alias("at"))), F.when(problem.isNotNull(), F.col("leg"))).alias("missing"),
        F.min("depth").alias("ceiling"),
        F.greatest(F.lit(float(min_size)), F.coalesce(F.max("min_order_size"), F.lit(0.0))).alias("floor"),
    )
    usable_baskets = basket.where("missing is null and ceiling >= floor")

    c = unit_cost(F.col("price"), fee_rate)
    c_next = unit_cost(F.col("next_price"), fee_rate)
    first = F.col("cum") == F.col("size")
    bends = asks.select(
        "token_id",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(first, F.struct(F.lit(0.0).alias("n"), (-c).alias("bend"))),
                    F.when(
                        F.col("next_price").isNotNull(), F.struct(F.col("cum").alias("n"), (c - c_next).alias("bend"))
                    ),
                )
            )
        ),
    )
    start = usable_baskets.select("constraint_key", F.lit(0.0).alias("n"), F.col("payout").alias("bend"))
    points = (
        legs.select("constraint_key", "token_id")
        .join(usable_baskets.select("constraint_key"), "constraint_key", "left_semi")
        .join(bends, "token_id")
        .select("constraint_key", "n", "bend")
        .unionByName(start)
        .groupBy("constraint_key", "n")
        .agg(F.sum("bend").alias("a"))
        .withColumn("b", F.col("a") * F.col("n"))
    )
    curve = running_totals(points, ["constraint_key"], "n", ["a", "b"], "s", None, buckets)
    curve = curve.join(
        usable_baskets.select("constraint_key", "floor", F.col("ceiling").alias("cap")), "constraint_key"
    )
    n, slope, profit = F.col("n"), F.col("sa"), F.col("n") * F.col("sa") - F.col("sb")
    line = F.struct(F.col("sa"), F.col("sb"))
    sized = curve.groupBy("constraint_key").agg(
        F.max_by(F.when(n <= F.col("floor"), line), F.when(n <= F.col("floor"), n)).alias("at_floor"),
        F.max_by(F.when(n <= F.col("cap"), line), F.when(n <= F.col("cap"), n)).alias("at_cap"),
        F.max_by(
            F.when((n < F.col("cap")) & ((n <= F.col("floor")) | (profit > 0)), line),
            F.when((n < F.col("cap")) & ((n <= F.col("floor")) | (profit > 0)), n),
        ).alias("crossing"),
        F.min(F.when(slope <= 0, n)).alias("peak"),
        F.max("floor").alias("floor"),
        F.max("cap").alias("cap"),
    )

    def profit_on(name: str, size: Column) -> Column:
        return size * F.col(name)["sa"] - F.col(name)["sb"]

    floor_profit, cap_profit = profit_on("at_floor", F.col("floor")), profit_on("at_cap", F.col("cap"))
    root = F.col("crossing.sb") / F.col("crossing.sa")
    max_size = (
        F.when(floor_profit <= 0, 0.0)
        .when(cap_profit > 0, F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.greatest(F.col("floor"), root)))
    )
    sized = sized.select(
        "constraint_key", max_size.alias("max_size"), (floor_profit / F.col("floor")).alias("floor_edge"),
        F.greatest("floor", F.least("cap", F.coalesce("peak", "cap"))).alias("best"),
    ).withColumn("size", F.when(F.col("max_size") > 0, F.least("best", "max_size")))
    sized = cut(sized)

    # Exact cost of the chosen size, level by level, with the fee rounding.
    chosen = placed.join(sized.where("size is not null").select("constraint_key", "size"), "constraint_key")
    fills = chosen.select("constraint_key", "leg", "condition_id", "outcome_index", "token_id", "outcome",
                          F.col("size").alias("wanted"), "touch", F.col("depth").alias("available_depth"))
    fills = fills.join(asks.select("token_id", "price", "size", "cum"), "token_id")
    fills = fills.withColumn(
        "take", F.least(F.col("size"), F.col("wanted") - (F.col("cum") - F.col("size")))
    ).where("take > 0")
    leg_rows = fills.groupBy(
        "constraint_key", "leg", "condition_id", "outcome_index", "token_id", "outcome", "wanted", "touch", "available_depth"
    ).agg(
        F.sum("take").alias("filled"),
        F.sum(F.col("take") * F.col("price")).alias("notional"),
        F.sum(taker_fee(F.col("take"), F.col("price"), fee_rate)).alias("fee"),
        F.count("*").alias("levels_consumed"),
    )
    leg_rows = leg_rows.select(
        "constraint_key", "condition_id", "outcome_index", "token_id", "outcome",
        F.lit("buy").alias("side"), F.col("wanted").alias("size"), "filled",
        (F.col("notional") / F.col("filled")).alias("avg_price"), "notional", "fee",
        (F.col("notional") + F.col("fee")).alias("cost"), F.col("touch").alias("touch_price"),
        slippage(F.col("notional") / F.col("filled"), F.col("touch"), F.lit("buy")).alias("slippage"),
        "levels_consumed", "available_depth",
    )
    short = F.count_if(F.col("filled") < F.col("size") - FILL_TOLERANCE)
    totals = leg_rows.groupBy("constraint_key").agg(
        F.sum("notional").alias("total_notional"), F.sum("fee").alias("total_fees"),
        F.sum("cost").alias("total_cost"), short.alias("short_legs"),
    )
    out = basket.join(sized, "constraint_key", "left").join(totals, "constraint_key", "left")
    total_payout = F.col("size") * F.col("payout")
    net = total_payout - F.col("total_cost")
    failure = (
        F.when(F.col("missing").isNotNull(), F.col("missing.code"))
        .when(F.col("ceiling") <= 0, "insufficient-depth")
        .when(F.col("ceiling") < F.col("floor"), "below-min-size")
        .when(F.coalesce("max_size", F.lit(0.0)) <= 0, "negative-edge")
        .when(F.col("short_legs") > 0, "insufficient-depth")
        .when((net < min_net_profit) | (net / F.col("size") < min_net_edge), "immaterial-edge")
    )
    out = out.withColumn("failure", failure)
    ok = F.col("failure").isNull()
    at = F.concat(F.col("missing.at.condition_id"), F.lit(" outcome "), F.col("missing.at.outcome_index").cast("string"))
    cents = F.format_string("%.2f", F.col("floor_edge") * 100)
    reason = (
        F.when(F.col("failure") == "missing-token", F.concat(F.lit("no token for "), at))
        .when(F.col("failure") == "missing-book", F.concat(F.lit("no order book for "), at))
        .when(F.col("failure") == "empty-book", F.concat(at, F.lit(" cannot be bought: nothing is offered")))
        .when(F.col("failure") == "insufficient-depth", F.lit("a leg cannot fill the basket size"))
        .when(
            F.col("failure") == "below-min-size",
            F.format_string("%.2f shares are offered, below the minimum order size of %.2f", F.col("ceiling"), F.col("floor")),
        )
        .when(
            F.col("failure") == "negative-edge",
            F.concat(F.lit("net edge "), cents, F.lit("c per unit: spread and fees exceed the mispricing")),
        )
        .when(F.col("failure") == "immaterial-edge", F.lit("a real gap, but too thin to be worth taking"))
    )
    trades = out.select(
        "constraint_key", "kind", "direction", "legs", "failure", reason.alias("reason"),
        F.coalesce("max_size", F.lit(0.0)).alias("max_executable_size"),
        F.when(ok, F.col("size")).alias("size"),
        F.col("payout").alias("guaranteed_payout"),
        F.when(ok, total_payout).alias("total_payout"),
        F.when(ok, F.col("total_notional")).alias("total_notional"),
        F.when(ok, F.col("total_fees")).alias("total_fees"),
        F.when(ok, F.col("total_cost")).alias("total_cost"),
        F.when(ok, F.col("payout") - F.col("total_notional") / F.col("size")).alias("gross_edge"),
        F.when(ok, net / F.col("size")).alias("net_edge"),
        F.when(ok, net).alias("net_profit"),
        F.when(ok, F.when(F.col("total_cost") > 0, net / F.col("total_cost")).otherwise(0.0)).alias("return_on_cost"),
    )
    good = trades.where("failure is null").select("constraint_key")
    return trades, leg_rows.join(good, "constraint_key", "left_semi")


def live_magnitude(promoted: DataFrame, members: DataFrame, markets: DataFrame, levels: DataFrame) -> DataFrame:
    """Magnitude from book mids of the first outcomes; null when any book is one-sided."""
    tokens = markets.select("condition_id", F.try_element_at("clob_token_ids", F.lit(1)).alias("token_id"))
    needed = members.join(promoted.select("constraint_key", "direction"), "constraint_key").join(
        tokens, "condition_id", "left"
    )
    mids = top_of_levels(levels.join(needed.select("token_id").distinct(), "token_id", "left_semi"))
    per = needed.join(mids.select("token_id", "mid"), "token_id", "left").groupBy(
        "constraint_key", "kind", "direction"
    ).agg(
        F.count_if(F.col("mid").isNull()).alias("gaps"),
        F.sum("mid").alias("total"),
        F.max(F.when(F.col("pos") == 0, F.col("mid"))).alias("a"),
        F.max(F.when(F.col("pos") == 1, F.col("mid"))).alias("b"),
    )
    value = (
        F.when(F.col("kind") == "implies", F.col("a") - F.col("b"))
        .when(F.col("direction") == "under", 1 - F.col("total"))
        .otherwise(F.col("total") - 1)
    )
    return per.select("constraint_key", F.when(F.col("gaps") == 0, value).alias("live_magnitude"))


def confirmations(promoted: DataFrame, trades: DataFrame, live: DataFrame) -> DataFrame:
    """Confirmed or apparent, with the reason; a gap that closed on the book is said to be stale."""
    out = (
        promoted.select("constraint_key", "kind", "direction", "members", "first_condition_id", "magnitude")
        .join(trades.drop("kind", "direction", "legs"), "constraint_key")
        .join(live, "constraint_key", "left")
    )
    confirmed = F.col("failure").isNull()
    stale = ~confirmed & (F.col("live_magnitude") <= 0)
    return out.withColumn("status", F.when(confirmed, "confirmed").otherwise("apparent")).withColumn(
        "reason",
        F.when(stale, F.lit("the gap had already closed on the live book: the screened quote was stale")).otherwise(
            F.col("reason")
        ),
    )
