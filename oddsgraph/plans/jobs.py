"""Whole jobs composed of the operators; input tables to output tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsgraph.operators import candidates, episodes, pricing, reconcile, screen
from oddsgraph.operators.relations import one_row
from oddsgraph.session import cut
from oddsgraph.sources.pages import Catalog


@dataclass
class CheckResult:
    evaluations: DataFrame
    confirmations: DataFrame
    trades: DataFrame
    legs: DataFrame
    stats: DataFrame


def coherence_check(
    relations: DataFrame, groups: DataFrame, members: DataFrame, markets: DataFrame, quotes: DataFrame,
    levels: DataFrame, book_meta: DataFrame, live_mids: DataFrame | None = None,
    epsilon: float = screen.DEFAULT_EPSILON, budget: int | None = None,
) -> CheckResult:
    """Screen every constraint, promote the violations (with a budget the worst), price their baskets on depth.

    Book levels are read only for tokens of promoted constraints.
    """
    in_constraints = screen.constraint_members(relations, groups, members, markets)
    prices = screen.screen_prices(markets, quotes, live_mids)
    evaluations = screen.evaluate(screen.attach_prices(in_constraints, prices), epsilon)
    promoted = cut(screen.promote(evaluations, budget))  # read by pricing, live mids and confirmation
    legs = pricing.locate_legs(screen.basket_legs(promoted, in_constraints), markets, book_meta)
    trades, leg_rows = pricing.price_baskets(legs, levels)
    live = pricing.live_magnitude(promoted, in_constraints, markets, levels)
    confirmed = pricing.confirmations(promoted, trades, live)
    stats = one_row(screen.screen_stats(evaluations), screen.price_source_counts(prices))
    return CheckResult(evaluations, confirmed, trades, leg_rows, stats)


def record_check(stored: DataFrame, check: CheckResult, now: Column) -> tuple[DataFrame, DataFrame]:
    """Episodes after a check. The whole screen decides what still violates; constraints
    that could not be screened stay open."""
    seen = check.evaluations.where(~F.col("unscreenable"))
    return episodes.record_check(stored, check.confirmations, seen.where("violated"), seen, now)


@dataclass
class IngestResult:
    events: DataFrame
    markets: DataFrame
    revisions: DataFrame
    summary: DataFrame


def ingest_catalog(catalog: Catalog, stored_events: DataFrame, stored_markets: DataFrame, seen_at: Column, complete: bool = True) -> IngestResult:
    """Normalised pages against the stored catalog; only a complete crawl marks missing markets."""
    incoming = reconcile.market_rows(catalog.markets)
    classified = reconcile.classify(stored_markets, incoming)
    merged = reconcile.merged_markets(classified, seen_at)
    if complete:
        merged = reconcile.mark_missing(merged, seen_at)
    edits = reconcile.revisions(classified, seen_at)
    events = reconcile.upsert_events(stored_events, reconcile.event_rows(catalog.events, seen_at))
    return IngestResult(events, merged, edits, reconcile.run_summary(classified, incoming, edits))


def propose_candidates(
    embeddings: DataFrame, relations: DataFrame, members: DataFrame, proposals: DataFrame,
    k: int = candidates.NEIGHBOURS, threshold: float = candidates.THRESHOLD, limit: int | None = None, order: str = "similarity",
) -> DataFrame:
    near = candidates.nearest_neighbours(embeddings, k, threshold)
    pairs = candidates.fold_pairs(near, threshold)
    return candidates.ordered_candidates(candidates.uncovered_pairs(pairs, relations, members, proposals), limit, order)
