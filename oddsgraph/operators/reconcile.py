"""Catalog change capture: current state plus an append-only history of edits.

One full-outer join on condition_id classifies every market; the new table, the
revisions and the counters are projections of that one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsgraph.functions.canon import HASHED_FIELDS, canonical_json, content_hash
from oddsgraph.operators.relations import one_row
from oddsgraph.scale import top

MARKET_COLUMNS = [
    "event_id", "question", "slug", "description", "resolution_source", "outcomes",
    "clob_token_ids", "end_date", "active", "closed", "archived", "content_hash",
]


def page_order(page: Column) -> Column:
    """Names of pages in the order they were fetched: runs of digits compare as numbers."""
    padded = F.regexp_replace(page, r"(\d+)", "0" * 20 + "$1")
    return F.regexp_replace(padded, r"\d*(\d{20})(?!\d)", "$1")


def event_rows(events: DataFrame, seen_at: Column) -> DataFrame:
    """Normalised events to stored rows; ``closed_at`` is only an initial value."""
    return events.select(
        "id", "slug", "title", F.col("negRisk").alias("neg_risk"),
        seen_at.alias("first_seen_at"), seen_at.alias("last_seen_at"),
        F.when(F.col("closed"), seen_at).alias("closed_at"),
        F.struct(page_order(F.col("page")).alias("page"), "position").alias("arrival"),
    )


def upsert_events(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Later rows win; first sighting and first closing never move."""
    fields = ["slug", "title", "neg_risk", "first_seen_at", "last_seen_at", "closed_at"]
    latest = incoming.groupBy("id").agg(F.max_by(F.struct(*fields), "arrival").alias("n"))
    old = stored.select("id", F.struct(*fields).alias("o"))
    both = old.join(latest, "id", "full_outer")

    def pick(c: str) -> Column:
        if c == "first_seen_at" or c == "closed_at":
            return F.coalesce(F.col("o")[c], F.col("n")[c])
        return F.when(F.col("n").isNotNull(), F.col("n")[c]).otherwise(F.col("o")[c])

    return both.select("id", *[pick(c).alias(c) for c in fields])


def market_rows(markets: DataFrame) -> DataFrame:
    """Normalised markets to rows with their content hash; without a condition id: null key."""
    out = markets.select(
        F.col("conditionId").alias("condition_id"), "event_id", "question", "slug", "description",
        F.col("resolutionSource").alias("resolution_source"), "outcomes",
        F.col("clobTokenIds").alias("clob_token_ids"), F.col("endDate").alias("end_date"),
        "active", "closed", "archived", F.struct(page_order(F.col("page")).alias("page"), "position", "nested").alias("arrival"),
    )
    return with_content_hash(out)


def with_content_hash(rows: DataFrame) -> DataFrame:
    fields = [f for f in HASHED_FIELDS if f in rows.columns]
    return rows.withColumn("content_hash", content_hash(dict(rows.dtypes), fields))


def classify(stored: DataFrame, incoming: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(condition_id, old, new, outcome): created, updated, unchanged or absent.

    Of several incoming rows for a market the last to arrive counts.
    """
    cols = [c for c in (fields or MARKET_COLUMNS) if c in incoming.columns]
    latest = (
        incoming.where(F.col("condition_id").isNotNull())
        .groupBy("condition_id")
        .agg(F.max_by(F.struct(*cols), "arrival").alias("new"))
    )
    old_cols = [c for c in stored.columns if c != "condition_id"]
    old = stored.select("condition_id", F.struct(*old_cols).alias("old"))
    both = old.join(latest, "condition_id", "full_outer")
    outcome = (
        F.when(F.col("new").isNull(), "absent")
        .when(F.col("old").isNull(), "created")
        .when(F.col("old.content_hash") == F.col("new.content_hash"), "unchanged")
        .otherwise("updated")
    )
    return both.withColumn("outcome", outcome)


def merged_markets(classified: DataFrame, seen_at: Column) -> DataFrame:
    """The new market table. Unchanged rows only move ``last_seen_at``; any sighting clears
    ``missing_since``; ``first_seen_at`` never moves."""
    new_cols = classified.schema["new"].dataType.fieldNames()
    write = F.col("outcome").isin("created", "updated")
    seen = F.col("outcome") != "absent"
    return classified.select(
        "condition_id",
        *[F.when(write, F.col("new")[c]).otherwise(F.col("old")[c]).alias(c) for c in new_cols],
        F.coalesce(F.col("old.first_seen_at"), seen_at).alias("first_seen_at"),
        F.when(seen, seen_at).otherwise(F.col("old.last_seen_at")).alias("last_seen_at"),
        F.when(~seen, F.col("old.missing_since")).alias("missing_since"),
    )


def revisions(classified: DataFrame, seen_at: Column) -> DataFrame:
    """One row per changed field of updated markets, values as canonical JSON.

    A moved hash without a changed field gives none.
    """
    types = {f.name: f.dataType.simpleString() for f in classified.schema["new"].dataType.fields}
    fields = [f for f in HASHED_FIELDS if f in types]
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                canonical_json(F.col("old")[f], types[f]).alias("old_value"),
                canonical_json(F.col("new")[f], types[f]).alias("new_value"),
            )
            for f in fields
        ]
    )
    changed = F.filter(entries, lambda e: e["old_value"] != e["new_value"])
    return classified.where("outcome = 'updated'").select(
        "condition_id",
        seen_at.alias("changed_at"),
        F.inline(changed),
        F.col("old.content_hash").alias("content_hash_before"),
        F.col("new.content_hash").alias("content_hash_after"),
    )


def mark_missing(markets: DataFrame, run_started_at: Column) -> DataFrame:
    """After a complete crawl: whatever was not seen is missing since it was last seen."""
    gone = (F.col("last_seen_at") < run_started_at) & F.col("missing_since").isNull()
    return markets.withColumn("missing_since", F.when(gone, F.col("last_seen_at")).otherwise(F.col("missing_since")))


def missing_markets(markets: DataFrame, limit: int | None = None) -> DataFrame:
    cols = [c for c in ("condition_id", "question", "slug", "missing_since") if c in markets.columns]
    gone = markets.where(F.col("missing_since").isNotNull()).select(*cols)
    return top(gone, limit, F.desc("missing_since"), "condition_id")


def market_history(all_revisions: DataFrame, condition_id: str) -> DataFrame:
    return all_revisions.where(F.col("condition_id") == condition_id).orderBy("changed_at", "field")


def values_as_of(all_revisions: DataFrame, at: Column) -> DataFrame:
    """Last recorded value of every edited field at a point in time."""
    past = all_revisions.where(F.col("changed_at") <= at)
    return past.groupBy("condition_id", "field").agg(F.max_by("new_value", "changed_at").alias("value"))


def run_summary(classified: DataFrame, incoming: DataFrame, revision_rows: DataFrame) -> DataFrame:
    """One row: seen, skipped, created, updated, unchanged, absent, revisions."""
    outcomes = classified.agg(
        F.count_if(F.col("outcome") != "absent").alias("seen"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "updated", "unchanged", "absent")],
    )
    skipped = incoming.agg(F.count_if(F.col("condition_id").isNull()).alias("skipped"))
    return one_row(outcomes, skipped, revision_rows.agg(F.count("*").alias("revisions")))


def catalog_counts(markets: DataFrame, all_revisions: DataFrame) -> DataFrame:
    tracked = markets.agg(
        F.count_if(F.col("missing_since").isNull()).alias("tracked"),
        F.count_if(F.col("missing_since").isNotNull()).alias("missing"),
    )
    return one_row(tracked, all_revisions.agg(F.count("*").alias("revisions")))
