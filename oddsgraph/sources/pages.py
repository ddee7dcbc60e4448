"""Landed catalog pages to clean markets and events, with issues and rejects.

A page is one JSON file: an array, or an envelope with the array under a known or
unknown name. Records are exploded before any coercion, so one page of any shape
costs one task's worth of work and one bad record costs nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsgraph.functions.canon import response_hash
from oddsgraph.functions.coerce import get, kind, soft, to_identifier

# --- fixed values: envelope and field names -----------------------------------
RECORD_KEYS = ["data", "events", "markets", "results"]
ENVELOPE_KEYS = ["$schema", "next_cursor", "nextCursor", "limit", "count", "total"]
END_CURSORS = ["", "LTE="]
ALIASES = {"questionId": "questionID", "isNew": "new", "volume": "volumeNum", "liquidity": "liquidityNum"}
MARKET_FIELDS = {
    "questionId": "string", "conditionId": "string", "slug": "string", "question": "string",
    "description": "string", "groupItemTitle": "string", "resolutionSource": "string",
    "marketMakerAddress": "string",
    "outcomes": "strings", "outcomePrices": "numbers", "clobTokenIds": "strings",
    "active": "boolean", "closed": "boolean", "archived": "boolean", "restricted": "boolean",
    "featured": "boolean", "isNew": "boolean", "acceptingOrders": "boolean",
    "enableOrderBook": "boolean", "negRisk": "boolean",
    "volume": "numeric", "volume24hr": "numeric", "liquidity": "numeric", "openInterest": "numeric",
    "spread": "numeric", "bestBid": "numeric", "bestAsk": "numeric", "lastTradePrice": "numeric",
    "oneDayPriceChange": "numeric", "orderPriceMinTickSize": "numeric", "orderMinSize": "numeric",
    "umaBond": "numeric", "umaReward": "numeric",
    "startDate": "timestamp", "endDate": "timestamp", "closedTime": "timestamp",
    "createdAt": "timestamp", "updatedAt": "timestamp",
    "image": "url", "icon": "url",
}
EVENT_FIELDS = {
    "ticker": "string", "slug": "string", "title": "string", "description": "string",
    "active": "boolean", "closed": "boolean", "archived": "boolean", "restricted": "boolean",
    "featured": "boolean", "isNew": "boolean", "negRisk": "boolean", "enableOrderBook": "boolean",
    "volume": "numeric", "volume24hr": "numeric", "liquidity": "numeric", "openInterest": "numeric",
    "competitive": "numeric",
    "startDate": "timestamp", "endDate": "timestamp", "creationDate": "timestamp",
    "createdAt": "timestamp", "updatedAt": "timestamp",
    "image": "url", "icon": "url", "tags": "tags",
}
# ------------------------------------------------------------------------------


def read_pages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(page, body): one row per landed file, batch or as a file stream."""
    if streaming:
        lines = spark.readStream.format("text").option("wholetext", True).load(path)
    else:
        lines = spark.read.text(path, wholetext=True)
    return lines.select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("body"))


def _array(raw: Column) -> Column:
    return F.when(kind(raw).startswith("ARRAY"), F.try_variant_get(raw, "$", "array<variant>"))


def open_pages(pages: DataFrame) -> DataFrame:
    """Add ``records`` (array of VARIANT, null when the page has none) and ``next_cursor``."""
    doc = F.col("__doc")
    named = [_array(get(doc, f"$.{k}")) for k in RECORD_KEYS]
    entries = F.map_filter(
        F.try_variant_get(doc, "$", "map<string,variant>"),
        lambda k, v: ~k.isin(ENVELOPE_KEYS) & kind(v).startswith("ARRAY"),
    )
    sole = F.when(F.size(entries) == 1, _array(F.try_element_at(F.map_values(entries), F.lit(1))))
    cursor = F.trim(
        F.coalesce(
            F.try_variant_get(doc, "$.next_cursor", "string"), F.try_variant_get(doc, "$.nextCursor", "string")
        )
    )
    return (
        pages.withColumn("__doc", F.try_parse_json("body"))
        .withColumn("records", F.coalesce(_array(doc), *named, sole))
        .withColumn("next_cursor", F.when(~cursor.isin(END_CURSORS), cursor))
        .drop("__doc")
    )


@dataclass
class Catalog:
    markets: DataFrame
    events: DataFrame
    issues: DataFrame  # kind, id, field, reason, received
    rejects: DataFrame  # page, kind, position, reason, received
    counters: DataFrame  # kind, records, with_issues


def _normalise(records: DataFrame, fields: dict[str, str], keep: list[str]) -> DataFrame:
    """Typed columns plus ``issues`` from a ``record`` VARIANT column."""
    given = records.select(*keep, F.explode(F.array("record")).alias("record"))  # parsed once, however many fields read it
    return soft(given, fields, ALIASES).select(
        *[c for c in given.columns if c != "record"], to_identifier(get(F.col("record"), "$.id")).alias("id"), "value.*", "issues"
    )


def normalise_markets(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every market field typed; only ``id`` is required (rows without it have id null)."""
    return _normalise(records, MARKET_FIELDS, keep or [])


def normalise_events(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return _normalise(records, EVENT_FIELDS, keep or [])


def normalise_catalog(pages: DataFrame, record_kind: str = "event") -> Catalog:
    """Pages of events (with nested markets) or of bare markets to clean tables."""
    opened = open_pages(pages)
    no_array = opened.where(F.col("records").isNull()).select(
        "page", F.lit("page").alias("kind"), F.lit(-1).alias("position"),
        F.lit("no record array").alias("reason"), F.col("body").alias("received"),
    )
    records = opened.select("page", F.posexplode("records").alias("position", "record"))
    if record_kind == "market":
        flat = records.select("page", "position", F.lit(None).cast("string").alias("event_id"), F.lit(-1).alias("nested"), "record")
        events = normalise_events(records.where("false"), ["page", "position"])
    else:
        events = normalise_events(records, ["page", "position"])
        nested = records.select(
            "page", "position", to_identifier(get(F.col("record"), "$.id")).alias("event_id"),
            F.posexplode(F.coalesce(_array(get(F.col("record"), "$.markets")), F.array().cast("array<variant>"))).alias("nested", "record"),
        )
        flat = nested.where(F.col("event_id").isNotNull())
    raw_markets = normalise_markets(flat, ["page", "position", "event_id", "nested", F.to_json("record").alias("received")])
    usable = F.col("id").isNotNull()
    markets = raw_markets.where(usable).drop("received")
    event_rows = events.where(usable)
    lost_markets = raw_markets.where(~usable).select(
        "page", F.lit("market").alias("kind"), "position", F.lit("no usable id").alias("reason"), "received"
    )
    lost_events = records.where(to_identifier(get(F.col("record"), "$.id")).isNull()).select(
        "page", F.lit(record_kind).alias("kind"), "position", F.lit("no usable id").alias("reason"),
        F.to_json("record").alias("received"),
    )
    rejects = no_array.unionByName(lost_events if record_kind == "event" else lost_markets)
    if record_kind == "event":
        rejects = rejects.unionByName(lost_markets)
    market_issues = markets.select(
        F.lit("market").alias("kind"), "id", F.inline("issues"), F.col("event_id"), F.col("nested")
    )
    path = F.when(
        F.col("event_id").isNotNull(),
        F.concat(F.lit("markets["), F.col("nested").cast("string"), F.lit("]."), F.col("field")),
    ).otherwise(F.col("field"))
    issues = market_issues.select("kind", "id", path.alias("field"), "reason", "received").unionByName(
        event_rows.select(F.lit("event").alias("kind"), "id", F.inline("issues"))
    )
    return Catalog(markets, event_rows, issues, rejects, parse_counters(markets, event_rows))


def parse_counters(markets: DataFrame, events: DataFrame) -> DataFrame:
    """Records, and records (not fields) with at least one issue, per kind."""
    both = markets.select(F.lit("market").alias("kind"), F.size("issues").alias("n")).unionByName(
        events.select(F.lit("event").alias("kind"), F.size("issues").alias("n"))
    )
    return both.groupBy("kind").agg(
        F.count("*").alias("records"), F.count_if(F.col("n") > 0).alias("with_issues")
    )


def archive_pages(archive: DataFrame | None, pages: DataFrame, now: Column) -> DataFrame:
    """Rows to append to the raw archive: bodies whose hash is new, one per hash."""
    fresh = pages.withColumn("response_hash", response_hash(F.col("body"))).groupBy("response_hash").agg(
        F.min(F.struct(F.col("page").alias("endpoint"), "body")).alias("p")
    )
    if archive is not None:
        fresh = fresh.join(archive.select("response_hash"), "response_hash", "left_anti")
    return fresh.select("response_hash", "p.endpoint", "p.body", now.alias("fetched_at"))
