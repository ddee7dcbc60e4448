"""Feed frames to book events, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsgraph.functions.coerce import NUMERIC, kind

# Wire names of the two event kinds the books are built from.
BOOK, CHANGE = "book", "price_change"

_LEVELS = "array<struct<price:string,size:string>>"
_EVENT = (
    f"struct<event_type:string,market:string,asset_id:string,timestamp:string,hash:string,bids:{_LEVELS},asks:{_LEVELS},"
    "price_changes:array<struct<asset_id:string,price:string,size:string,side:string,hash:string,best_bid:string,best_ask:string>>>"
)


def read_frames(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """(frame, received_at, frame_no) from landed text files, one frame per line.

    A line may start with the number of its frame in order of arrival and a tab: files give
    no order of lines, and frames with one timestamp are applied by this number.
    """
    reader = spark.readStream if streaming else spark.read
    lines = reader.format("text").load(path)
    number = F.regexp_extract("value", r"^(\d+)\t", 1)
    return lines.select(
        F.regexp_replace("value", r"^\d+\t", "").alias("frame"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.when(number != "", number.try_cast("bigint")).alias("frame_no"),
    )


def route_frames(frames: DataFrame) -> DataFrame:
    """One row per event with ``route``: book, price_change, pong, text, unparseable, unknown,
    or the name of any other event type. ``frame_no``, if there, is carried along."""
    if "frame_no" not in frames.columns:
        frames = frames.withColumn("frame_no", F.lit(None).cast("long"))
    text = F.col("frame")
    json = text.startswith("[") | text.startswith("{")
    parsed = frames.where(text != "").withColumn("__doc", F.when(json, F.try_parse_json("frame")))
    doc = F.col("__doc")
    items = F.when(
        kind(doc).startswith("ARRAY"), F.try_variant_get(doc, "$", "array<variant>")
    ).otherwise(F.array(doc))
    rows = parsed.select(
        "frame", "received_at", "frame_no", doc.isNull().alias("__bad"), F.posexplode(items).alias("seq", "__item")
    )
    body = F.from_json(F.to_json("__item"), _EVENT)
    name = F.try_variant_get("__item", "$.event_type", "string")
    route = (
        F.when(~json & (text == "PONG"), "pong").when(~json, "text").when(F.col("__bad"), "unparseable")
        .when(name.isNull(), "unknown").otherwise(name)
    )
    return rows.select("received_at", "frame_no", "seq", route.alias("route"), body.alias("event"))


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count("*").alias("n"))


def _number(text: Column) -> Column:
    return F.when(F.trim(text).rlike(NUMERIC), F.trim(text).try_cast("double"))


def _sane_levels(levels: Column) -> Column:
    pairs = F.transform(levels, lambda x: F.struct(_number(x["price"]).alias("price"), _number(x["size"]).alias("size")))
    return F.filter(pairs, lambda x: F.coalesce((x["price"] > 0) & (x["price"] <= 1) & (x["size"] > 0), F.lit(False)))


def book_events(routed: DataFrame) -> DataFrame:
    """Book and change events per token, ready for the book state.

    Columns: token_id, condition_id, kind, ts_ms, received_at, frame_no, seq, bids, asks, side,
    price, size, hash, best_bid, best_ask.
    """
    e = F.col("event")
    ms = _number(e["timestamp"]).cast("bigint")
    none = F.lit(None)
    empty = none.cast("array<struct<price:double,size:double>>")
    whole = routed.where(F.col("route") == BOOK).where(e["asset_id"].isNotNull()).select(
        e["asset_id"].alias("token_id"), e["market"].alias("condition_id"), F.lit(BOOK).alias("kind"),
        F.when(ms > 0, ms).alias("ts_ms"), "received_at", "frame_no", F.col("seq").cast("long").alias("seq"),
        _sane_levels(e["bids"]).alias("bids"), _sane_levels(e["asks"]).alias("asks"),
        none.cast("string").alias("side"), none.cast("double").alias("price"), none.cast("double").alias("size"),
        e["hash"].alias("hash"), none.cast("double").alias("best_bid"), none.cast("double").alias("best_ask"),
    )
    opened = routed.where(F.col("route") == CHANGE).select(
        e["market"].alias("condition_id"), F.when(ms > 0, ms).alias("ts_ms"), "received_at", "frame_no", "seq",
        F.posexplode(e["price_changes"]).alias("i", "c"),
    )
    c = F.col("c")
    changes = opened.select(
        c["asset_id"].alias("token_id"), "condition_id", F.lit(CHANGE).alias("kind"), "ts_ms", "received_at", "frame_no",
        (F.col("seq").cast("long") * 100_000 + F.col("i")).alias("seq"), empty.alias("bids"), empty.alias("asks"),
        F.when(F.upper(c["side"]) == "BUY", "bid").otherwise("ask").alias("side"),
        _number(c["price"]).alias("price"), _number(c["size"]).alias("size"), c["hash"].alias("hash"),
        _number(c["best_bid"]).alias("best_bid"), _number(c["best_ask"]).alias("best_ask"),
    )
    return whole.unionByName(changes)


def valid_change(price: Column, size: Column) -> Column:
    """Absolute level sizes; zero deletes, anything outside (0, 1] is ignored."""
    return F.coalesce((price > 0) & (price <= 1) & (size >= 0) & ~F.isnan(price) & ~F.isnan(size), F.lit(False))
