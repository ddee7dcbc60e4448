"""Landed order-book files to normalised books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsgraph.functions.coerce import NUMERIC
from oddsgraph.operators.pricing import usable

WIRE = (
    "array<struct<market:string,asset_id:string,timestamp:string,hash:string,"
    "bids:array<struct<price:string,size:string>>,asks:array<struct<price:string,size:string>>,"
    "min_order_size:string,tick_size:string,neg_risk:boolean,last_trade_price:string>>"
)


def _number(text: Column) -> Column:
    return F.when(F.trim(text).rlike(NUMERIC), F.trim(text).try_cast("double"))


def side(levels: Column, best: str) -> Column:
    """Wire levels to a sane best-first side; equal prices keep their wire order.

    ``best`` is 'high' for bids and 'low' for asks.
    """
    sign = -1.0 if best == "high" else 1.0
    numbered = F.transform(
        F.coalesce(levels, F.array().cast("array<struct<price:string,size:string>>")),
        lambda x, i: F.struct(
            (_number(x["price"]) * sign).alias("rank"), i.alias("i"),
            _number(x["price"]).alias("price"), _number(x["size"]).alias("size"),
        ),
    )
    sane = F.filter(numbered, lambda x: F.coalesce(usable(x["price"], x["size"]), F.lit(False)))
    return F.transform(
        F.array_sort(sane), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"))
    )


def parse_books(pages: DataFrame) -> DataFrame:
    """(page, body) of book arrays to one row per book with sorted sides."""
    wire = pages.select("page", F.inline(F.from_json("body", WIRE)))
    return wire.where(F.col("asset_id").isNotNull()).select(
        "page",
        F.col("asset_id").alias("token_id"),
        F.col("market").alias("condition_id"),
        F.timestamp_millis(_number(F.col("timestamp")).cast("bigint")).alias("timestamp"),
        "hash",
        side(F.col("bids"), "high").alias("bids"),
        side(F.col("asks"), "low").alias("asks"),
        _number(F.col("tick_size")).alias("tick_size"),
        _number(F.col("min_order_size")).alias("min_order_size"),
        "neg_risk",
        _number(F.col("last_trade_price")).alias("last_trade_price"),
    )


def books_for(wanted: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books of the wanted tokens, matched by id, and the tokens nothing came back for.

    Of several books for a token the newest is kept.
    """
    ids = wanted.select("token_id").where("token_id <> ''").distinct()
    cols = [c for c in books.columns if c != "token_id"]
    newest = (
        books.join(ids, "token_id", "left_semi")
        .groupBy("token_id")
        .agg(F.max_by(F.struct(*cols), F.struct("timestamp", "hash")).alias("b"))
        .select("token_id", "b.*")
    )
    return newest, ids.join(newest.select("token_id"), "token_id", "left_anti")
