"""Benchmark catalog of any size, generated by the executors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 1x shape of the published load test.
BASE = {"markets": 15_000, "events": 3_000, "edges": 67_600, "groups": 24_200, "group_size": 5}


@dataclass
class SyntheticCatalog:
    markets: DataFrame
    quotes: DataFrame
    relations: DataFrame
    groups: DataFrame
    members: DataFrame


def _market_id(i: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(i.cast("string"), 62, "0"))


def synthetic_catalog(spark: SparkSession, scale: float = 1.0) -> SyntheticCatalog:
    size = {k: v if k == "group_size" else max(1, int(v * scale)) for k, v in BASE.items()}
    n = size["markets"]
    base = spark.range(1, n + 1).withColumnRenamed("id", "i")
    i = F.col("i")
    markets = base.select(
        _market_id(i).alias("condition_id"),
        (i % size["events"] + 1).cast("string").alias("event_id"),
        F.concat(F.lit("Will synthetic market "), i.cast("string"), F.lit(" resolve above "), (i % 90 + 5).cast("string"), F.lit("%?")).alias("question"),
        F.lit(False).alias("closed"),
        F.lit(None).cast("timestamp").alias("missing_since"),
        F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"),
        F.array(F.concat(F.lit("tok-"), i.cast("string"), F.lit("-a")), F.concat(F.lit("tok-"), i.cast("string"), F.lit("-b"))).alias("clob_token_ids"),
    )
    quotes = base.select(_market_id(i).alias("condition_id"), F.round(0.05 + (i % 90) / 100.0, 4).alias("yes_price"))
    j = F.col("j")
    source = j % n + 1
    target = (source + F.floor(j / n)) % n + 1
    relations = (
        spark.range(size["edges"]).withColumnRenamed("id", "j")
        .select(
            j.alias("id"), _market_id(source).alias("from_condition_id"), _market_id(target).alias("to_condition_id"),
            F.lit("implies").alias("type"), F.lit("ladder").alias("source"),
        )
        .where("from_condition_id <> to_condition_id")
    )
    g = F.col("g")
    groups = spark.range(1, size["groups"] + 1).withColumnRenamed("id", "g").select(
        g.alias("group_id"), F.lit("partition").alias("type"), F.lit("neg-risk-event").alias("source")
    )
    members = groups.select("group_id", F.explode(F.sequence(F.lit(1), F.lit(size["group_size"]))).alias("m")).select(
        "group_id", _market_id((F.col("group_id") * size["group_size"] + F.col("m")) % n + 1).alias("condition_id")
    )
    return SyntheticCatalog(markets, quotes, relations, groups, members)
