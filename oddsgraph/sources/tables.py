"""Versioned Parquet tables and keyed merges.

A merge never overwrites what it reads: it writes a new version directory and then
moves the pointer. Readers see the old or the new version, and a failed job leaves
the old one in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CURRENT = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _replace(spark: SparkSession, source, target) -> None:
    """Move over an existing file in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = getattr(hadoop, "Options$Rename")
    mode = spark.sparkContext._gateway.new_array(overwrite, 1)
    mode[0] = overwrite.OVERWRITE
    context = hadoop.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(source, target, mode)


def current_version(spark: SparkSession, root: str) -> str | None:
    fs, pointer = _fs(spark, f"{root}/{_CURRENT}")
    if not fs.exists(pointer):
        return None
    return spark.read.text(str(pointer.toString())).head()[0]


def write_version(df: DataFrame, root: str, partition_by: Sequence[str] = ()) -> str:
    """Write a new version and point readers at it."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.partitionBy(*partition_by).parquet(f"{root}/{version}")
    fs, pointer = _fs(spark, f"{root}/{_CURRENT}")
    temp = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.{_CURRENT}.{version}"))
    pointer = fs.makeQualified(pointer)
    out = fs.create(temp, True)
    out.write(bytearray(version.encode()))
    out.close()
    _replace(spark, temp, pointer)
    return version


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    version = current_version(spark, root)
    return None if version is None else spark.read.parquet(f"{root}/{version}")


def merge_by_key(
    old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = (), coalesce_old: Sequence[str] = ()
) -> DataFrame:
    """Upsert: new rows replace old ones of the same key.

    ``keep_old`` columns keep the stored value where the key was known;
    ``coalesce_old`` columns keep it only where it is not null.
    """
    keys = list(keys)
    cols = [c for c in old.columns if c not in keys]
    packed_old = old.select(*keys, F.struct(*cols).alias("__old"))
    packed_new = new.select(*keys, F.struct(*cols).alias("__new"))
    both = packed_old.join(packed_new, keys, "full_outer")

    def pick(c: str) -> Column:
        o, n = F.col("__old")[c], F.col("__new")[c]
        if c in coalesce_old:
            return F.coalesce(o, n)
        if c in keep_old:
            return F.when(F.col("__old").isNotNull(), o).otherwise(n)
        return F.when(F.col("__new").isNotNull(), n).otherwise(o)

    return both.select(*keys, *[pick(c).alias(c) for c in cols])


def merge_snapshots(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Snapshot sink: one row per (condition, token, ts); a re-run corrects the row."""
    return merge_by_key(stored, rows, ["condition_id", "token_id", "ts"])


def refresh_quotes(stored: DataFrame, wanted: DataFrame, markets: DataFrame, now: Column, order: Column) -> tuple[DataFrame, DataFrame]:
    """Latest price of the first outcome per wanted market: (quotes′, counts).

    ``markets`` are normalised records; the first row per market in ``order`` wins.
    """
    ids = wanted.select("condition_id").distinct()
    rows = markets.where(F.col("conditionId").isNotNull()).select(
        F.col("conditionId").alias("condition_id"),
        F.struct(
            F.try_element_at("outcomePrices", F.lit(1)).alias("yes_price"),
            F.col("bestBid").alias("best_bid"),
            F.col("bestAsk").alias("best_ask"),
            F.col("updatedAt").alias("quoted_at"),
        ).alias("q"),
        order.alias("__order"),
    )
    first = (
        rows.join(ids, "condition_id", "left_semi")
        .groupBy("condition_id")
        .agg(F.min_by("q", "__order").alias("q"))
        .select("condition_id", "q.*", now.alias("fetched_at"))
    )
    counts = (
        ids.join(first.select("condition_id", F.lit(1).alias("hit")), "condition_id", "left")
        .agg(
            F.count("*").alias("requested"),
            F.count("hit").alias("updated"),
            F.count_if(F.col("hit").isNull()).alias("missing"),
        )
    )
    return merge_by_key(stored, first, ["condition_id"]), counts
