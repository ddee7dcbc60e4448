"""Ordered operations that stay distributed when one key holds most of the rows.

A window over a hot key sorts the whole key in one task. The helpers here cut
each key into *order buckets*: ranges of the ordering value with about the same
number of rows over the whole table. A (key, bucket) group is then never larger
than one even slice of the table, whatever the key distribution, provided equal
ordering values were aggregated first (every caller does). Results of
neighbouring buckets are stitched from one summary row per (key, bucket).

Bucket limits are literals in the plan, so they are the same in every branch and
every task retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 128 << 20
MAX_BUCKETS = 4096
UNKNOWN_BYTES = 1 << 60
_B = "__bucket"
_V = "__order_value"


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of all leaf relations below ``df`` by the optimiser's statistics; None if unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(size >= UNKNOWN_BYTES for size in sizes) else sum(sizes)


def bucket_count(df: DataFrame) -> int:
    """How many order buckets the inputs of ``df`` call for; 1 when they are known to be small."""
    size = input_bytes(df)
    if size is None:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(MAX_BUCKETS, size // BUCKET_BYTES))


def order_limits(df: DataFrame, order: Column, buckets: int | None = None) -> list[float]:
    """Inner limits of the order buckets. Empty when one bucket is enough.

    At most ``MAX_BUCKETS`` numbers reach the driver.
    """
    n = bucket_count(df) if buckets is None else buckets
    if n <= 1:
        return []
    probs = [i / n for i in range(1, n)]
    values = df.select(_as_double(order).alias(_V)).where(F.col(_V).isNotNull())
    return sorted(set(values.approxQuantile(_V, probs, 0.25 / n)))


def _as_double(order: Column) -> Column:
    return order.cast("double")


def _bucketed(df: DataFrame, order: Column, limits: Sequence[float]) -> DataFrame:
    splits = [float("-inf"), *limits, float("inf")]
    out = df.withColumn(_V, _as_double(order))
    cut_points = Bucketizer(splits=splits, inputCol=_V, outputCol=_B, handleInvalid="keep")
    return cut_points.transform(out).withColumn(_B, F.col(_B).cast("int")).drop(_V)


def top(df: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows in an order; all rows, in no order, where no limit is asked for."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def next_row(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    carry: Sequence[str],
    prefix: str = "next_",
    buckets: int | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add ``prefix + c`` for each carried column, from the next row of the same key.

    (keys, order, tie) must be unique. Null on the last row of a key.
    """
    keys = list(keys)
    limits = order_limits(df, F.col(order), buckets)
    following = F.struct(*[F.col(c) for c in carry])
    if not limits:
        w = Window.partitionBy(*keys).orderBy(order, *tie)
        out = df.withColumn("__next", F.lead(following).over(w))
    else:
        parts = _bucketed(df, F.col(order), limits)
        # One row per key and bucket: the first row of each bucket, then the one after it.
        heads = parts.groupBy(*keys, _B).agg(F.min_by(following, F.struct(order, *tie)).alias("__first"))
        after = F.lead("__first").over(Window.partitionBy(*keys).orderBy(_B)).alias("__after")
        heads = _renamed_keys(heads.select(*keys, _B, after), [*keys, _B])
        w = Window.partitionBy(*keys, _B).orderBy(order, *tie)
        inner = parts.withColumn("__in", F.lead(following).over(w))
        out = inner.join(heads, _same_keys([*keys, _B]), "left")
        out = out.withColumn("__next", F.coalesce("__in", "__after"))
    return out.select(*df.columns, *[F.col("__next")[c].alias(prefix + c) for c in carry])


def last_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    carry: Sequence[str],
    prefix: str = "last_",
    buckets: int | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """As-of join: each row of ``left`` with the latest row of ``right`` of its key at or before its ``at``.

    Both sides have ``keys`` and ``at``; of right rows at one time the last by ``tie`` counts.
    Adds ``prefix + c`` for each carried column, null where nothing came before; a null key is a
    key like any other. The sides are
    put together and read in order, so times are never compared pair by pair; in each order
    bucket the last right row of the buckets before it is brought in.
    """
    keys = list(keys)
    row, held = F.struct(*[F.col(c) for c in left.columns]), F.struct(*[F.col(c) for c in carry])
    kinds = {"row": left.select(row.alias("x")).schema["x"].dataType, "held": right.select(held.alias("x")).schema["x"].dataType}
    none = {name: F.lit(None).cast(kind) for name, kind in kinds.items()}
    turn = F.struct(*[F.col(c) for c in tie]) if tie else F.struct(F.lit(0).alias("none"))
    turn_kind = right.select(turn.alias("x")).schema["x"].dataType
    both = left.select(*keys, at, row.alias("__row"), none["held"].alias("__held"), F.lit(1).alias("__asks"), F.lit(None).cast(turn_kind).alias("__turn")).unionByName(
        right.select(*keys, at, none["row"].alias("__row"), held.alias("__held"), F.lit(0).alias("__asks"), turn.alias("__turn"))
    )
    limits = order_limits(both, F.col(at), buckets)
    order = [at, "__asks", "__turn"]  # a right row of the same time comes first
    if not limits:
        found = F.last("__held", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        out = both.withColumn("__found", found)
    else:
        parts = _bucketed(both, F.col(at), limits)
        ends = parts.where("__asks = 0").groupBy(*keys, _B).agg(F.max_by("__held", F.struct(at, "__turn")).alias("__end"))
        # Buckets without right rows need what came before them too.
        ends = parts.select(*keys, _B).distinct().join(_renamed_keys(ends, [*keys, _B]), _same_keys([*keys, _B]), "left").select(*keys, _B, "__end")
        before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1))
        heads = _renamed_keys(ends.select(*keys, _B, before.alias("__before")), [*keys, _B])
        inside = F.last("__held", ignorenulls=True).over(Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        out = parts.withColumn("__in", inside).join(heads, _same_keys([*keys, _B]), "left").withColumn("__found", F.coalesce("__in", "__before"))
    return out.where("__asks = 1").select("__row.*", *[F.col("__found")[c].alias(prefix + c) for c in carry])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Sequence[str],
    prefix: str = "cum_",
    total_prefix: str | None = None,
    buckets: int | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums of ``measures`` per key in ``order``.

    (keys, order, tie) must be unique. With ``total_prefix`` the sum over the whole key
    is added too, from the same pass.
    """
    keys = list(keys)
    limits = order_limits(df, F.col(order), buckets)
    if not limits:
        running = Window.partitionBy(*keys).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
        extra = [F.sum(m).over(running).alias(prefix + m) for m in measures]
        if total_prefix is not None:
            whole = Window.partitionBy(*keys)
            extra += [F.sum(m).over(whole).alias(total_prefix + m) for m in measures]
        return df.select("*", *extra)
    parts = _bucketed(df, F.col(order), limits)
    heads = parts.groupBy(*keys, _B).agg(*[F.sum(m).alias("__t_" + m) for m in measures])
    # At most one row per key and bucket reaches these windows.
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    heads = heads.select(
        *keys,
        _B,
        *[F.coalesce(F.sum("__t_" + m).over(before), F.lit(0)).alias("__o_" + m) for m in measures],
        *[F.sum("__t_" + m).over(whole).alias("__w_" + m) for m in measures],
    )
    heads = _renamed_keys(heads, [*keys, _B])
    w = Window.partitionBy(*keys, _B).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    inner = parts.select("*", *[F.sum(m).over(w).alias("__c_" + m) for m in measures])
    joined = inner.join(heads, _same_keys([*keys, _B]), "left")
    extra = [(F.col("__c_" + m) + F.col("__o_" + m)).alias(prefix + m) for m in measures]
    if total_prefix is not None:
        extra += [F.col("__w_" + m).alias(total_prefix + m) for m in measures]
    return joined.select(*df.columns, *extra)


def _renamed_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.withColumnRenamed(k, "__k_" + k)
    return df


def _same_keys(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("__k_" + k))
    return cond


def distribution(
    df: DataFrame, groups: Sequence[str], value: str, buckets: int | None = None, weight: str | None = None
) -> DataFrame:
    """Distinct values per group with ``n`` (copies), ``below`` (rows under it), ``total``.

    The basis of exact ranks and quantiles: copies are counted on the map side,
    so a value or group shared by a third of the rows is one partial count. With
    ``weight`` a row stands for so many.
    """
    groups = list(groups)
    rows = F.count("*") if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(rows.alias("n"))
    keys = groups
    if not groups:
        counts, keys = counts.withColumn("__all", F.lit(1)), ["__all"]
    out = running_totals(counts, keys, value, ["n"], "cum_", "total_", buckets)
    return out.select(
        *groups,
        value,
        "n",
        (F.col("cum_n") - F.col("n")).alias("below"),
        F.col("total_n").alias("total"),
    )
