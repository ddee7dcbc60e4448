"""Half-open bucket tables and bucket membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Bucket = tuple[str, float, float | None]

# --- fixed values: report and dashboard buckets -------------------------------
LIFETIME_DASHBOARD: list[Bucket] = [
    ("<30s", 0, 30),
    ("30s–1m", 30, 60),
    ("1–5m", 60, 300),
    ("5–15m", 300, 900),
    ("15–60m", 900, 3_600),
    ("1–6h", 3_600, 21_600),
    ("6–24h", 21_600, 86_400),
    (">24h", 86_400, None),
]
LIFETIME_REPORT: list[Bucket] = [
    ("<60s", 0, 60),
    ("1-5m", 60, 300),
    ("5-15m", 300, 900),
    ("15-60m", 900, 3_600),
    ("1-6h", 3_600, 21_600),
    ("6-24h", 21_600, 86_400),
    (">24h", 86_400, None),
]
EDGE: list[Bucket] = [
    ("0-2c", 0, 0.02),
    ("2-5c", 0.02, 0.05),
    ("5-10c", 0.05, 0.1),
    ("10-20c", 0.1, 0.2),
    ("20-40c", 0.2, 0.4),
    (">40c", 0.4, None),
]
MAGNITUDE: list[Bucket] = [
    ("0.5-1c", 0.005, 0.01),
    ("1-2c", 0.01, 0.02),
    ("2-5c", 0.02, 0.05),
    ("5-10c", 0.05, 0.1),
    ("10-25c", 0.1, 0.25),
    (">25c", 0.25, None),
]
HORIZON: list[Bucket] = [
    ("<7d", -1e9, 7),
    ("7-30d", 7, 30),
    ("30-90d", 30, 90),
    ("90-365d", 90, 365),
    (">1y", 365, None),
]
LATENCY_SECONDS = [0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0]
# ------------------------------------------------------------------------------


def bucket_table(spark: SparkSession, buckets: Sequence[Bucket]) -> DataFrame:
    rows = [(i, n, float(a), None if b is None else float(b)) for i, (n, a, b) in enumerate(buckets)]
    return spark.createDataFrame(
        rows, "bucket int, label string, from_value double, to_value double"
    ).coalesce(1)


def bucket_of(value: Column, buckets: Sequence[Bucket]) -> Column:
    """Index of the bucket that holds ``value``; null outside all of them.

    The buckets are constants, so membership is an expression rather than a range join.
    """
    out = F.lit(None).cast("int")
    for i, (_, low, high) in reversed(list(enumerate(buckets))):
        inside = value >= low if high is None else (value >= low) & (value < high)
        out = F.when(inside, i).otherwise(out)
    return out


def with_empty_buckets(counts: DataFrame, buckets: Sequence[Bucket]) -> DataFrame:
    """Left join per-bucket rows (keyed ``bucket``) onto the full bucket table."""
    return bucket_table(counts.sparkSession, buckets).join(counts, "bucket", "left")
