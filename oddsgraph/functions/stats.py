"""Exact distributed statistics: quantiles, ranks, rank correlation, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsgraph.scale import distribution
from oddsgraph.session import cut

# --- fixed values: Abramowitz & Stegun 7.1.26 ---------------------------------
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
# ------------------------------------------------------------------------------


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    y = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -y).otherwise(y))


def _at_rank(rank: Column, value: str) -> Column:
    """Value of the row with this 0-based rank, as an aggregate over a distribution."""
    hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
    return F.max(F.when(hit, F.col(value)))


def floor_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], buckets: int | None = None) -> DataFrame:
    """Per group, the element at ⌊q·(n−1)⌋ for each named q. No interpolation."""
    dist = distribution(df, groups, value, buckets)
    cols = [_at_rank(F.floor(F.lit(q) * (F.col("total") - 1)), value).alias(name) for name, q in probs.items()]
    return dist.groupBy(*groups).agg(*cols)


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], buckets: int | None = None) -> DataFrame:
    """Per group, linearly interpolated quantiles (percentile_cont) for each named q."""
    dist = distribution(df, groups, value, buckets)
    return dist.groupBy(*groups).agg(*_interpolated(value, probs))


def _interpolated(value: str, probs: dict[str, float]) -> list[Column]:
    cols = []
    for name, q in probs.items():
        pos = F.lit(q) * (F.col("total") - 1)
        low, high = _at_rank(F.floor(pos), value), _at_rank(F.ceil(pos), value)
        part = F.max(pos - F.floor(pos))
        cols.append((low + (high - low) * part).alias(name))
    return cols


def summary(df: DataFrame, groups: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """n, min, p25, median, p75, p95, max and mean per group, in one pass over the distribution."""
    dist = distribution(df, groups, value, buckets)
    probs = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return dist.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        F.min(value).alias("min"),
        *_interpolated(value, probs),
        F.max(value).alias("max"),
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"),
    )


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """One row per group and distinct value with its 1-based rank, averaged over ties."""
    dist = distribution(df, groups, value, buckets, weight)
    return dist.select(*groups, value, (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str, buckets: int | None = None, pooled: str | None = None) -> DataFrame:
    """Rank correlation per group: rho, n, p.

    Pairs are counted first and the counts written, so the input is read once and equal pairs
    travel once. Ranks come from the two marginal distributions and are joined back on
    (group, value). With ``pooled`` the one group column also takes that name for all rows
    together: the counts are expanded to both groupings, not the rows.
    """
    groups = list(groups)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    weights = cut(pairs.groupBy(*groups, x, y).agg(F.count("*").alias("__w")))
    if pooled is not None:
        (group,) = groups
        both = F.explode(F.array(F.lit(pooled), F.col(group))).alias(group)
        weights = cut(weights.select(both, x, y, "__w").groupBy(*groups, x, y).agg(F.sum("__w").alias("__w")))
    rx = average_ranks(weights, groups, x, buckets, "__w").withColumnRenamed("rank", "rx")
    ry = average_ranks(weights, groups, y, buckets, "__w").withColumnRenamed("rank", "ry")
    ranked = weights.join(rx, [*groups, x]).join(ry, [*groups, y])
    n = F.sum("__w")
    # The mean of average ranks is always (n + 1) / 2.
    sums = ranked.groupBy(*groups).agg(
        n.alias("n"),
        F.sum(F.col("__w") * F.col("rx") * F.col("ry")).alias("sxy"),
        F.sum(F.col("__w") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("__w") * F.col("ry") * F.col("ry")).alias("syy"),
    )
    centre = F.col("n") * F.pow((F.col("n") + 1) / 2.0, F.lit(2))
    vx, vy = F.col("sxx") - centre, F.col("syy") - centre
    ok = (F.col("n") >= 3) & (vx > 0) & (vy > 0)
    rho = F.when(ok, (F.col("sxy") - centre) / F.sqrt(vx * vy))
    out = sums.select(*groups, rho.alias("rho"), F.col("n"))
    t = F.abs(F.col("rho")) * F.sqrt(
        (F.col("n") - 2) / F.greatest(F.lit(1e-12), 1 - F.col("rho") * F.col("rho"))
    )
    return out.withColumn("p", F.when(F.col("rho").isNotNull(), 2 * (1 - normal_cdf(t))))


def cumulative_histogram(df: DataFrame, groups: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative ``le`` bucket counts, sum and count per group, in one aggregate."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds]
    return df.groupBy(*groups).agg(*aggs, F.sum(value).alias("sum"), F.count(value).alias("count"))
