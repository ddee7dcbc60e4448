"""Violation episodes and their lifetimes.

An episode is a run of checks in which a constraint was violated. Checks that
could not be screened neither open nor close one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsgraph.functions.stats import quantiles
from oddsgraph.operators.relations import one_row
from oddsgraph.scale import running_totals, top

EPISODE_COLUMNS = [
    "episode_id", "constraint_key", "kind", "members", "first_condition_id", "status", "reason",
    "detected_at", "last_checked_at", "resolved_at", "ever_confirmed", "screen_magnitude",
    "peak_magnitude", "peak_net_edge", "peak_size", "peak_net_profit", "checks",
]


def episode_id(key: Column, detected_at: Column) -> Column:
    return F.concat(key, F.lit("@"), F.unix_micros(detected_at).cast("string"))


def episodes(checks: DataFrame, promoted_only: bool = False, buckets: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """All episodes of a history of checks, by gaps and islands.

    ``checks``: constraint_key, check_ts, violated, unscreenable, magnitude, confirmed,
    net_edge, net_profit, size, reason, kind, members, first_condition_id. With
    ``promoted_only`` a violation outside the confirmation budget (column ``promoted``)
    ends the episode, as a checker that looks only at its budget would.
    """
    seen = checks.where(~F.col("unscreenable"))
    bad = F.col("violated") & F.col("promoted") if promoted_only else F.col("violated")
    marked = seen.withColumn("__bad", bad).withColumn("__ok", F.when(bad, 0).otherwise(1))
    # A satisfied check belongs to the run it ends: run = satisfied checks before this row.
    runs = running_totals(marked, ["constraint_key"], "check_ts", ["__ok"], "__run_", buckets=buckets, tie=tie or ())
    runs = runs.withColumn("__run", F.col("__run___ok") - F.col("__ok"))
    v = F.col("__bad")

    def when_bad(c: str) -> Column:
        return F.when(v, F.col(c))

    profit = F.when(v & F.col("net_profit").isNotNull(), F.col("net_profit"))
    grouped = runs.groupBy("constraint_key", "__run").agg(
        F.count_if(v).alias("checks"),
        F.min(when_bad("check_ts")).alias("detected_at"),
        F.max(when_bad("check_ts")).alias("last_bad"),
        F.min(F.when(~v, F.col("check_ts"))).alias("resolved_at"),
        F.min_by("kind", when_bad("check_ts")).alias("kind"),
        F.min_by("members", when_bad("check_ts")).alias("members"),
        F.min_by("first_condition_id", when_bad("check_ts")).alias("first_condition_id"),
        F.max_by("reason", when_bad("check_ts")).alias("reason"),
        F.max(F.when(v, F.col("confirmed")).otherwise(False)).alias("ever_confirmed"),
        F.min_by("magnitude", when_bad("check_ts")).alias("screen_magnitude"),
        F.max(when_bad("magnitude")).alias("peak_magnitude"),
        F.max_by(F.struct("net_edge", "size", "net_profit"), profit).alias("peak"),
    )
    status = F.when(F.col("resolved_at").isNotNull(), "closed").when(F.col("ever_confirmed"), "confirmed").otherwise("apparent")
    return grouped.where("checks > 0").select(
        episode_id(F.col("constraint_key"), F.col("detected_at")).alias("episode_id"),
        "constraint_key", "kind", "members", "first_condition_id", status.alias("status"), "reason",
        "detected_at", F.coalesce("resolved_at", "last_bad").alias("last_checked_at"), "resolved_at",
        "ever_confirmed", "screen_magnitude", "peak_magnitude",
        F.col("peak.net_edge").alias("peak_net_edge"), F.col("peak.size").alias("peak_size"),
        F.col("peak.net_profit").alias("peak_net_profit"), "checks",
    )


def record_check(stored: DataFrame, confirmations: DataFrame, violating: DataFrame, examined: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Apply one check to the stored episodes: (episodes′, counts).

    ``confirmations`` were priced this run; ``violating`` and ``examined`` hold the
    constraint keys of the whole screen. An open episode closes only when its key
    was examined and found satisfied; keys that were not examined stay as they are.
    """
    open_now = stored.where(F.col("resolved_at").isNull())
    conf = confirmations.select(
        "constraint_key",
        F.struct(
            "kind", "members", "first_condition_id", "magnitude", "net_edge", "size", "net_profit",
            "reason", (F.col("status") == "confirmed").alias("confirmed"),
        ).alias("c"),
    )
    bad = violating.select("constraint_key").distinct().withColumn("__bad", F.lit(True))
    looked = examined.select("constraint_key").distinct().withColumn("__seen", F.lit(True))
    old_cols = [c for c in EPISODE_COLUMNS if c != "constraint_key"]
    both = (
        open_now.select("constraint_key", F.struct(*old_cols).alias("o"))
        .join(conf, "constraint_key", "full_outer")
        .join(bad, "constraint_key", "left")
        .join(looked, "constraint_key", "left")
    )
    has_old, has_new = F.col("o").isNotNull(), F.col("c").isNotNull()
    gone = has_old & ~has_new & F.col("__seen").isNotNull() & F.col("__bad").isNull()
    action = (
        F.when(gone, "resolved").when(~has_old, "opened").when(has_new, "updated").otherwise("kept")
    )
    both = both.withColumn("action", action)
    better = has_new & F.col("c.net_profit").isNotNull() & (
        F.col("o.peak_net_profit").isNull() | (F.col("c.net_profit") > F.col("o.peak_net_profit"))
    )
    confirmed = F.coalesce(F.col("c.confirmed"), F.lit(False))
    ever = F.coalesce(F.col("o.ever_confirmed"), F.lit(False)) | confirmed
    detected = F.coalesce(F.col("o.detected_at"), now)
    touched = F.col("action").isin("opened", "updated", "resolved")
    reason = F.when(has_new, F.when(~confirmed, F.col("c.reason"))).otherwise(F.col("o.reason"))
    status = (
        F.when(gone, "closed").when(has_new & ever, "confirmed")
        .when(~has_old, "apparent").otherwise(F.col("o.status"))
    )
    after = both.select(
        F.coalesce(F.col("o.episode_id"), episode_id(F.col("constraint_key"), now)).alias("episode_id"),
        "constraint_key",
        F.coalesce("o.kind", "c.kind").alias("kind"),
        F.coalesce("o.members", "c.members").alias("members"),
        F.coalesce("o.first_condition_id", "c.first_condition_id").alias("first_condition_id"),
        status.alias("status"), reason.alias("reason"), detected.alias("detected_at"),
        F.when(touched, now).otherwise(F.col("o.last_checked_at")).alias("last_checked_at"),
        F.when(gone, now).alias("resolved_at"), ever.alias("ever_confirmed"),
        F.coalesce("o.screen_magnitude", "c.magnitude").alias("screen_magnitude"),
        F.greatest(F.col("o.peak_magnitude"), F.col("c.magnitude")).alias("peak_magnitude"),
        F.when(better, F.col("c.net_edge")).otherwise(F.col("o.peak_net_edge")).alias("peak_net_edge"),
        F.when(better, F.col("c.size")).otherwise(F.col("o.peak_size")).alias("peak_size"),
        F.when(better, F.col("c.net_profit")).otherwise(F.col("o.peak_net_profit")).alias("peak_net_profit"),
        (F.coalesce(F.col("o.checks"), F.lit(0)) + F.when(has_new, 1).otherwise(0)).alias("checks"),
    )
    counts = both.agg(
        F.count_if(F.col("action") == "opened").alias("opened"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if((F.col("action") == "updated") & confirmed & ~F.col("o.ever_confirmed")).alias("upgraded"),
        F.count_if(F.col("action") == "resolved").alias("resolved"),
    )
    closed = stored.where(F.col("resolved_at").isNotNull()).select(*EPISODE_COLUMNS)
    return closed.unionByName(after), counts


def with_lifetime(all_episodes: DataFrame) -> DataFrame:
    """Add ``lifetime_seconds``, null while open."""
    span = F.unix_micros("resolved_at") - F.unix_micros("detected_at")
    return all_episodes.withColumn("lifetime_seconds", span / 1e6)


def lifetime_stats(all_episodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """The headline row: counts, median lifetimes, p90 and best profit."""
    e = with_lifetime(all_episodes)
    closed = F.col("resolved_at").isNotNull()
    counts = e.agg(
        F.count_if(closed).alias("closed_episodes"),
        F.count_if(closed & F.col("ever_confirmed")).alias("closed_confirmed"),
        F.count_if(~closed).alias("open_episodes"),
        F.count_if(~closed & F.col("ever_confirmed")).alias("open_confirmed"),
        F.count_if("ever_confirmed").alias("total_confirmed_ever"),
        F.max("peak_net_profit").alias("best_net_profit"),
    )
    everyone = quantiles(e, [], "lifetime_seconds", {"median_all": 0.5}, buckets)
    confirmed = quantiles(
        e.where("ever_confirmed"), [], "lifetime_seconds", {"median_confirmed": 0.5, "p90_confirmed": 0.9}, buckets
    )
    return one_row(counts, everyone, confirmed)


def apparent_reasons(all_episodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Why unconfirmed episodes were not executable; with a limit the most common reasons."""
    never = all_episodes.where(~F.col("ever_confirmed") & F.col("reason").isNotNull())
    return top(never.groupBy("reason").agg(F.count("*").alias("n")), limit, F.desc("n"), "reason")
