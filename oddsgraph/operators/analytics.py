"""Status, feeds, distributions, families and correlations over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsgraph.functions import buckets as B
from oddsgraph.functions import stats
from oddsgraph.functions.text import category
from oddsgraph.operators.episodes import with_lifetime
from oddsgraph.operators.relations import live_markets, one_row
from oddsgraph.operators.screen import DEFAULT_EPSILON
from oddsgraph.scale import top

# --- fixed values: report order -----------------------------------------------
FLOOR_SECONDS = 120
CATEGORY_ORDER = ["politics", "sports", "crypto", "economics", "other"]
# ------------------------------------------------------------------------------


# --- status and feeds -----------------------------------------------------------------------


def market_counts(markets: DataFrame) -> DataFrame:
    closed = F.coalesce(F.col("closed"), F.lit(False))
    missing = F.col("missing_since").isNotNull()
    return markets.agg(
        F.count("*").alias("total"), F.count_if(~missing & ~closed).alias("active"),
        F.count_if(closed).alias("closed"), F.count_if(missing).alias("missing"),
    )


def relations_by_source(relations: DataFrame, groups: DataFrame) -> DataFrame:
    edges = relations.groupBy("source", "type").agg(F.count("*").alias("n"))
    parts = groups.groupBy("source").agg(F.count("*").alias("n")).select(
        "source", F.lit("partition-group").alias("type"), "n"
    )
    return edges.unionByName(parts)


def violation_counts(all_episodes: DataFrame) -> DataFrame:
    is_open, ever = F.col("resolved_at").isNull(), F.col("ever_confirmed")
    return all_episodes.agg(
        F.count_if(is_open & ever).alias("open_confirmed"), F.count_if(is_open & ~ever).alias("open_apparent"),
        F.count_if(ever).alias("ever_confirmed"), F.count("*").alias("total"),
    )


def status(markets: DataFrame, relations: DataFrame, groups: DataFrame, all_episodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row: catalog, graph and violation counts with the confirmed median lifetime."""
    m = market_counts(markets).select(F.col("active").alias("tracked"), "missing", "closed")
    r = relations_by_source(relations, groups).agg(
        F.coalesce(F.sum(F.when(F.col("type") != "partition-group", F.col("n"))), F.lit(0)).alias("edges"),
        F.coalesce(F.sum(F.when(F.col("type") == "partition-group", F.col("n"))), F.lit(0)).alias("groups"),
    )
    confirmed = with_lifetime(all_episodes).where("ever_confirmed")
    median = stats.quantiles(confirmed, [], "lifetime_seconds", {"median_lifetime_seconds": 0.5}, buckets)
    return one_row(m, r, violation_counts(all_episodes), median)


def _question(all_episodes: DataFrame, markets: DataFrame) -> DataFrame:
    extra = [c for c in ("slug", "end_date") if c in markets.columns]
    m = markets.select(F.col("condition_id").alias("first_condition_id"), "question", *extra)
    return all_episodes.join(m, "first_condition_id", "left")


def open_violations(all_episodes: DataFrame, markets: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Confirmed first, then by edge (nulls last), then newest."""
    is_open = all_episodes.where(F.col("resolved_at").isNull())
    rows = top(is_open, limit, F.desc("ever_confirmed"), F.desc_nulls_last("peak_net_edge"), F.desc("detected_at"), "episode_id")
    age = (F.unix_micros(now) - F.unix_micros("detected_at")) / 1e6
    return _question(rows, markets).withColumn("age_seconds", age)


def _of_kind(all_episodes: DataFrame, which: str) -> DataFrame:
    rules = {
        "all": F.lit(True), "open": F.col("resolved_at").isNull(), "closed": F.col("resolved_at").isNotNull(),
        "confirmed": F.col("ever_confirmed"), "apparent": ~F.col("ever_confirmed"),
    }
    return all_episodes.where(rules.get(which, rules["all"]))


def violation_totals(all_episodes: DataFrame) -> DataFrame:
    """Rows of the feed of every kind, whatever limit the feed is cut to."""
    names = ["all", "open", "closed", "confirmed", "apparent"]
    kinds = F.array_compact(
        F.array(
            F.lit("all"), F.when(F.col("resolved_at").isNull(), "open").otherwise("closed"),
            F.when(F.col("ever_confirmed"), "confirmed").otherwise("apparent"),
        )
    )
    counted = all_episodes.select(F.explode(kinds).alias("which")).groupBy("which").agg(F.count("*").alias("total"))
    every = all_episodes.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("which"))
    return every.join(counted, "which", "left").select("which", F.coalesce("total", F.lit(0)).alias("total"))


def relation_totals(relations: DataFrame) -> DataFrame:
    """Rows of the relations feed by source and type."""
    return relations.groupBy("source", "type").agg(F.count("*").alias("total"))


def violation_feed(all_episodes: DataFrame, markets: DataFrame, now: Column, which: str = "all", limit: int | None = None) -> DataFrame:
    """Newest episodes: all, open, closed, confirmed or apparent; lifetime or age so far."""
    rows = top(_of_kind(all_episodes, which), limit, F.desc("detected_at"), "episode_id")
    life = (F.unix_micros(F.coalesce("resolved_at", now)) - F.unix_micros("detected_at")) / 1e6
    return _question(rows, markets).withColumn("lifetime_seconds", life).withColumn("open", F.col("resolved_at").isNull())


def relations_feed(relations: DataFrame, markets: DataFrame, source: str | None = None, type: str | None = None, limit: int | None = None) -> DataFrame:
    """Relations with both questions, filtered by source and type; with a limit the newest."""
    rows = relations
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if type is not None:
        rows = rows.where(F.col("type") == type)
    newest = [F.desc("first_seen_at")] if "first_seen_at" in rows.columns else []
    return with_questions(top(rows, limit, *newest, "id"), markets)


def with_questions(relations: DataFrame, markets: DataFrame) -> DataFrame:
    a = markets.select(F.col("condition_id").alias("from_condition_id"), F.col("question").alias("from_question"))
    b = markets.select(F.col("condition_id").alias("to_condition_id"), F.col("question").alias("to_question"))
    return relations.join(a, "from_condition_id", "left").join(b, "to_condition_id", "left")


# --- families -------------------------------------------------------------------------------


def partition_families(members: DataFrame, markets: DataFrame, limit: int | None = None) -> DataFrame:
    live = live_markets(markets).select("condition_id")
    out = members.join(live, "condition_id", "left_semi").groupBy("group_id").agg(F.count("*").alias("members"))
    out = out.where("members > 1").select(
        F.concat(F.lit("group:"), F.col("group_id").cast("string")).alias("key"), F.lit("partition").alias("kind"),
        F.col("group_id").cast("string").alias("label"), "members",
    )
    return top(out, limit, F.desc("members"), "key")


def ladder_families(relations: DataFrame, markets: DataFrame, limit: int | None = None) -> DataFrame:
    """Events with two or more live markets on implications."""
    ends = relations.where("type = 'implies'").select(
        F.explode(F.array("from_condition_id", "to_condition_id")).alias("condition_id")
    ).distinct()
    live = live_markets(markets).where(F.col("event_id").isNotNull())
    out = live.join(ends, "condition_id", "left_semi").groupBy("event_id").agg(
        F.min("question").alias("label"), F.count("*").alias("members")
    )
    out = out.where("members > 1").select(
        F.concat(F.lit("event:"), F.col("event_id")).alias("key"), F.lit("ladder").alias("kind"),
        F.coalesce("label", "event_id").alias("label"), "members",
    )
    return top(out, limit, F.desc("members"), "key")


def families(members: DataFrame, relations: DataFrame, markets: DataFrame, limit: int | None = None) -> DataFrame:
    return partition_families(members, markets, limit).unionByName(ladder_families(relations, markets, limit))


def partition_details(members: DataFrame, markets: DataFrame, quotes: DataFrame, epsilon: float = DEFAULT_EPSILON) -> DataFrame:
    """Per partition: members, priced members, sum, signed sum − 1 and its size once all are priced."""
    live = live_markets(markets).select("condition_id")
    q = quotes.select("condition_id", F.col("yes_price").cast("double").alias("price"))
    per = members.join(live, "condition_id", "left_semi").join(q, "condition_id", "left").groupBy("group_id").agg(
        F.count("*").alias("members"), F.count("price").alias("priced"), F.sum("price").alias("total")
    )
    whole = (F.col("priced") == F.col("members")) & (F.col("members") > 1)
    gap = F.when(whole, F.col("total") - 1)
    return per.select(
        "group_id", "members", "priced", "total", gap.alias("signed_magnitude"), F.abs(gap).alias("magnitude"),
        F.coalesce(F.abs(gap) > epsilon, F.lit(False)).alias("violated"),
    )


def ladder_members(relations: DataFrame, markets: DataFrame, quotes: DataFrame) -> DataFrame:
    """Live markets on any implication, with their quotes, by event."""
    ends = relations.where("type = 'implies'").select(
        F.explode(F.array("from_condition_id", "to_condition_id")).alias("condition_id")
    ).distinct()
    q = quotes.select("condition_id", F.col("yes_price").cast("double").alias("price"))
    live = live_markets(markets).where(F.col("event_id").isNotNull()).select("event_id", "condition_id", "question")
    return live.join(ends, "condition_id", "left_semi").join(q, "condition_id", "left")


def ladder_slack(relations: DataFrame, markets: DataFrame, quotes: DataFrame, epsilon: float = DEFAULT_EPSILON) -> DataFrame:
    """Edges inside one event with slack P(from) − P(to); positive breaks the entailment."""
    priced = ladder_members(relations, markets, quotes).select("condition_id", "price")
    where = markets.select("condition_id", "event_id")
    a = where.join(priced, "condition_id", "left")
    edges = relations.where("type = 'implies'").select("from_condition_id", "to_condition_id", "source").distinct()
    f = a.select(F.col("condition_id").alias("from_condition_id"), F.col("event_id"), F.col("price").alias("p_from"))
    t = a.select(F.col("condition_id").alias("to_condition_id"), F.col("event_id").alias("e2"), F.col("price").alias("p_to"))
    both = edges.join(f, "from_condition_id").join(t, "to_condition_id").where("event_id = e2").drop("e2")
    slack = F.col("p_from") - F.col("p_to")
    return both.select("event_id", "from_condition_id", "to_condition_id", "source", slack.alias("slack"), (slack <= epsilon).alias("satisfied"))


def ladder_details(relations: DataFrame, markets: DataFrame, quotes: DataFrame, epsilon: float = DEFAULT_EPSILON) -> DataFrame:
    """Per event: members, priced members, edges and the worst slack."""
    m = ladder_members(relations, markets, quotes).groupBy("event_id").agg(
        F.count("*").alias("members"), F.count("price").alias("priced")
    )
    e = ladder_slack(relations, markets, quotes, epsilon).groupBy("event_id").agg(
        F.count("*").alias("edges"), F.max("slack").alias("worst_slack")
    )
    return m.join(e, "event_id", "left").select(
        "event_id", "members", "priced", F.coalesce("edges", F.lit(0)).alias("edges"), "worst_slack",
        F.coalesce(F.col("worst_slack") > epsilon, F.lit(False)).alias("violated"),
    )


# --- episodes for the report ----------------------------------------------------------------


def report_episodes(all_episodes: DataFrame, markets: DataFrame, now: Column) -> DataFrame:
    """Episodes with lifetime, category and days to resolution of their first market."""
    out = _question(with_lifetime(all_episodes), markets)
    slug = F.col("slug") if "slug" in out.columns else F.lit(None).cast("string")
    out = out.withColumn("category", category(F.col("question"), slug))
    if "end_date" in out.columns:
        days = (F.unix_micros("end_date") - F.unix_micros(now)) / 86_400e6
        out = out.withColumn("days_to_resolution", days)
    return out


def lifetime_buckets(all_episodes: DataFrame, table: Sequence[B.Bucket] = tuple(B.LIFETIME_DASHBOARD), sample: int | None = None) -> DataFrame:
    """Closed episodes and confirmed ones per lifetime bucket; empty buckets stay."""
    closed = with_lifetime(all_episodes).where(F.col("resolved_at").isNotNull())
    closed = top(closed, sample, F.desc("detected_at"), "episode_id")
    return bucketise(closed, "lifetime_seconds", table, {"confirmed": F.count_if("ever_confirmed")})


def lifetime_quantiles(all_episodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """Floor-index median and p90 of closed lifetimes, and the confirmed median."""
    closed = with_lifetime(all_episodes).where("lifetime_seconds >= 0")
    everyone = stats.floor_quantiles(closed, [], "lifetime_seconds", {"median_seconds": 0.5, "p90_seconds": 0.9}, buckets)
    confirmed = stats.floor_quantiles(closed.where("ever_confirmed"), [], "lifetime_seconds", {"confirmed_median_seconds": 0.5}, buckets)
    return one_row(closed.agg(F.count("*").alias("closed")), everyone, confirmed)


def bucketise(df: DataFrame, value: str, table: Sequence[B.Bucket], extra: dict[str, Column] | None = None) -> DataFrame:
    """(bucket, label, from_value, to_value, n, …) with empty buckets kept as zero."""
    extra = extra or {}
    inside = df.withColumn("bucket", B.bucket_of(F.col(value), table)).where(F.col("bucket").isNotNull())
    counts = inside.groupBy("bucket").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in extra.items()])
    filled = B.with_empty_buckets(counts, table)
    return filled.select(
        "bucket", "label", "from_value", "to_value", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n", *extra)]
    )


def rank_families(report: DataFrame, buckets: int | None = None) -> DataFrame:
    """Constraints by how often they broke: episodes, confirmed, median life, peak."""
    first = F.struct("kind", "question", "category")
    base = report.groupBy("constraint_key").agg(
        F.min_by(first, F.struct("detected_at", "episode_id")).alias("f"), F.count("*").alias("episodes"),
        F.count_if("ever_confirmed").alias("confirmed"), F.max("peak_magnitude").alias("peak_magnitude"),
    )
    life = stats.quantiles(report, ["constraint_key"], "lifetime_seconds", {"median_lifetime": 0.5}, buckets)
    return base.join(life, "constraint_key", "left").select(
        "constraint_key", "f.kind", F.col("f.question").alias("label"), "f.category", "episodes", "confirmed",
        "median_lifetime", "peak_magnitude",
    )


def confirmed_constraints(all_episodes: DataFrame, relations: DataFrame, markets: DataFrame) -> DataFrame:
    """The distinct pairwise constraints behind the confirmed set, with their provenance."""
    c = all_episodes.where(F.col("ever_confirmed") & (F.col("kind") != "partition")).groupBy("constraint_key").agg(
        F.count("*").alias("episodes"), F.max("peak_net_edge").alias("max_net_edge")
    )
    c = c.withColumn("id", F.split_part("constraint_key", F.lit(":"), F.lit(2)))
    r = relations.select(F.col("id").cast("string").alias("id"), "source", "rationale", "from_condition_id", "to_condition_id")
    return with_questions(c.join(r, "id", "left"), markets)


def lifetime_summary(report: DataFrame, groups: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """n, min, p25, median, p75, p95, max, mean of closed lifetimes per group."""
    return stats.summary(report, list(groups), "lifetime_seconds", buckets)


def magnitude_correlation(report: DataFrame, buckets: int | None = None) -> DataFrame:
    """Spearman of |peak magnitude| against lifetime: pooled (kind 'all') and per kind."""
    closed = report.where(F.col("lifetime_seconds").isNotNull()).select(
        "kind", F.abs("peak_magnitude").alias("size"), "lifetime_seconds"
    )
    return stats.spearman(closed, ["kind"], "size", "lifetime_seconds", buckets, pooled="all")


def magnitude_summary_by_kind(report: DataFrame, buckets: int | None = None) -> DataFrame:
    closed = report.where(F.col("lifetime_seconds").isNotNull()).select("kind", F.abs("peak_magnitude").alias("size"))
    return stats.summary(closed, ["kind"], "size", buckets)


def floor_share(report: DataFrame, seconds: float = FLOOR_SECONDS) -> DataFrame:
    """Share of closed lifetimes at the sampling floor."""
    return report.agg(F.avg((F.col("lifetime_seconds") <= seconds).cast("double")).alias("floor_share"))


def lifetime_by_magnitude(report: DataFrame, buckets: int | None = None) -> DataFrame:
    """Lifetime summary per magnitude bucket; empty buckets stay."""
    closed = report.where(F.col("lifetime_seconds").isNotNull()).withColumn(
        "bucket", B.bucket_of(F.abs("peak_magnitude"), B.MAGNITUDE)
    ).where(F.col("bucket").isNotNull())
    out = B.with_empty_buckets(stats.summary(closed, ["bucket"], "lifetime_seconds", buckets), B.MAGNITUDE)
    return out.drop("from_value", "to_value").withColumn("n", F.coalesce("n", F.lit(0)))


def category_mix(relations: DataFrame, members: DataFrame, markets: DataFrame) -> DataFrame:
    """Live markets under constraint per category."""
    covered = covered_markets(relations, members)
    live = live_markets(markets).join(covered, "condition_id", "left_semi")
    slug = F.col("slug") if "slug" in markets.columns else F.lit(None).cast("string")
    return live.groupBy(category(F.col("question"), slug).alias("category")).agg(F.count("*").alias("markets"))


def by_category(report: DataFrame, mix: DataFrame, buckets: int | None = None) -> DataFrame:
    """Episodes, confirmed, families, median life, markets and episodes per 1,000 markets."""
    base = report.groupBy("category").agg(
        F.count("*").alias("episodes"), F.count_if("ever_confirmed").alias("confirmed"),
        F.count_distinct("constraint_key").alias("families"),
    )
    life = stats.quantiles(report, ["category"], "lifetime_seconds", {"median_lifetime": 0.5}, buckets)
    names = report.sparkSession.createDataFrame([(c,) for c in CATEGORY_ORDER], "category string").coalesce(1)
    out = names.join(base, "category", "left").join(life, "category", "left").join(mix, "category", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("episodes", "confirmed", "families", "markets")]
    out = out.select("category", *zero, "median_lifetime")
    return out.withColumn("per_thousand", F.when(F.col("markets") > 0, F.col("episodes") / F.col("markets") * 1000))


def by_horizon(report: DataFrame, buckets: int | None = None) -> DataFrame:
    """Episodes and median life per time to resolution."""
    placed = report.withColumn("bucket", B.bucket_of(F.col("days_to_resolution"), B.HORIZON)).where(F.col("bucket").isNotNull())
    counts = placed.groupBy("bucket").agg(F.count("*").alias("episodes"))
    life = stats.quantiles(placed, ["bucket"], "lifetime_seconds", {"median": 0.5}, buckets)
    out = B.with_empty_buckets(counts.join(life, "bucket", "left"), B.HORIZON)
    return out.select("label", F.coalesce("episodes", F.lit(0)).alias("episodes"), "median")


def hour_grid(report: DataFrame) -> DataFrame:
    """Detections per UTC weekday (Monday = 0) and hour; cells never observed are null."""
    cells = report.select(F.weekday("detected_at").alias("weekday"), F.hour("detected_at").alias("hour"))
    return cells.groupBy("weekday").pivot("hour", list(range(24))).count()


def by_hour(report: DataFrame) -> DataFrame:
    """24 rows: episodes opened in each UTC hour."""
    counts = report.groupBy(F.hour("detected_at").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    hours = report.sparkSession.range(24).withColumnRenamed("id", "hour")
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def confirmed_share(report: DataFrame) -> DataFrame:
    return report.groupBy("kind").agg(
        F.count("*").alias("episodes"), F.count_if(~F.col("ever_confirmed")).alias("apparent"),
        F.count_if("ever_confirmed").alias("confirmed"), F.avg(F.col("ever_confirmed").cast("double")).alias("share"),
    )


def edge_buckets(report: DataFrame) -> DataFrame:
    return bucketise(report.where("ever_confirmed"), "peak_net_edge", B.EDGE)


def profit_summary(report: DataFrame, buckets: int | None = None) -> DataFrame:
    return stats.summary(report.where("ever_confirmed"), [], "peak_net_profit", buckets)


# --- catalog and coverage -------------------------------------------------------------------


def covered_markets(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct markets on any relation or in any group."""
    ends = relations.select(F.explode(F.array("from_condition_id", "to_condition_id")).alias("condition_id"))
    return ends.unionByName(members.select("condition_id")).distinct()


def catalog_stats(markets: DataFrame, relations: DataFrame, members: DataFrame, proposals: DataFrame, all_episodes: DataFrame) -> DataFrame:
    """One row: catalog, coverage, proposals and the observation window."""
    ends = relations.select(F.explode(F.array("from_condition_id", "to_condition_id")).alias("condition_id"))
    flags = ends.select("condition_id", F.lit(1).alias("r"), F.lit(0).alias("g")).unionByName(
        members.select("condition_id", F.lit(0).alias("r"), F.lit(1).alias("g"))
    ).groupBy("condition_id").agg(F.max("r").alias("r"), F.max("g").alias("g"))
    live = live_markets(markets).select("condition_id", F.lit(1).alias("live"))
    covered = flags.join(live, "condition_id", "left").agg(
        F.count_if(F.col("r") == 1).alias("in_relation"), F.count_if(F.col("g") == 1).alias("in_group"),
        F.count("*").alias("covered"), F.count("live").alias("active_covered"),
    )
    p = proposals.agg(
        F.count("*").alias("proposals"), F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(~F.col("status").isin("accepted", "rejected")).alias("pending"),
    )
    decided = F.col("accepted") + F.col("rejected")
    p = p.withColumn("acceptance_rate", F.when(decided > 0, F.col("accepted") / decided))
    window = all_episodes.agg(
        F.min("detected_at").alias("window_from"), F.max(F.coalesce("resolved_at", "last_checked_at")).alias("window_to")
    )
    window = window.withColumn("hours", (F.unix_micros("window_to") - F.unix_micros("window_from")) / 3.6e9)
    return one_row(market_counts(markets), covered, p, window)


def coverage(markets: DataFrame, relations: DataFrame, groups: DataFrame, members: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row: active, covered, quoted, constraints, and the unclassified share."""
    live = live_markets(markets).select("condition_id")
    a = live.agg(F.count("*").alias("active"))
    c = live.join(covered_markets(relations, members), "condition_id", "left_semi").agg(F.count("*").alias("covered"))
    q = quotes.where(F.col("yes_price").isNotNull()).join(live, "condition_id", "left_semi").agg(F.count("*").alias("quoted"))
    both_live = relations.join(live.withColumnRenamed("condition_id", "from_condition_id"), "from_condition_id", "left_semi").join(
        live.withColumnRenamed("condition_id", "to_condition_id"), "to_condition_id", "left_semi"
    )
    n = one_row(both_live.agg(F.count("*").alias("pairs")), groups.where("type = 'partition'").agg(F.count("*").alias("parts")))
    n = n.select((F.col("pairs") + F.col("parts")).alias("constraints"))
    mix = category_mix(relations, members, markets)
    share = mix.agg(
        (F.sum(F.when(F.col("category") == "other", F.col("markets")).otherwise(0)) / F.sum("markets")).alias("unclassified_share")
    )
    return one_row(a, c, q, n, share)
