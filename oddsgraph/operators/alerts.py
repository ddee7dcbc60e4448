"""Alert decisions as tables: what to send, what to stay quiet about, and why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsgraph.operators.relations import one_row
from oddsgraph.scale import next_row, top

# --- fixed values -------------------------------------------------------------
COOLDOWN_SECONDS = 30 * 60
ESCALATION_FACTOR = 2.0
RESOLUTION_LOOKBACK_HOURS = 24
DIGEST_WORST = 5
INGEST_STALE_SECONDS = 30 * 60
RATE_LIMIT_HITS = 50
RATE_LIMIT_WINDOW_SECONDS = 10 * 60
QUEUE_DEPTH = 5
PARSE_FAILURE_RATE = 0.05
PARSE_FAILURE_MIN_SAMPLE = 200
# (marker in the reason, class)
REASON_CLASSES = [
    ("spread and fees", "spread and fees exceed the mispricing"),
    ("too thin to be worth taking", "edge real but immaterial"),
    ("cannot be bought", "a leg has nothing offered"),
    ("minimum order size", "below the venue minimum order size"),
    ("no order book", "no order book for a leg"),
    ("already closed", "stale screen quote; gap had closed"),
]
# ------------------------------------------------------------------------------


def meets_floor(net_edge: Column, net_profit: Column, min_edge: float, min_profit: float) -> Column:
    """Both floors cleared by finite values."""
    finite = net_edge.isNotNull() & net_profit.isNotNull() & ~F.isnan(net_edge) & ~F.isnan(net_profit)
    finite = finite & (F.abs(net_edge) < float("inf")) & (F.abs(net_profit) < float("inf"))
    return F.coalesce(finite & (net_edge >= min_edge) & (net_profit >= min_profit), F.lit(False))


def decide(
    known: Column,
    last_sent_at: Column,
    last_value: Column,
    resolved_notified_at: Column,
    value: Column,
    resolved: Column,
    now: Column,
    cooldown_seconds: float = COOLDOWN_SECONDS,
    factor: float = ESCALATION_FACTOR,
) -> Column:
    """send, escalate, resolve or suppress."""
    waited = (F.unix_micros(now) - F.unix_micros(last_sent_at)) / 1e6
    no_value = value.isNull() | last_value.isNull() | (last_value <= 0)
    return (
        F.when(~known, F.when(resolved, "suppress").otherwise("send"))
        .when(resolved, F.when(resolved_notified_at.isNull(), "resolve").otherwise("suppress"))
        .when(resolved_notified_at.isNotNull(), "suppress")
        .when(waited < cooldown_seconds, "suppress")
        .when(no_value, F.when(value.isNull() & last_value.isNull(), "send").otherwise("suppress"))
        .when(value >= last_value * factor, "escalate")
        .otherwise("suppress")
    )


def violation_key(episode_id: Column) -> Column:
    return F.concat(F.lit("violation:"), episode_id)


def _with_state(rows: DataFrame, deliveries: DataFrame) -> DataFrame:
    state = deliveries.select(
        "alert_key", F.struct("last_sent_at", "last_alert_value", "resolved_notified_at").alias("d")
    )
    return rows.join(state, "alert_key", "left").withColumn("known", F.col("d").isNotNull())


def confirmed_to_alert(all_episodes: DataFrame, confirmed_keys: DataFrame) -> DataFrame:
    """Open, ever confirmed episodes of the constraints confirmed in this run."""
    return all_episodes.where(F.col("resolved_at").isNull() & F.col("ever_confirmed")).join(
        confirmed_keys.select("constraint_key").distinct(), "constraint_key", "left_semi"
    )


def confirmed_decisions(
    violations: DataFrame, deliveries: DataFrame, now: Column, min_edge: float, min_profit: float,
    cooldown_seconds: float = COOLDOWN_SECONDS, factor: float = ESCALATION_FACTOR,
) -> DataFrame:
    """Decision per confirmed episode; 'below_threshold' where a floor is missed."""
    keyed = violations.withColumn("alert_key", violation_key(F.col("episode_id")))
    rows = _with_state(keyed, deliveries)
    verdict = decide(
        F.col("known"), F.col("d.last_sent_at"), F.col("d.last_alert_value"), F.col("d.resolved_notified_at"),
        F.col("peak_net_edge"), F.lit(False), now, cooldown_seconds, factor,
    )
    ok = meets_floor(F.col("peak_net_edge"), F.col("peak_net_profit"), min_edge, min_profit)
    return rows.select(
        "alert_key", "episode_id", "constraint_key", F.col("peak_net_edge").alias("value"),
        F.when(ok, verdict).otherwise("below_threshold").alias("decision"),
    )


def recently_resolved(all_episodes: DataFrame, deliveries: DataFrame, now: Column, hours: int = RESOLUTION_LOOKBACK_HOURS, limit: int | None = None) -> DataFrame:
    """Confirmed episodes closed within the lookback whose ending was announced to nobody yet."""
    waiting = deliveries.where(F.col("resolved_notified_at").isNull()).select("alert_key")
    recent = all_episodes.where(
        F.col("ever_confirmed") & (F.col("resolved_at") >= now - F.expr(f"interval {int(hours)} hours"))
    ).withColumn("alert_key", violation_key(F.col("episode_id")))
    out = recent.join(waiting, "alert_key", "left_semi")
    return top(out, limit, F.desc("resolved_at"), "episode_id")


def resolution_decisions(resolved: DataFrame, deliveries: DataFrame, now: Column) -> DataFrame:
    keyed = resolved.drop("alert_key").withColumn("alert_key", violation_key(F.col("episode_id")))
    rows = _with_state(keyed, deliveries)
    verdict = decide(
        F.col("known"), F.col("d.last_sent_at"), F.col("d.last_alert_value"), F.col("d.resolved_notified_at"),
        F.lit(None).cast("double"), F.lit(True), now,
    )
    return rows.select("alert_key", "episode_id", "constraint_key", F.lit(None).cast("double").alias("value"), verdict.alias("decision"))


def alert_context(members: DataFrame, markets: DataFrame, events: DataFrame, quotes: DataFrame) -> DataFrame:
    """Question, slug, event slug and price of every member market of the given constraints."""
    m = markets.select("condition_id", "event_id", "question", "slug")
    e = events.select(F.col("id").alias("event_id"), F.col("slug").alias("event_slug"))
    q = quotes.select("condition_id", F.col("yes_price").cast("double").alias("price"))
    return members.select("constraint_key", "condition_id").join(m, "condition_id", "left").join(e, "event_id", "left").join(
        q, "condition_id", "left"
    )


def updated_deliveries(deliveries: DataFrame, decisions: DataFrame, now: Column, kind: str = "violation") -> DataFrame:
    """Deliveries after acting on the decisions.

    A first send inserts only if the key is absent; a repeat moves the last value and
    counts; a resolution is stamped once. Safe to run again with the same input.
    """
    acted = decisions.where(F.col("decision").isin("send", "escalate", "resolve")).select(
        "alert_key", F.struct("decision", "value").alias("a")
    )
    both = deliveries.join(acted, "alert_key", "full_outer")
    known = F.col("first_sent_at").isNotNull()
    what = F.col("a.decision")
    spoke = what.isin("send", "escalate")
    return both.select(
        "alert_key",
        F.coalesce("kind", F.lit(kind)).alias("kind"),
        F.coalesce("first_sent_at", now).alias("first_sent_at"),
        F.when(spoke, now).otherwise(F.col("last_sent_at")).alias("last_sent_at"),
        F.when(spoke, F.col("a.value")).otherwise(F.col("last_alert_value")).alias("last_alert_value"),
        (F.coalesce("send_count", F.lit(0)) + F.when(spoke, 1).otherwise(0)).alias("send_count"),
        (F.coalesce("escalations", F.lit(0)) + F.when(known & (what == "escalate"), 1).otherwise(0)).alias("escalations"),
        F.coalesce("resolved_notified_at", F.when(what == "resolve", now)).alias("resolved_notified_at"),
    )


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("n"))


# --- digest ---------------------------------------------------------------------------------


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def reason_class(reason: Column) -> Column:
    out = F.when(reason.isNull() | (F.trim(reason) == ""), "unknown")
    for marker, name in REASON_CLASSES:
        out = out.when(reason.contains(marker), name)
    return out.otherwise(reason)


def digest_window(now: Column) -> tuple[Column, Column]:
    """The last complete hour before ``now``."""
    end = hour_bucket(now)
    return end - F.expr("interval 1 hour"), end


def hourly_digest(all_episodes: DataFrame, start: Column, end: Column, worst: int = DIGEST_WORST) -> dict[str, DataFrame]:
    """One hour's digest: totals and counts by reason class over all entries, and the ``worst`` gaps."""
    window = all_episodes.where((F.col("detected_at") >= start) & (F.col("detected_at") < end))
    entries = window.where(~F.col("ever_confirmed"))
    by_reason = entries.groupBy(reason_class(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"))
    gaps = top(entries.where(F.col("screen_magnitude").isNotNull()), worst, F.desc("screen_magnitude"), "episode_id")
    totals = one_row(
        entries.agg(F.count("*").alias("apparent")), window.agg(F.count_if("ever_confirmed").alias("confirmed"))
    )
    return {"totals": totals, "by_reason": by_reason, "worst": gaps}


def digests_by_hour(all_episodes: DataFrame) -> DataFrame:
    """Every hour at once: apparent and confirmed counts per (hour, reason class)."""
    apparent = ~F.col("ever_confirmed")
    why = F.when(apparent, reason_class(F.col("reason"))).otherwise("confirmed")
    return all_episodes.groupBy(hour_bucket(F.col("detected_at")).alias("hour"), why.alias("reason")).agg(
        F.count("*").alias("n"), F.max("screen_magnitude").alias("worst")
    )


# --- system signals -------------------------------------------------------------------------


def system_findings(samples: DataFrame, buckets: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """(source, sampled_at, name, severity, value) from cumulative counters.

    ``samples``: source, sampled_at, last_ingest_at, rate_limit_hits, queue_depth, records,
    parse_issues. Each sample is compared with the one before it; ``tie`` orders samples of
    a source at one time and is needed where there are such.
    """
    cols = ["sampled_at", "rate_limit_hits", "queue_depth", "records", "parse_issues", "last_ingest_at"]
    steps = next_row(samples, ["source"], "sampled_at", cols, "to_", buckets, tie)
    elapsed = (F.unix_micros("to_sampled_at") - F.unix_micros("sampled_at")) / 1e6
    hits = F.greatest(F.lit(0), F.col("to_rate_limit_hits") - F.col("rate_limit_hits")) / elapsed * RATE_LIMIT_WINDOW_SECONDS
    grown = (F.col("to_queue_depth") > QUEUE_DEPTH) & (F.col("to_queue_depth") > F.col("queue_depth"))
    records = F.col("to_records") - F.col("records")
    rate = F.greatest(F.lit(0), F.col("to_parse_issues") - F.col("parse_issues")) / F.when(records > 0, records)
    found = F.array_compact(
        F.array(
            _finding(hits > RATE_LIMIT_HITS, "rate-limit-spike", "warning", hits),
            _finding(grown, "queue-depth-growing", "warning", F.col("to_queue_depth").cast("double")),
            _finding((records >= PARSE_FAILURE_MIN_SAMPLE) & (rate > PARSE_FAILURE_RATE), "parse-failures", "critical", rate),
        )
    )
    moved = steps.where(F.col("to_sampled_at").isNotNull() & (elapsed > 0)).select(
        "source", F.col("to_sampled_at").alias("sampled_at"), F.inline(found)
    )
    silent = (F.unix_micros("sampled_at") - F.unix_micros("last_ingest_at")) / 1e6
    stale = samples.where(silent > INGEST_STALE_SECONDS).select(
        "source", "sampled_at", F.lit("ingest-stale").alias("name"), F.lit("critical").alias("severity"), silent.alias("value")
    )
    return stale.unionByName(moved)


def _finding(when: Column, name: str, severity: str, value: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), value.alias("value")))
