"""Watching constraints on live mids: transitions, episodes, triggers and digests."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from oddsgraph.functions.buckets import LATENCY_SECONDS
from oddsgraph.functions.stats import cumulative_histogram, floor_quantiles
from oddsgraph.operators.alerts import reason_class
from oddsgraph.operators.screen import DEFAULT_EPSILON, pricing_tokens
from oddsgraph.scale import next_row

# At most one trigger per this many seconds.
TRIGGER_COOLDOWN_SECONDS = 5.0

DETECTION = (
    "constraint_key string, kind string, magnitude double, direction string, at_ms long, detected_ms long, latency_ms long"
)
_DETECTION_COLUMNS = [c.strip().split(" ")[0] for c in DETECTION.split(",")]


def token_index(members: DataFrame, markets: DataFrame) -> DataFrame:
    """(token_id, constraint_key, kind, pos, condition_id, need): which constraints a token moves."""
    need = members.groupBy("constraint_key").agg(F.count("*").alias("need"))
    tokens = pricing_tokens(markets)
    return members.join(need, "constraint_key").join(tokens, "condition_id").select(
        "token_id", "constraint_key", "kind", "pos", "condition_id", "need"
    )


def dirty_constraints(updates: DataFrame, index: DataFrame) -> DataFrame:
    """Constraint keys touched by book updates (stream or batch), with the newest change."""
    return updates.join(index, "token_id").select(
        "constraint_key", "kind", "pos", "condition_id", "need", "mid", "ts_ms", "received_ms"
    )


class WatchProcessor(StatefulProcessor):
    """Prices of one constraint's members; a row goes out only when it turns violated.

    A member without a mid makes it undecided, which changes nothing.
    """

    def __init__(self, epsilon: float = DEFAULT_EPSILON):
        self.epsilon = epsilon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prices = handle.getMapState("prices", "condition string", "pos int, price double, ts long")
        self.violating = handle.getValueState("violating", "on boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "condition_id"], kind="stable")
        kind, need = batch["kind"].iloc[0], int(batch["need"].iloc[0])
        for r in batch.itertuples(index=False):
            price = None if pd.isna(r.mid) else float(r.mid)
            ts = int(r.received_ms) if pd.isna(r.ts_ms) else int(r.ts_ms)
            held = self.prices.getValue((r.condition_id,))
            if held is None or held[2] <= ts:  # late rows never move a price back
                self.prices.updateValue((r.condition_id,), (int(r.pos), price, ts))
        held = [v for _, v in self.prices.iterator()]
        if len(held) < need or any(v[1] is None for v in held):
            return
        if kind == "implies":
            by_pos = {v[0]: v[1] for v in held}
            gap = size = by_pos.get(0, 0.0) - by_pos.get(1, 0.0)
        else:
            gap = sum(v[1] for v in held) - 1
            size = abs(gap)
        was = self.violating.exists() and self.violating.get()[0]
        now = size > self.epsilon
        if now != bool(was):
            self.violating.update((now,))
        if not now or was:
            return
        at, seen = max(v[2] for v in held), int(batch["received_ms"].max())
        yield pd.DataFrame(
            [(key[0], kind, size, "over" if gap > 0 else "under", at, seen, max(0, seen - at))], columns=_DETECTION_COLUMNS
        )

    def close(self) -> None:
        pass


def stream_detections(updates: DataFrame, index: DataFrame, epsilon: float = DEFAULT_EPSILON) -> DataFrame:
    """Book updates joined to the static index, then state per constraint."""
    return dirty_constraints(updates, index).groupBy("constraint_key").transformWithStateInPandas(
        statefulProcessor=WatchProcessor(epsilon), outputStructType=DETECTION, outputMode="Append", timeMode="None"
    )


def transitions(checks: DataFrame, buckets: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """Satisfied-to-violated changes of a history of checks, in batch.

    Undecided checks are skipped; the first decided check of a key counts as a change
    when it is violated.
    """
    decided = checks.where(~F.col("unscreenable")).select("constraint_key", "check_ts", "violated", "magnitude", *(tie or []))
    steps = next_row(decided, ["constraint_key"], "check_ts", ["check_ts", "violated", "magnitude"], "next_", buckets, tie or ())
    turned = steps.where(~F.col("violated") & F.col("next_violated")).select(
        "constraint_key", F.col("next_check_ts").alias("check_ts"), F.col("next_magnitude").alias("magnitude")
    )
    order = F.struct("check_ts", *(tie or []))
    first = decided.groupBy("constraint_key").agg(F.min_by(F.struct("check_ts", "violated", "magnitude"), order).alias("f"))
    opened = first.where("f.violated").select("constraint_key", "f.check_ts", "f.magnitude")
    return turned.unionByName(opened)


# --- latency --------------------------------------------------------------------------------


def latency_histogram(detections: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative latency buckets in seconds, with sum and count."""
    return cumulative_histogram(
        detections.withColumn("seconds", F.col("latency_ms") / 1000), list(groups), "seconds", LATENCY_SECONDS
    )


def latency_quantiles(detections: DataFrame, buckets: int | None = None) -> DataFrame:
    return floor_quantiles(detections, [], "latency_ms", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, buckets)


# --- triggers and streaming sinks -----------------------------------------------------------


class TriggerGate:
    """foreachBatch sink: calls ``fire`` for a batch with detections, at most once per cooldown.

    The last call is known to this object only; ``stream_triggers`` remembers it across restarts.
    """

    def __init__(self, fire: Callable[[DataFrame], None], cooldown: float = TRIGGER_COOLDOWN_SECONDS, clock: Callable[[], float] | None = None):
        self.fire, self.cooldown, self.clock = fire, cooldown, clock or time.time
        self.last: float | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        now = self.clock()
        if self.last is not None and now - self.last < self.cooldown:
            return
        self.last = now
        self.fire(batch)


TRIGGER = "scope string, fired_ms long, detections long, held_back long"


class TriggerProcessor(StatefulProcessor):
    """The cooldown of one scope, kept in the stream's checkpoint.

    A row goes out when detections arrive and no cooldown runs. Those that arrive while one
    runs are counted and told with the next row. A timer ends the cooldown, so a scope that
    falls silent leaves no state but its count of what was held back.
    """

    def __init__(self, cooldown: float = TRIGGER_COOLDOWN_SECONDS):
        self.cooldown = int(cooldown * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "fired long")
        self.held = handle.getValueState("held", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = sum(int(part["n"].sum()) for part in rows)
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.held.get()[0] if self.held.exists() else 0
        if self.last.exists() and now - self.last.get()[0] < self.cooldown:
            self.held.update((held + n,))
            return
        self.last.update((now,))
        self.held.clear()
        self.handle.registerTimer(now + self.cooldown)
        yield pd.DataFrame([(key[0], now, n, held)], columns=["scope", "fired_ms", "detections", "held_back"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A later firing has a timer of its own.
        if self.last.exists() and expiredTimerInfo.getExpiryTimeInMs() - self.last.get()[0] >= self.cooldown:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield batch.groupby("scope", as_index=False).size().rename(columns={"size": "n"})


def stream_triggers(detections: DataFrame, cooldown: float = TRIGGER_COOLDOWN_SECONDS, scope: Column | None = None) -> DataFrame:
    """(scope, fired_ms, detections, held_back): when to run the full check, at most once per cooldown and scope.

    Detections are counted where they lie, so a scope receives a few rows from each partition,
    however many there were. A restart from the checkpoint goes on in the same cooldown.
    """
    scoped = detections.select((F.lit("all") if scope is None else scope.cast("string")).alias("scope"))
    return scoped.mapInPandas(_counted, "scope string, n long").groupBy("scope").transformWithStateInPandas(
        statefulProcessor=TriggerProcessor(cooldown), outputStructType=TRIGGER, outputMode="Append", timeMode="ProcessingTime"
    )


# --- episodes and digests -------------------------------------------------------------------

EPISODE_CHANGE = (
    "constraint_key string, change string, at timestamp, detected_at timestamp, resolved_at timestamp, checks long,"
    "kind string, members int, reason string, ever_confirmed boolean, screen_magnitude double, peak_magnitude double, peak_net_profit double"
)
_CHANGE_COLUMNS = [c.strip().split(" ")[0] for c in EPISODE_CHANGE.split(",")]
_CHECK_COLUMNS = ["check_ts", "violated", "unscreenable", "magnitude", "confirmed", "net_profit", "reason", "kind", "members"]


class EpisodeProcessor(StatefulProcessor):
    """The open episode of one constraint: a row when it opens, when its reason or confirmation changes, and when it closes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState(
            "open",
            "detected long, checks long, kind string, members int, reason string, confirmed boolean, screen double, magnitude double, profit double",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        batch = (parts[0] if len(parts) == 1 else pd.concat(parts))[_CHECK_COLUMNS]
        if not batch["check_ts"].is_monotonic_increasing:
            batch = batch.sort_values("check_ts", kind="stable")
        held = self.open.get()  # each question to the state is a round trip
        current = None if held is None else list(held)
        out = []

        def told(change: str, at: pd.Timestamp) -> None:
            detected, checks, *rest = current
            ended = at if change == "closed" else None
            out.append((key[0], change, at, pd.Timestamp(detected, unit="us"), ended, checks, *rest))

        for at, violated, unscreenable, magnitude, confirmed, profit, reason, kind, members in batch.itertuples(index=False, name=None):
            if unscreenable:
                continue
            if not violated:
                if current is not None:
                    told("closed", at)
                    current = None
                continue
            magnitude = None if pd.isna(magnitude) else float(magnitude)
            profit = None if pd.isna(profit) else float(profit)
            reason = None if pd.isna(reason) else reason
            opened = current is None
            if opened:
                members = None if pd.isna(members) else int(members)
                current = [int(at.value // 1000), 0, kind, members, reason, False, magnitude, None, None]
            before = current[4], current[5]
            current[1] += 1
            current[4], current[5] = reason, current[5] or bool(confirmed)
            current[7] = _larger(current[7], magnitude)
            current[8] = _larger(current[8], profit)
            if opened or before != (current[4], current[5]):
                told("opened" if opened else "changed", at)
        if current is not None:
            self.open.update(tuple(current))
        elif held is not None:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=_CHANGE_COLUMNS)

    def close(self) -> None:
        pass


def _larger(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else max(a, b)


def stream_episode_changes(checks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Every change of every episode of a stream of checks, with ``at``, the time of the check, as its event time.

    The watermark is handed on, so a stateful operator may follow in the same query.
    """
    return checks.select("constraint_key", *_CHECK_COLUMNS).withWatermark("check_ts", delay).groupBy("constraint_key").transformWithStateInPandas(
        statefulProcessor=EpisodeProcessor(), outputStructType=EPISODE_CHANGE, outputMode="Append", timeMode="EventTime", eventTimeColumnName="at"
    )


def stream_episodes(checks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Closed episodes of a stream of checks (see ``episodes`` for the columns)."""
    return stream_episode_changes(checks, delay).where("change = 'closed'").drop("change", "at")


def stream_digest(changes: DataFrame, grace: str = "1 hour") -> DataFrame:
    """(hour, reason, n, worst): each hour's episodes by class once the hour and ``grace`` are over.

    ``changes`` is ``stream_episode_changes``. An episode belongs to the hour it opened in, under
    its class at the end of the grace; what it does later changes nothing, in whatever batches it
    arrives. See ``digests_by_hour`` for the batch form.

    The newest change of each episode and then the counts of each class are Spark's own aggregates
    over a window that ends with the grace, so an hour is spread over all tasks. Session time zones other
    than UTC may have hours that begin within a window; theirs is an hour longer and tells them later.
    """
    grace_ms = int(pd.Timedelta(grace).total_seconds() * 1000)
    aligned = changes.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z", "GMT")
    length = f"{3_600_000 * (1 if aligned else 2) + grace_ms} milliseconds"
    why = F.when(F.col("ever_confirmed"), "confirmed").otherwise(reason_class(F.col("reason")))
    hour = F.date_trunc("hour", "detected_at")
    in_time = changes.select(
        F.window("at", length, "1 hour").alias("open"), hour.alias("hour"), "constraint_key", "detected_at", "at", "checks", why.alias("reason"), "screen_magnitude"
    ).where(
        (F.col("open.start") <= F.col("hour")) & (F.col("hour") < F.col("open.start") + F.expr("interval 1 hour"))
        & (F.unix_millis("at") < F.unix_millis("hour") + 3_600_000 + grace_ms)
    )
    # A check that changes an episode counts one more, so changes at one time have an order.
    newest = in_time.groupBy("open", "hour", "constraint_key", "detected_at").agg(
        F.max_by(F.struct("reason", "screen_magnitude"), F.struct("at", "checks")).alias("last")
    )
    told = newest.groupBy("open", "hour", "last.reason").agg(
        F.count("*").alias("n"), F.max("last.screen_magnitude").alias("worst")
    )
    return told.select("hour", "reason", "n", "worst")


def received_ms(ts: Column) -> Column:
    return F.unix_millis(ts)
