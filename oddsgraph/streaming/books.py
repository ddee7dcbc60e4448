"""Live books: state per token in a stream, and the same result in one batch aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from oddsgraph.operators.relations import one_row
from oddsgraph.streaming.frames import BOOK, valid_change

# --- fixed values -------------------------------------------------------------
HASH_HISTORY = 4
TOP_TOLERANCE = 5e-4
LEVEL_TOLERANCE = 1e-6
# ------------------------------------------------------------------------------

BOOK_UPDATE = (
    "token_id string, condition_id string, ts_ms long, hash string, bid double, ask double, mid double,"
    "spread double, top_hint boolean, applied long, unseeded long"
)


def book_state(changes: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Levels standing after all changes: (token_id, side, price, size), in batch.

    ``changes``: token_id, side, price, size, ts and a tie-breaker ``seq``; the last
    write of a price wins and size 0 deletes. With ``seeds`` (token_id, seed_ts) and
    the seed levels among the changes at that time, older writes do not count and
    tokens without a seed have no book. One aggregate with map-side combine: a token
    with a third of the rows costs no task more than its share.
    """
    rows = changes.where(valid_change(F.col("price"), F.col("size")))
    if seeds is not None:
        first = seeds.groupBy("token_id").agg(F.max("seed_ts").alias("seed_ts"))
        rows = rows.join(first, "token_id").where(F.col("ts") >= F.col("seed_ts"))
    last = rows.groupBy("token_id", "side", "price").agg(
        F.max_by("size", F.struct("ts", "seq")).alias("size"), F.max("ts").alias("ts")
    )
    return last.where(F.col("size") > 0)


class BookProcessor(StatefulProcessor):
    """Book of one token: whole books replace it, changes apply once it is seeded.

    Of the changes that arrive before the seed the newest one per price waits, so the
    buffer is no larger than the price grid; on the seed the ones older than it are
    dropped and the rest applied. A token that stays without a seed for ``patience``
    milliseconds after its latest waiting change loses the buffer, by an event-time timer.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")
        self.meta = handle.getValueState("meta", "condition string, ts long, hash string, hashes string")
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.pending = handle.getMapState("pending", "side string, price double", "size double, ts long, hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "received_at", "frame_no", "seq"], kind="stable")
        meta = list(self.meta.get()) if self.meta.exists() else None
        applied = unseeded = 0
        hint_source, touched = None, False
        for e in batch.itertuples(index=False):
            ts = None if pd.isna(e.ts_ms) else int(e.ts_ms)
            if e.kind == BOOK:
                self.levels.clear()
                for side, levels in (("bid", e.bids), ("ask", e.asks)):
                    for level in levels if levels is not None else ():
                        self.levels.updateValue((side, float(level["price"])), (float(level["size"]),))
                meta = [e.condition_id or (meta[0] if meta else None), ts, *self._hash(meta, e.hash)]
                touched = True
                newest = None
                waiting = [(*k, *v) for k, v in self.pending.iterator()]
                for side, price, size, at, hash_ in sorted(waiting, key=lambda x: x[3]):
                    if at < (ts or 0):
                        continue
                    if self._apply(side, price, size):
                        applied += 1
                        newest = at if newest is None else max(newest, at)
                        meta[2:] = self._hash(meta, hash_)
                self.pending.clear()
                if newest:
                    meta[1] = newest
                continue
            price, size = float(e.price) if e.price == e.price else -1.0, float(e.size) if e.size == e.size else -1.0
            if meta is None:
                unseeded += 1
                place = (e.side, price)
                newer = not self.pending.containsKey(place) or self.pending.getValue(place)[1] <= (ts or 0)
                if 0 < price <= 1 and size >= 0 and newer:
                    self.pending.updateValue((e.side, price), (size, ts or 0, e.hash))
                continue
            if self._apply(e.side, price, size):
                applied += 1
                meta = [e.condition_id or meta[0], ts, *self._hash(meta, e.hash)]
                touched, hint_source = True, e
        if meta is not None:
            self.meta.update(tuple(meta))
        elif unseeded:
            self._wait(int(batch["received_at"].max().value // 1_000_000) + self.patience)
        if not touched:
            if unseeded:
                yield pd.DataFrame([(key[0], None, None, None, None, None, None, None, False, 0, unseeded)], columns=_COLUMNS)
            return
        bid, ask = self._top()
        both = bid is not None and ask is not None
        hint = False
        if both and hint_source is not None and hint_source.best_bid == hint_source.best_bid and hint_source.best_ask == hint_source.best_ask:
            hint = abs(bid - hint_source.best_bid) > TOP_TOLERANCE or abs(ask - hint_source.best_ask) > TOP_TOLERANCE
        yield pd.DataFrame(
            [(key[0], meta[0], meta[1], meta[2], bid, ask, (bid + ask) / 2 if both else None, ask - bid if both else None, hint, applied, unseeded)],
            columns=_COLUMNS,
        )

    def _wait(self, until: int) -> None:
        """One timer per token: the one before, if any, is taken back."""
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        self.until.update((until,))
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.meta.exists():
            self.pending.clear()
        self.until.clear()
        return iter(())

    def _apply(self, side: str, price: float, size: float) -> bool:
        if not 0 < price <= 1 or size < 0:
            return False
        if size == 0:
            self.levels.removeKey((side, price))
        else:
            self.levels.updateValue((side, price), (size,))
        return True

    def _hash(self, meta, new: str | None) -> tuple[str | None, str]:
        """Latest state hash and the recent ones, newest last."""
        latest, known = (meta[2], meta[3] or "") if meta else (None, "")
        if not new:
            return latest, known
        return new, ",".join([*[h for h in known.split(",") if h], new][-HASH_HISTORY:])

    def _top(self) -> tuple[float | None, float | None]:
        bid = ask = None
        for (side, price), _ in self.levels.iterator():
            if side == "bid":
                bid = price if bid is None else max(bid, price)
            else:
                ask = price if ask is None else min(ask, price)
        return bid, ask

    def close(self) -> None:
        pass


_COLUMNS = [c.strip().split(" ")[0] for c in BOOK_UPDATE.split(",")]


def stream_books(events: DataFrame, patience: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Book events to one update per token and micro-batch with the live top.

    ``patience`` is how long changes of a token without a book wait for one, by ``received_at``.
    """
    processor = BookProcessor(int(pd.Timedelta(patience).total_seconds() * 1000))
    return events.withWatermark("received_at", delay).groupBy("token_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=BOOK_UPDATE, outputMode="Update", timeMode="EventTime"
    )


# --- reconciliation -------------------------------------------------------------------------


def level_differences(live: DataFrame, rest: DataFrame) -> DataFrame:
    """Levels that disagree: (token_id, side, price, here, there). Sizes within 1e-6 agree."""
    here = live.select("token_id", "side", "price", F.col("size").alias("here"))
    there = rest.select("token_id", "side", "price", F.col("size").alias("there"))
    both = here.join(there, ["token_id", "side", "price"], "full_outer")
    same = F.coalesce(F.abs(F.col("here") - F.col("there")) <= LEVEL_TOLERANCE, F.lit(False))
    return both.where(~same)


def divergence_sample(differences: DataFrame, levels: int | None = None) -> DataFrame:
    """The differing levels of each token as text: all, or the first ``levels``."""
    first = Window.partitionBy("token_id").orderBy("side", "price")
    what = (
        F.when(F.col("here").isNull(), F.format_string("%s %s: rest %s, missing here", "side", "price", "there"))
        .when(F.col("there").isNull(), F.format_string("%s %s: here %s, absent from rest", "side", "price", "here"))
        .otherwise(F.format_string("%s %s: rest %s, here %s", "side", "price", "there", "here"))
    )
    ranked = differences.withColumn("rank", F.row_number().over(first)).select("token_id", "rank", what.alias("difference"))
    return ranked if levels is None else ranked.where(F.col("rank") <= levels)


def reconcile(state: DataFrame, live_levels: DataFrame, rest: DataFrame, rest_levels: DataFrame, parked: DataFrame) -> DataFrame:
    """Compare live books with fetched ones: one row per compared token with ``outcome``.

    ``state``: token_id, hash, hashes (array, recent). ``rest``: token_id, rest_hash.
    ``parked``: token_id, parked_hash — unknown states of the previous cycle.
    agreed, content (same hash, other levels), ahead (hash held before), pending
    (unknown, seen first now), stale (unknown for a second cycle). content and stale
    are to be repaired.
    """
    wanted = rest.select("token_id")
    differ = level_differences(
        live_levels.join(wanted, "token_id", "left_semi"), rest_levels.join(wanted, "token_id", "left_semi")
    ).groupBy("token_id").agg(F.count("*").alias("differences"))
    rows = state.join(rest, "token_id").join(differ, "token_id", "left").join(parked, "token_id", "left")
    known = (F.col("rest_hash") != "") & F.coalesce(F.array_contains("hashes", F.col("rest_hash")), F.lit(False))
    same = (F.col("rest_hash") != "") & F.coalesce(F.col("rest_hash") == F.col("hash"), F.lit(False))
    outcome = (
        F.when(same & F.col("differences").isNull(), "agreed")
        .when(same, "content")
        .when(known, "ahead")
        .when(F.coalesce(F.col("parked_hash") == F.col("rest_hash"), F.lit(False)), "stale")
        .otherwise("pending")
    )
    return rows.select(
        "token_id", "rest_hash", F.coalesce("differences", F.lit(0)).alias("differences"), outcome.alias("outcome")
    )


def reconcile_report(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("checked"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("agreed", "ahead", "content", "stale", "pending")],
    )


def still_parked(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == "pending").select("token_id", F.col("rest_hash").alias("parked_hash"))


def tokens_to_check(state: DataFrame, hints: DataFrame, budget: int) -> DataFrame:
    """Tokens to compare next: hinted ones up to half the budget, then the longest unchecked."""
    half = max(1, budget // 2)
    known = state.select("token_id")
    hinted = hints.select("token_id").distinct().join(known, "token_id", "left_semi").orderBy("token_id").limit(half)
    rest = state.join(hinted, "token_id", "left_anti").orderBy(F.asc_nulls_first("last_checked"), "token_id").limit(budget)
    both = hinted.select("token_id", F.lit(0).alias("turn"), F.lit(None).cast("timestamp").alias("last_checked")).unionByName(
        rest.select("token_id", F.lit(1).alias("turn"), "last_checked")
    )
    return both.orderBy("turn", F.asc_nulls_first("last_checked"), "token_id").limit(budget).select("token_id")


def stream_quality(updates: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Counts over emitted book updates, and divergences where outcomes are given."""
    out = updates.agg(
        F.count_distinct(F.when(F.col("ts_ms").isNotNull(), F.col("token_id"))).alias("seeded"),
        F.coalesce(F.sum("applied"), F.lit(0)).alias("applied"),
        F.coalesce(F.sum("unseeded"), F.lit(0)).alias("unseeded"),
        F.count_if("top_hint").alias("hints"),
    )
    if outcomes is None:
        return out
    return one_row(out, outcomes.agg(
        F.count_if(F.col("outcome") == "content").alias("content_divergences"),
        F.count_if(F.col("outcome") == "stale").alias("stale_divergences"),
    ))
