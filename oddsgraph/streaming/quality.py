"""Quality of a running feed: metrics computed in the stream itself and summed by a listener.

The counts ride on the micro-batches (no second scan, no extra state) and reach the driver as
one row a batch with the query's progress.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from oddsgraph.streaming.frames import BOOK, CHANGE, valid_change

FEED, BOOKS = "feed_quality", "book_quality"


def observed_events(events: DataFrame, name: str = FEED) -> DataFrame:
    """``book_events`` with counts of books, changes, changes out of range, and rows without a time or a token."""
    change = F.col("kind") == CHANGE
    return events.observe(
        name,
        F.count("*").alias("events"),
        F.count_if(F.col("kind") == BOOK).alias("books"),
        F.count_if(change).alias("changes"),
        F.count_if(change & ~valid_change(F.col("price"), F.col("size"))).alias("unusable"),
        F.count_if(F.col("ts_ms").isNull()).alias("untimed"),
        F.count_if(F.col("token_id").isNull()).alias("nameless"),
    )


def observed_updates(updates: DataFrame, name: str = BOOKS) -> DataFrame:
    """``stream_books`` with counts of updates, changes applied and held back, and hints of a wrong top."""
    return updates.observe(
        name,
        F.count("*").alias("updates"),
        F.coalesce(F.sum("applied"), F.lit(0)).alias("applied"),
        F.coalesce(F.sum("unseeded"), F.lit(0)).alias("unseeded"),
        F.count_if("top_hint").alias("hints"),
    )


class FeedQuality(StreamingQueryListener):
    """Sums the observed counts of every micro-batch by observation; each batch of a run counts once.

    It holds a few numbers for each observation and the last batch of each run, however long the
    stream goes on.
    """

    def __init__(self) -> None:
        self.totals: dict[str, Counter] = {}
        self.ended: set[str] = set()
        self._last: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run, batch = str(event.progress.runId), event.progress.batchId
        if not event.progress.observedMetrics or batch <= self._last.get(run, -1):
            return
        self._last[run] = batch
        for name, row in event.progress.observedMetrics.items():
            self.totals.setdefault(name, Counter()).update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))
        self._last.pop(str(event.runId), None)
