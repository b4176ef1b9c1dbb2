"""Link observations as a stream: the state of each link kept with timers, and counts of passable links by window."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from headwater.operators.network import passable_links

#: Rows of ``link_states``.
STATES = "link long, seen timestamp, depth double, observed long, expired boolean"


def passable_counts(links: DataFrame, scenarios: DataFrame, depth: Column, ts: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Passable links per scenario and event-time window; rows later than ``late`` are left out by the watermark."""
    kept = passable_links(links.withWatermark(ts, late), scenarios, depth)
    return kept.groupBy(F.window(ts, window), "scenario").agg(F.count(F.lit(1)).alias("n"))


class LastDepth(StatefulProcessor):
    """The last depth of one link, how many observations it has had, and a timer that ends its state when no more come."""

    def __init__(self, keep_seconds: int) -> None:
        self.keep_ms = keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen timestamp, depth double, observed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        seen, depth, observed = held if held else (None, None, 0)
        for part in rows:
            # Of equal times the greatest depth counts; an unknown depth is less than any.
            part = part.sort_values(["ts", "depth"], na_position="first")
            observed += len(part)
            ts, value = part["ts"].iloc[-1].to_pydatetime(), part["depth"].iloc[-1]
            value = None if pd.isna(value) else float(value)
            if seen is None or (ts, -1.0 if value is None else value) >= (seen, -1.0 if depth is None else depth):
                seen, depth = ts, value
        if seen is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((seen, depth, observed))
        self.handle.registerTimer(int(seen.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) + self.keep_ms)
        yield self._row(key, seen, depth, observed, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            seen, depth, observed = self.last.get()
            self.last.clear()
            yield self._row(key, seen, depth, observed, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, seen, depth, observed, expired) -> pd.DataFrame:
        return pd.DataFrame({"link": [key[0]], "seen": [seen], "depth": pd.array([depth], dtype="Float64"), "observed": [observed], "expired": [expired]})


def link_states(observations: DataFrame, late: str = "2 hours", keep_seconds: int = 86_400) -> DataFrame:
    """Updates of each link's state from a stream (link long, ts timestamp, depth double): its last depth so far, or that its state has ended.

    Rows behind the watermark (``late``) are dropped by the engine. A link that is not observed for ``keep_seconds`` of event time yields one
    row with ``expired`` and is forgotten, so the state is bounded by the links of that time, however long the stream. A null link or time is left out. The session has to name
    the RocksDB state store (``state_store``).
    """
    known = observations.where("link is not null and ts is not null").select("link", F.col("ts").cast("timestamp").alias("ts"), "depth").withWatermark("ts", late)
    return known.groupBy("link").transformWithStateInPandas(LastDepth(keep_seconds), STATES, outputMode="Update", timeMode="EventTime")


def state_store(spark) -> None:
    """Name the state store that timers need, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
