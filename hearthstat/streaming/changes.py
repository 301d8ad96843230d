"""Structured Streaming twins of the batch operators.

Keyed state needs the RocksDB state store provider (``use_state``).  Streams whose state has a time to live run batches
without data for ever; with an availableNow trigger set spark.sql.streaming.noDataMicroBatches.enabled to false for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGE = "listing_id long, sequence long, observed_at timestamp, change string, old_price double, new_price double"
IDLE = "listing_id long, last_seen timestamp, inactive boolean"
MISSED = "listing_id long, cycle long, missing_cycles long, inactive boolean"
BUCKETS = 64
DAY_MS = 86_400_000


def use_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str, late: str = "2 days") -> DataFrame:
    """One row a key within the lateness bound."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class _Changes(StatefulProcessor):
    """The last price and status of a listing; forgotten after ``days`` without a row."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double, status string", ttlDurationMs=self.days * DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values(["observed_at", "sequence"], ignore_index=True)
        price, status = self.last.get() if self.last.exists() else (None, None)
        fresh = status is None
        old_price, old_status = d["asking_price"].shift(), d["status"].shift()
        if not fresh:
            old_price.iloc[0], old_status.iloc[0] = price, status
        first = np.zeros(len(d), bool)
        first[0] = fresh
        kind = np.select([first, d["status"] != old_status, d["asking_price"] < old_price, d["asking_price"] > old_price], ["created", d["status"], "price_drop", "price_increase"], "")
        self.last.update((float(d["asking_price"].iloc[-1]), d["status"].iloc[-1]))
        out = pd.DataFrame({"listing_id": key[0], "sequence": d["sequence"], "observed_at": d["observed_at"], "change": kind, "old_price": old_price, "new_price": d["asking_price"]})
        yield out[out["change"] != ""]

    def close(self) -> None:
        pass


def listing_changes_stream(snaps: DataFrame, days: int = 365) -> DataFrame:
    """Changes of each listing as its snapshots arrive, compared a batch at a time; equals the batch form over rows that
    arrive in order.  A listing unseen for ``days`` counts as new again."""
    return snaps.groupBy("listing_id").transformWithStateInPandas(_Changes(days), CHANGE, "append", "ProcessingTime")


class _Idle(StatefulProcessor):
    """Speaks up when the watermark passes a listing's last sight by ``days``, without a row of that listing."""

    def __init__(self, days: int):
        self.idle = days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long, inactive boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(d["observed_at"].max().value // 1_000_000) for d in rows)
        at, inactive = self.seen.get() if self.seen.exists() else (None, False)
        if at is not None and at >= newest:
            return
        if at is not None and not inactive:
            self.handle.deleteTimer(at + self.idle)
        self.seen.update((newest, False))
        self.handle.registerTimer(newest + self.idle)
        if at is None or inactive:
            yield self.row(key, newest, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, _ = self.seen.get()
        self.seen.update((at, True))
        yield self.row(key, at, True)

    def row(self, key, at: int, inactive: bool) -> pd.DataFrame:
        return pd.DataFrame({"listing_id": [key[0]], "last_seen": [pd.Timestamp(at, unit="ms")], "inactive": [inactive]})

    def close(self) -> None:
        pass


def inactive_after_stream(snaps: DataFrame, days: int = 2, late: str = "0 seconds") -> DataFrame:
    """A row when a listing is first seen, when it has been unseen for ``days`` of event time, and when it comes back."""
    return snaps.withWatermark("observed_at", late).groupBy("listing_id").transformWithStateInPandas(_Idle(days), IDLE, "append", "EventTime")


class _Missed(StatefulProcessor):
    """Of one bucket of listings: completed cycles that each missed in each scope since it was last seen there."""

    def __init__(self, least: int, days: int):
        self.least, self.days = least, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.missed = handle.getMapState("missed", "scope string, listing_id long", "cycle long, missed long", ttlDurationMs=self.days * DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values(["cycle", "done"], kind="stable")
        state = {tuple(k): tuple(v) for k, v in self.missed.iterator()}  # one bucket of listings
        before, touched, newest = self._least(state), set(), 0
        for (cycle, done), g in d.groupby(["cycle", "done"], sort=True):
            newest = cycle
            if done:
                for scope in set(g["scope"]):
                    for k, (last, n) in state.items():
                        if k[0] == scope and last < cycle:
                            state[k] = (last, n + 1)
                            touched.add(k)
            else:
                for k in {(s, int(i)) for s, i in zip(g["scope"], g["listing_id"], strict=True)}:
                    state[k] = (int(cycle), 0)
                    touched.add(k)
        for k in touched:
            self.missed.updateValue(k, state[k])
        after = self._least(state)
        turned = [i for i in sorted({k[1] for k in touched}) if (before.get(i, 0) >= self.least) != (after[i] >= self.least)]
        yield pd.DataFrame({"listing_id": turned, "cycle": [int(newest)] * len(turned), "missing_cycles": [after[i] for i in turned], "inactive": [after[i] >= self.least for i in turned]})

    @staticmethod
    def _least(state: dict) -> dict:
        out: dict[int, int] = {}
        for (_, i), (_, n) in state.items():
            out[i] = min(n, out.get(i, n))
        return out

    def close(self) -> None:
        pass


def missing_cycles_stream(sightings: DataFrame, cycles: DataFrame, enabled: list[str], least: int = 3, days: int = 365, buckets: int = BUCKETS) -> DataFrame:
    """A row when a listing turns inactive, having missed ``least`` completed cycles in all its enabled scopes, and when it
    is seen again.

    ``sightings``: scope, listing_id, cycle; ``cycles``: scope, cycle of each completed one.  Listings are dealt to
    buckets; the end of a cycle goes to every bucket, so a listing turns inactive without a row of its own.
    """
    of = F.pmod(F.xxhash64("listing_id"), F.lit(buckets)).cast("int")
    seen = sightings.filter(F.col("scope").isin(enabled) & F.col("listing_id").isNotNull()).select(of.alias("bucket"), "scope", "listing_id", "cycle", F.lit(False).alias("done"))
    ends = cycles.filter(F.col("scope").isin(enabled)).select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "scope", F.lit(None).cast("long").alias("listing_id"), "cycle", F.lit(True).alias("done"))
    return seen.union(ends).groupBy("bucket").transformWithStateInPandas(_Missed(least, days), MISSED, "append", "ProcessingTime")
