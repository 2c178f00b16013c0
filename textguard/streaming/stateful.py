"""Operators on streams that keep a state of their own: rate limits, counters that end, repeat offenders.

State lies in Spark's RocksDB store (``state_store`` sets it), timers follow the watermark, and every operator gives the rows of its
batch form, whatever the order within a micro-batch and wherever a query is stopped and started again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textguard.operators.ratelimit import DEFAULT_LIMIT, WINDOW_MS
from textguard.operators.stats import RETENTION_DAYS

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB: it need not fit into the memory of executors, and checkpoints are incremental."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def _seen(window_ms: int):
    """For every request of the slots (start of the one before, times, times in the one before): the milliseconds with requests in the window that ends at it."""

    def count(start: pa.Array, here: pa.Array, before: pa.Array) -> pa.Array:
        ends, starts = here.value_lengths().to_numpy(zero_copy_only=False), start.to_numpy(zero_copy_only=False)
        own = np.repeat(np.arange(len(starts)), ends)
        other = np.repeat(np.arange(len(starts)), before.value_lengths().to_numpy(zero_copy_only=False))

        def place(slot: np.ndarray, times: pa.Array) -> np.ndarray:
            # the slots lie in one line, with room for a window between them
            return slot * (4 * window_ms) + 2 * window_ms + times.flatten().to_numpy(zero_copy_only=False) - starts[slot]

        at = place(own, here)
        instants = np.unique(np.concatenate([at, place(other, before)]))
        seen = np.searchsorted(instants, at, side="right") - np.searchsorted(instants, at - (window_ms - 1))
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32), pa.array(seen.astype(np.int64)))

    return F.arrow_udf(count, "array<long>")


def stream_rate_limit(
    requests: DataFrame, limit: int = DEFAULT_LIMIT, client: str = "client", ts_ms: str = "ts_ms", window_ms: int = WINDOW_MS, late: str = "10 minutes"
) -> DataFrame:
    """``requests`` (a stream) with ``in_window`` and ``allowed``, as ``operators.ratelimit.rate_limit`` gives them.

    A request counts in its own slot of time and in the next one, so a state holds two windows of one client at most and a busy client
    is dealt out over its slots. A request leaves when the watermark (``late`` behind the latest one) has passed its
    slot; later ones are dropped. Requests without a time are dropped, those without a client share one limit.
    """
    columns = requests.columns
    d = requests.where(F.col(ts_ms).isNotNull()).withColumn("_time", F.timestamp_millis(ts_ms)).withWatermark("_time", late)
    # a slot and the one before it are a window of twice the length
    d = d.select("*", F.window("_time", f"{2 * window_ms} milliseconds", f"{window_ms} milliseconds").alias("_both"), F.col(client).alias("_client"))
    d = d.select("*", F.col(ts_ms).cast("long").alias("_ts"), (F.col(ts_ms) >= F.unix_millis("_both.start") + window_ms).alias("_own"))
    slots = d.groupBy("_both", "_client").agg(
        F.collect_list(F.when(F.col("_own"), F.struct(F.struct(*columns).alias("r"), "_ts"))).alias("_here"),
        F.collect_set(F.when(~F.col("_own"), F.col("_ts"))).alias("_before"),
    )
    slots = slots.where(F.size("_here") > 0).select("_here", F.unix_millis("_both.start").alias("_start"), "_before")
    seen = slots.select(F.col("_here.r").alias("r"), _seen(window_ms)("_start", F.col("_here._ts"), "_before").alias("n"))
    out = seen.select(F.explode(F.arrays_zip("r", "n")).alias("x")).select("x.r.*", F.col("x.n").alias("in_window"))
    return out.select("*", (F.col("in_window") <= limit).alias("allowed"))


def _move_timer(handle, before: int | None, now: int) -> None:
    """A key has one timer; ``before`` follows from its state, so it need not be looked up (each call is a round trip to the JVM)."""
    if before == now:
        return
    if before is not None:
        handle.deleteTimer(before)
    handle.registerTimer(now)


def _summed(minutes: DataFrame) -> DataFrame:
    """Requests of a window and client: client, n, first_us, last_us. The window stays behind: Python would turn its two times of every row into datetimes."""
    out = minutes.agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))
    return out.select("client", "n", "first_us", "last_us")


_CHANGE = Row("client", "requests", "last_us", "at_us")


class _Counter(StatefulProcessor):
    """A counter that ends ``days`` after its last request; each request renews it."""

    def __init__(self, days: int) -> None:
        self.kept = days * 86_400_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "requests long, last_us long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.counter.get()
        n, last = before or (0, None)
        for first, end, some in sorted((r["first_us"], r["last_us"], r["n"]) for r in rows):
            n = some if last is None or first - last >= self.kept else n + some
            last = end if last is None else max(last, end)
        _move_timer(self.handle, before and (before[1] + self.kept) // 1000, (last + self.kept) // 1000)
        self.counter.update((n, last))
        yield _CHANGE(key[0], n, last, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.counter.get()[1]
        self.counter.clear()
        yield _CHANGE(key[0], 0, last, last + self.kept)

    def close(self) -> None:
        pass


def stream_counters(log: DataFrame, days: int = RETENTION_DAYS, late: str = "10 minutes") -> DataFrame:
    """Changes of the request counters of a stream (client, ts): client, requests (0: ended), last_us, at_us. The last change of a client holds.

    Requests are summed by client and minute before they meet the client's state, so a busy client sends one row a minute.
    """
    d = _summed(log.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "client"))
    kind = log.schema["client"].dataType.simpleString()
    return d.groupBy("client").transformWithState(_Counter(days), f"client {kind}, requests long, last_us long, at_us long", "append", "eventTime")


def alive(changes: DataFrame) -> DataFrame:
    """The counters that live after all changes."""
    last = changes.groupBy("client").agg(F.max(F.struct("at_us", "requests", "last_us")).alias("x"))
    return last.where("x.requests > 0").select("client", "x.requests", "x.last_us")


_SESSION = Row("client", "session_no", "session_start", "session_end", "blocks", "blocks_so_far", "escalated")


class _Offender(StatefulProcessor):
    """Joins a client's slots into sessions and compares each with the one before; a session leaves when no slot can reach it any more."""

    def __init__(self, gap_us: int) -> None:
        self.gap = gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, blocks long")
        self.past = handle.getValueState("past", "session_no long, blocks_so_far long, blocks long")

    def _ends(self, last: int) -> int:
        # a slot may hold requests of up to a gap before it ends
        return -(-(last + 2 * self.gap) // 1000)

    def _close(self, key, first: int, last: int, blocks: int) -> Row:
        no, total, before = self.past.get() or (0, 0, None)
        self.past.update((no + 1, total + blocks, blocks))
        return _SESSION(key[0], no + 1, first, last + self.gap, blocks, total + blocks, before is not None and blocks > before)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = now = self.open.get()
        out = []
        for first, last, n in sorted((r["first_us"], r["last_us"], r["n"]) for r in rows):
            if now and first - now[1] < self.gap:
                now = (now[0], last, now[2] + n)
            else:
                if now:
                    out.append(self._close(key, *now))
                now = (first, last, n)
        _move_timer(self.handle, before and self._ends(before[1]), self._ends(now[1]))
        self.open.update(now)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = tuple(self.open.get())
        self.open.clear()
        yield self._close(key, *now)

    def close(self) -> None:
        pass


def stream_offenders(log: DataFrame, gap_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Sessions of blocked requests of a stream (times in microseconds), as ``operators.ratelimit.offender_sessions`` gives them.

    Requests are summed by client and slot before they meet the client's state, as in the batch form.
    """
    d = _summed(log.where("blocked").withWatermark("ts", late).groupBy(F.window("ts", f"{gap_minutes} minutes").alias("w"), "client"))
    kind = log.schema["client"].dataType.simpleString()
    out = f"client {kind}, session_no long, session_start long, session_end long, blocks long, blocks_so_far long, escalated boolean"
    return d.groupBy("client").transformWithState(_Offender(gap_minutes * 60_000_000), out, "append", "eventTime")
