"""Sliding-window rate limits and repeat-offender sessions over request logs.

Busy clients are cut into short stretches of time, so no task ever has to hold
all rows of one client.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW_MS = 60_000
# Fixed value: requests per minute unless configured.
DEFAULT_LIMIT = 60


def rate_limit(
    requests: DataFrame, limit: int = DEFAULT_LIMIT, client: str = "client", ts_ms: str = "ts_ms", window_ms: int = WINDOW_MS,
    enabled: bool = True,
) -> DataFrame:
    """Adds ``in_window`` and ``allowed``; denied requests count too. With ``enabled=False`` all are allowed.
    Requests without a client share one limit.

    Requests of a client within one millisecond count once.  Each millisecond is
    placed in its own window-long slot and in the next one, so a slot holds all that
    its windows can reach: at most two windows of milliseconds, however busy the client.
    """
    instants = requests.select(client, ts_ms).distinct()
    slot = F.floor(F.col(ts_ms) / window_ms)
    placed = instants.select("*", F.explode(F.array(slot, slot + 1)).alias("_slot"))
    w = Window.partitionBy(client, "_slot").orderBy(ts_ms).rangeBetween(-(window_ms - 1), 0)
    counts = (
        placed.select("*", F.count(F.lit(1)).over(w).alias("in_window"))
        .where(F.col("_slot") == slot)
        .select(client, ts_ms, "in_window")
    )
    counts = counts.select(F.col(client).alias("_client"), F.col(ts_ms).alias("_ts"), "in_window")
    met = requests.join(counts, F.col(client).eqNullSafe(F.col("_client")) & F.col(ts_ms).eqNullSafe(F.col("_ts")))
    return met.select(*requests.columns, "in_window", (F.lit(not enabled) | (F.col("in_window") <= limit)).alias("allowed"))


def _replay(limit: int, window_ms: int, client: str):
    """Allowed counts per (client, stretch, millisecond), in order.  Only the last
    ``limit`` allowed times are kept, and runs of denied requests are skipped."""

    def decide(t: np.ndarray, n: np.ndarray, recent: list[int]) -> np.ndarray:
        allowed = np.zeros(len(t), dtype=np.int64)
        i = 0
        while i < len(t):
            while recent and recent[0] <= t[i] - window_ms:
                recent.pop(0)
            if len(recent) >= limit:
                i = max(i + 1, int(np.searchsorted(t, recent[0] + window_ms))) if recent else len(t)
                continue
            allowed[i] = take = min(int(n[i]), limit - len(recent))
            recent.extend([int(t[i])] * take)
            i += 1
        return allowed

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, []
        for pdf in batches:
            # rows arrive sorted, so equal keys are adjacent
            change = (pdf[[client, "_stretch"]] != pdf[[client, "_stretch"]].shift()).any(axis=1)
            starts = np.flatnonzero(change.to_numpy())
            parts = []
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                key = (pdf[client].iat[a], pdf["_stretch"].iat[a])
                if key != current:
                    current, recent = key, []
                parts.append(decide(pdf["_t"].to_numpy()[a:b], pdf["_n"].to_numpy()[a:b], recent))
            if parts:
                yield pdf[[client, "_t"]].assign(_allowed=np.concatenate(parts))

    return replay


def rate_limit_strict(
    requests: DataFrame, limit: int, order: str, client: str = "client", ts_ms: str = "ts_ms", window_ms: int = WINDOW_MS
) -> DataFrame:
    """Adds ``allowed`` where only allowed requests count against the limit. A tool for small logs: see below.

    Each answer depends on the ones before it, so the log is first cut where the past
    cannot matter: at pauses of a window or longer, and before any stretch of a window
    in which even all requests together stay within the limit.  Requests of one
    millisecond are one row with a count, so a stretch grows with time, not with
    traffic, and it is read as a sorted stream, never held whole.
    """
    per_ms = requests.groupBy(client, F.col(ts_ms).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    slot = F.floor(F.col("_t") / window_ms)
    placed = per_ms.select("*", F.explode(F.array(slot, slot + 1)).alias("_slot"))
    reach = Window.partitionBy(client, "_slot").orderBy("_t").rangeBetween(-(window_ms - 1), 0)
    # load: all requests in the window that ends here; sure: allowed whatever came before
    loads = (
        placed.select("*", F.sum("_n").over(reach).alias("_load"))
        .where(F.col("_slot") == slot)
        .select(client, "_t", "_n", (F.col("_load") <= limit).alias("_sure"))
    )
    # a slot without any unsure millisecond forgets everything older than itself
    slots = loads.groupBy(client, slot.alias("_slot")).agg(F.bool_and("_sure").alias("_calm"))
    by_slot = Window.partitionBy(client).orderBy("_slot")
    # a stretch begins at a busy slot whose neighbour on the left is calm or absent
    begins = ~F.col("_calm") & F.coalesce(
        F.lag("_calm").over(by_slot) | (F.lag("_slot").over(by_slot) < F.col("_slot") - 1), F.lit(True)
    )
    busy = (
        slots.select("*", F.sum(begins.cast("long")).over(by_slot).alias("_stretch"))
        .where(~F.col("_calm"))
        .select(client, "_slot", "_stretch")
    )
    # the calm slot before a stretch is replayed with it, since its requests still count
    lead_in = busy.groupBy(client, "_stretch").agg((F.min("_slot") - 1).alias("_slot")).select(client, "_slot", "_stretch")
    rows = loads.select("*", slot.alias("_slot")).join(busy.unionByName(lead_in).withColumnsRenamed({client: "_c", "_slot": "_s"}), F.col(client).eqNullSafe(F.col("_c")) & (F.col("_slot") == F.col("_s")))
    types = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    replayed = (
        rows.select(client, "_stretch", "_t", "_n")
        .repartition(client, "_stretch")
        .sortWithinPartitions(client, "_stretch", "_t")
        .mapInPandas(_replay(limit, window_ms, client), f"{client} {types[client]}, _t bigint, _allowed bigint")
    )
    replayed = replayed.withColumnsRenamed({client: "_c", "_t": "_u"})
    decided = loads.join(replayed, F.col(client).eqNullSafe(F.col("_c")) & (F.col("_t") == F.col("_u")), "left").select(
        client, F.col("_t").alias(ts_ms), F.coalesce("_allowed", "_n").alias("_allowed"), "_n"
    )
    # within one millisecond the first requests by ``order`` get through
    place = F.row_number().over(Window.partitionBy(client, ts_ms).orderBy(order))
    allowed = F.when(F.col("_allowed") >= F.col("_n"), True).otherwise(F.col("_place") <= F.col("_allowed"))
    return (
        requests.join(
            decided.withColumnsRenamed({client: "_client", ts_ms: "_ts"}),
            F.col(client).eqNullSafe(F.col("_client")) & F.col(ts_ms).eqNullSafe(F.col("_ts")),
        )
        .select("*", place.alias("_place"))
        .select(*requests.columns, allowed.alias("allowed"))
    )


def offender_sessions(log: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions of blocked requests per client, and whether each one is worse than the last.

    Requests within one slot as long as the gap always share a session, so each slot is
    summed up first; what is ordered per client is one row per slot, not per request.
    """
    gap = F.make_dt_interval(mins=F.lit(gap_minutes))
    slots = (
        log.where("blocked")
        .groupBy("client", F.window("ts", f"{gap_minutes} minutes").alias("w"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    by_time = Window.partitionBy("client").orderBy("first")
    begins = F.coalesce(F.col("first") - F.lag("last").over(by_time) >= gap, F.lit(True))
    sessions = (
        slots.select("*", begins.alias("_new"))
        .select("*", F.count_if("_new").over(by_time).alias("session_no"))
        .groupBy("client", "session_no")
        .agg(
            F.min("first").alias("session_start"),
            (F.max("last") + gap).alias("session_end"),
            F.sum("n").alias("blocks"),
        )
    )
    w = Window.partitionBy("client").orderBy("session_no")
    return sessions.select(
        "*",
        F.sum("blocks").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("blocks_so_far"),
        F.coalesce(F.col("blocks") > F.lag("blocks").over(w), F.lit(False)).alias("escalated"),
    )
