"""Aggregates over a request log: request_id, ts, client, provider, blocked,
latency_ms, input_tokens, output_tokens, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textguard.operators.providers import PROVIDERS

RETENTION_DAYS = 7


def round_one(x: Column) -> Column:
    """``x`` rounded to one digit as Python rounds it: by the exact value of the double, ties to even.

    Only where the shortest decimal form of ``x`` ends in a 5 at the second digit does its exact value matter: it may lie a
    little above or below. Then 20 * x is compared with the odd integer next to it, in two exact parts.
    """
    m = F.rint(x * 20)
    high = x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
    off = (high * 20 - m) + (x - high) * 20
    half = (F.abs(x * 20 - m) < 1e-9) & (F.abs(m % 2) == 1)
    return F.when(~half | (off == 0), F.bround(x, 1)).when(off < 0, F.round((m - 1) / 20, 1)).otherwise(F.round((m + 1) / 20, 1))


def _rate(blocked: Column, requests: Column) -> Column:
    return F.when(requests > 0, round_one(blocked / requests * 100)).otherwise(F.lit(0.0))


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("requests"),
        F.count_if("blocked").alias("blocked"),
        F.sum("latency_ms").alias("_latency"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    ]


def _rates(d: DataFrame, keys: list[str]) -> DataFrame:
    return d.select(
        *keys,
        "requests",
        "blocked",
        _rate(F.col("blocked"), F.col("requests")).alias("block_rate_pct"),
        F.bround(F.col("_latency") / F.col("requests"), 0).cast("long").alias("avg_latency_ms"),
        "errors",
        "input_tokens",
        "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
    )


def by_provider(log: DataFrame) -> DataFrame:
    """One row per known provider with requests; ``place`` is the reporting order."""
    place = F.array_position(F.array(*[F.lit(p) for p in PROVIDERS]), F.col("provider"))
    d = _rates(log.groupBy("provider").agg(*_sums()), ["provider"])
    return d.select(place.cast("int").alias("place"), "*").where(F.col("place") > 0).orderBy("place")


def with_total(log: DataFrame) -> DataFrame:
    """Per provider plus the overall row (provider 'all'), in one pass."""
    d = log.where(F.col("provider").isin(*PROVIDERS)).rollup("provider").agg(F.grouping("provider").alias("_g"), *_sums())
    return _rates(d.withColumn("provider", F.when(F.col("_g") == 1, "all").otherwise(F.col("provider"))), ["provider"])


def kept_counters(log: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Request counters that are still alive: a counter ends ``days`` after its last request, and a later request starts it again from one."""
    return (
        # Spark joins requests that lie exactly a gap apart, too
        log.groupBy("client", F.session_window("ts", f"{days * 86_400 - 1} seconds 999999 microseconds"))
        .agg(F.count(F.lit(1)).alias("requests"), F.max("ts").alias("last_ts"))
        .where(F.col("last_ts") > now - F.make_dt_interval(days=F.lit(days)))
        .select("client", "requests", "last_ts")
    )


def findings_by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n_findings"))


def severity_cube(findings: DataFrame) -> DataFrame:
    """Findings by detector and severity with all subtotals ('all')."""
    c = findings.cube("detector", "severity").agg(
        F.grouping("detector").alias("_d"), F.grouping("severity").alias("_s"), F.count(F.lit(1)).alias("n_findings")
    )
    return c.select(
        F.when(F.col("_d") == 1, "all").otherwise(F.col("detector")).alias("detector"),
        F.when(F.col("_s") == 1, "all").otherwise(F.col("severity")).alias("severity"),
        "n_findings",
    )


def top_blocked(log: DataFrame, k: int) -> DataFrame:
    """The k clients with most blocked requests of each provider.

    Counts are summed first; Spark then keeps the best k of every partition before the
    shuffle (WindowGroupLimit), so a provider with many clients does not meet in one task.
    """
    counts = log.where("blocked").groupBy("provider", "client").agg(F.count(F.lit(1)).alias("blocked"))
    w = Window.partitionBy("provider").orderBy(F.desc("blocked"), "client")
    return counts.select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= k)


def latency_percentiles(log: DataFrame, exact: bool = True) -> DataFrame:
    """Latency distribution per provider.  The exact form keeps one counter per distinct
    value; ``exact=False`` uses a sketch of fixed size."""
    p = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    if exact:
        # values first, then weighted percentiles: memory follows distinct values, not rows
        d = log.groupBy("provider", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
        q, n, total = F.percentile("latency_ms", p, F.col("n")), F.sum("n"), F.sum(F.col("latency_ms") * F.col("n"))
    else:
        d = log
        q, n, total = F.percentile_approx("latency_ms", p, 10000), F.count(F.lit(1)), F.sum("latency_ms")
    return d.groupBy("provider").agg(
        q.alias("_q"), n.alias("requests"), total.alias("_t"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms")
    ).select(
        "provider", "requests",
        *[F.col("_q")[i].cast("double").alias(c) for i, c in enumerate(("p50_ms", "p95_ms", "p99_ms"))],
        (F.col("_t") / F.col("requests")).alias("mean_ms"), "min_ms", "max_ms",
    )


#: Size of quantile sketches; ranks are then off by some 0.7 %, and hardly ever by twice as much.
SKETCH = 400


def latency_sketches(log: DataFrame) -> DataFrame:
    """A quantile sketch (KLL, of bounded size) of the latencies of every provider and hour, to be stored and merged later: provider, hour, requests, sketch."""
    return log.groupBy("provider", F.window("ts", "1 hour").alias("w")).agg(
        F.count("latency_ms").alias("requests"), F.kll_sketch_agg_bigint("latency_ms", F.lit(SKETCH)).alias("sketch")
    ).select("provider", F.col("w.start").alias("hour"), "requests", "sketch")


def latency_by_day(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Latency quantiles of every provider and day out of its hourly sketches: provider, day (its start in UTC), requests, quantiles (by rank)."""
    d = sketches.where("requests > 0").groupBy("provider", F.window("hour", "1 day").alias("w"))
    d = d.agg(F.sum("requests").alias("requests"), F.kll_merge_agg_bigint("sketch").alias("s"))
    quantiles = F.array(*[F.kll_sketch_get_quantile_bigint("s", F.lit(r)) for r in ranks])
    return d.select("provider", F.col("w.start").alias("day"), "requests", quantiles.alias("quantiles"))


def windowed(log: DataFrame, length: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Block rate per provider and time window; also for streams, with a watermark."""
    d = log.withWatermark("ts", watermark) if watermark else log
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = d.groupBy(w.alias("w"), "provider").agg(F.count(F.lit(1)).alias("requests"), F.count_if("blocked").alias("blocked"))
    return g.select(
        F.col("w.start").alias("window_start"), "provider", "requests", "blocked",
        _rate(F.col("blocked"), F.col("requests")).alias("block_rate_pct"),
    )
