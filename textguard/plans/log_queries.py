"""Queries over the request log: statistics, rate limits, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.operators import stats as S
from textguard.operators.providers import PROVIDERS
from textguard.operators.ratelimit import offender_sessions, rate_limit
from textguard.plans.fixtures import (
    RATE_EVENTS_SQL, RATE_LIMIT, REQUEST_LOG_SQL, rate_events, request_log, sql_list,
)
from textguard.sources.shared import shared_folder


def _round_one(x: str) -> str:
    """``x`` rounded to one digit by the exact value of the double, as in ``stats.round_one``."""
    m, high = f"round_even({x} * 20, 0)", f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    off = f"(({high} * 20 - {m}) + ({x} - {high}) * 20)"
    return (
        f"CASE WHEN NOT (abs({x} * 20 - {m}) < 1e-9 AND abs({m} % 2) = 1) OR {off} = 0 THEN round_even({x}, 1) "
        f"WHEN {off} < 0 THEN round(({m} - 1) / 20, 1) ELSE round(({m} + 1) / 20, 1) END"
    )


_PERCENT = "(count(*) FILTER (WHERE blocked) / count(*) * 100)"

_STATS = f"""count(*) AS requests, count(*) FILTER (WHERE blocked) AS blocked,
       {_round_one(_PERCENT)} AS block_rate_pct,
       CAST(round_even(sum(latency_ms) / count(*), 0) AS BIGINT) AS avg_latency_ms,
       count(*) FILTER (WHERE status >= 500) AS errors,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS total_tokens"""


def _log(operator):
    return lambda spark, sf_dir: operator(request_log(spark, sf_dir))


def stats_ttl(spark, sf_dir):
    """Counters of the whole log and of clients that stopped early or paused, judged at the last request."""
    log = with_pauses(request_log(spark, sf_dir))
    now = log.agg(F.unix_micros(F.max("ts"))).first()[0]
    d = S.kept_counters(log, F.timestamp_micros(F.lit(now)))
    return d.select("client", "requests", F.unix_micros("last_ts").alias("last_us"))


#: Added clients: by the last digits of the request that is copied, how far their numbers and times lie off (days).
EARLY = ((0, 100_000, 40), (5, 200_000, 40), (15, 200_000, 0))


def with_pauses(log):
    """The log and copies of some requests by other clients: one kind stopped 40 days before, the other paused for some weeks."""
    out = log.select("request_id", "client", "ts")
    for digits, off, days in EARLY:
        some = log.where(F.col("request_id") % 20 == digits)
        out = out.unionByName(some.select("request_id", (F.col("client") + off).alias("client"), (F.col("ts") - F.make_dt_interval(days=F.lit(days))).alias("ts")))
    return out


def _ttl_sql(now: str) -> str:
    """``now``: the moment of judgement, from the latest time t (microseconds)."""
    copies = "".join(
        f" UNION ALL SELECT request_id, client + {off}, epoch_us(ts) - {days * 86_400_000_000} FROM request_log WHERE request_id % 20 = {digits}"
        for digits, off, days in EARLY
    )
    kept = S.RETENTION_DAYS * 86_400_000_000
    return f"""WITH {REQUEST_LOG_SQL},
longer AS (SELECT request_id, client, epoch_us(ts) AS us FROM request_log{copies}),
marked AS (SELECT *, CASE WHEN us - lag(us) OVER w < {kept} THEN 0 ELSE 1 END AS new FROM longer WINDOW w AS (PARTITION BY client ORDER BY us, request_id)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY client ORDER BY us, request_id) AS run FROM marked)
SELECT client, count(*) AS requests, max(us) AS last_us FROM runs GROUP BY client, run
HAVING max(us) > (SELECT {now} FROM (SELECT max(us) AS t FROM longer)) - {kept}"""


def _micros(query, *columns):
    def run(spark, sf_dir):
        d = query(spark, sf_dir)
        for c in columns:
            d = d.withColumn(c, F.unix_micros(c))
        return d

    return run


def _window_sql(slides: int, minutes: int):
    """Each request belongs to ``slides`` windows of one hour that start ``minutes`` apart."""
    step = minutes * 60_000_000
    return f"""WITH {REQUEST_LOG_SQL},
w AS (SELECT *, (epoch_us(ts) // {step} - s) * {step} AS window_start FROM request_log, range({slides}) AS r(s))
SELECT window_start, provider, count(*) AS requests, count(*) FILTER (WHERE blocked) AS blocked,
       {_round_one(_PERCENT)} AS block_rate_pct
FROM w GROUP BY window_start, provider"""


RATE_SQL = f"""WITH {RATE_EVENTS_SQL},
instants AS (SELECT DISTINCT client, ts_ms FROM rate_events),
counts AS (SELECT client, ts_ms, count(*) OVER (PARTITION BY client ORDER BY ts_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS in_window FROM instants)
SELECT event_id, e.client, e.ts_ms, in_window, in_window <= {RATE_LIMIT} AS allowed
FROM rate_events e JOIN counts c ON e.client IS NOT DISTINCT FROM c.client AND e.ts_ms = c.ts_ms"""


def rate_limited(spark, sf_dir):
    return rate_limit(rate_events(spark, sf_dir), RATE_LIMIT)


RANKS, RANK_ERROR = (0.5, 0.95, 0.99), 0.0133


def latency_sketch(spark, sf_dir):
    """Daily latency quantiles from stored hourly sketches, and whether their exact ranks lie within the sketch's error."""
    log = request_log(spark, sf_dir)
    folder = shared_folder(spark)
    S.latency_sketches(log).write.parquet(f"{folder}/hours")
    days = S.latency_by_day(spark.read.parquet(f"{folder}/hours"), RANKS)
    met = log.select("provider", F.window("ts", "1 day")["start"].alias("day"), "latency_ms").join(days, ["provider", "day"])
    below = [F.sum((F.col("latency_ms") < F.col("quantiles")[i]).cast("int")).alias(f"below{i}") for i in range(3)]
    upto = [F.sum((F.col("latency_ms") <= F.col("quantiles")[i]).cast("int")).alias(f"upto{i}") for i in range(3)]
    ranks = met.groupBy("provider", "day").agg(F.first("requests").alias("requests"), F.count("latency_ms").alias("n"), *below, *upto)
    # a quantile covers all ranks from the values below it to those up to it
    room = RANK_ERROR * F.col("n") + 1
    near = [(F.col(f"below{i}") <= r * F.col("n") + room) & (F.col(f"upto{i}") >= r * F.col("n") - room) for i, r in enumerate(RANKS)]
    return ranks.select("provider", F.unix_micros("day").alias("day"), "requests", *[x.alias(c) for x, c in zip(near, ("p50_near", "p95_near", "p99_near"))])


def offenders(spark, sf_dir):
    return offender_sessions(request_log(spark, sf_dir))


OFFENDERS_SQL = f"""WITH {REQUEST_LOG_SQL},
b AS (SELECT client, epoch_us(ts) AS us FROM request_log WHERE blocked),
n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client ORDER BY us) < 1800000000 THEN 0 ELSE 1 END AS new FROM b),
s AS (SELECT client, us, sum(new) OVER (PARTITION BY client ORDER BY us) AS session_no FROM n),
g AS (SELECT client, CAST(session_no AS BIGINT) AS session_no, min(us) AS session_start, max(us) + 1800000000 AS session_end, count(*) AS blocks
      FROM s GROUP BY client, session_no)
SELECT client, session_no, session_start, session_end, blocks,
       CAST(sum(blocks) OVER (PARTITION BY client ORDER BY session_no) AS BIGINT) AS blocks_so_far,
       coalesce(blocks > lag(blocks) OVER (PARTITION BY client ORDER BY session_no), false) AS escalated
FROM g"""


def entries():
    log = f"WITH {REQUEST_LOG_SQL}\n"
    return {
        "stats_by_provider": (
            _log(S.by_provider),
            log + f"SELECT CAST(list_position({sql_list(PROVIDERS)}, provider) AS INTEGER) AS place, provider, {_STATS} FROM request_log GROUP BY provider"),
        "stats_rollup": (
            _log(S.with_total),
            log + f"SELECT CASE WHEN grouping(provider) = 1 THEN 'all' ELSE provider END AS provider, {_STATS} FROM request_log GROUP BY ROLLUP (provider)"),
        "stats_ttl": (stats_ttl, _ttl_sql("t")),
        "top_blocked": (
            lambda spark, sf_dir: S.top_blocked(request_log(spark, sf_dir), 3),
            log + "SELECT provider, client, count(*) AS blocked, CAST(row_number() OVER (PARTITION BY provider ORDER BY count(*) DESC, client) AS INTEGER) AS place "
            "FROM request_log WHERE blocked GROUP BY provider, client QUALIFY place <= 3"),
        "latency_percentiles": (
            _log(S.latency_percentiles),
            log + "SELECT provider, count(*) AS requests, quantile_cont(latency_ms, 0.5) AS p50_ms, quantile_cont(latency_ms, 0.95) AS p95_ms, "
            "quantile_cont(latency_ms, 0.99) AS p99_ms, sum(latency_ms) / count(*) AS mean_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms "
            "FROM request_log GROUP BY provider"),
        "latency_sketch": (
            latency_sketch,
            log + "SELECT provider, epoch_us(date_trunc('day', ts)) AS day, count(*) AS requests, true AS p50_near, true AS p95_near, true AS p99_near FROM request_log GROUP BY ALL"),
        "stats_hourly": (_micros(_log(lambda d: S.windowed(d, "1 hour")), "window_start"), _window_sql(1, 60)),
        "stats_sliding": (_micros(_log(lambda d: S.windowed(d, "1 hour", "15 minutes")), "window_start"), _window_sql(4, 15)),
        "rate_limit": (rate_limited, RATE_SQL),
        "offender_sessions": (_micros(offenders, "session_start", "session_end"), OFFENDERS_SQL),
    }
