"""Rate limits, sessions, statistics and streams."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textguard.operators import stats as S
from textguard.operators.evaluate import findings_diff
from textguard.operators.ratelimit import offender_sessions, rate_limit, rate_limit_strict
from textguard.sources.shared import shared_folder
from textguard.streaming.assemble import BLOCK, assemble
from textguard.streaming.jobs import run_available, stream_response_scan


def loose(events, limit):
    """Denied requests count; one entry per millisecond."""
    seen, out = defaultdict(set), {}
    for client, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        seen[client] = {x for x in seen[client] if x > t - 60_000} | {t}
        out[i] = len(seen[client]) <= limit
    return out


def strict(events, limit):
    """Only allowed requests count."""
    seen, out = defaultdict(list), {}
    for client, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        seen[client] = [x for x in seen[client] if x > t - 60_000]
        out[i] = len(seen[client]) < limit
        if out[i]:
            seen[client].append(t)
    return out


def log_of(kind):
    r = random.Random(kind)
    if kind == "sparse":
        return [(r.randrange(5), r.randrange(2_000_000), i) for i in range(400)]
    if kind == "busy":
        return [(r.randrange(2), r.randrange(400_000), i) for i in range(1500)]
    if kind == "one hot client":
        return [(7 if r.random() < 0.8 else r.randrange(4), r.randrange(900_000), i) for i in range(1200)]
    if kind == "bursts":
        return [(1, 59_990 * r.randrange(9) + r.randrange(20), i) for i in range(500)]
    return [(1, 10_000 * k, i) for i, k in enumerate(range(60))] + [(2, 60_000 * (k // 3), 1000 + k) for k in range(60)]


@pytest.mark.parametrize("limit", [1, 3, 8])
@pytest.mark.parametrize("kind", ["sparse", "busy", "one hot client", "bursts", "regular"])
def test_rate_limits_equal_the_plain_loop(spark, kind, limit):
    events = log_of(kind)
    d = spark.createDataFrame(events, "client int, ts_ms bigint, id int").repartition(5)
    assert {r.id: r.allowed for r in rate_limit(d, limit).collect()} == loose(events, limit)
    assert {r.id: r.allowed for r in rate_limit_strict(d, limit, "id").collect()} == strict(events, limit)


def test_no_rate_limit_task_sees_a_whole_client(spark):
    """The window of the shared variant is bounded by time, whatever the client's traffic."""
    d = spark.createDataFrame([(1, 1, 1)], "client int, ts_ms bigint, id int")
    plan = rate_limit(d, 3)._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window" in line)
    assert "_slot" in window


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 8 * 3600)), min_size=1, max_size=60))
def test_sessions_equal_the_plain_loop(spark, events):
    want = []
    for client in sorted({c for c, _ in events}):
        times = sorted(t for c, t in events if c == client)
        groups = [[times[0]]]
        for t in times[1:]:
            if t - groups[-1][-1] < 1800:
                groups[-1].append(t)
            else:
                groups.append([t])
        total = 0
        for n, g in enumerate(groups):
            total += len(g)
            want.append((client, n + 1, g[0], g[-1] + 1800, len(g), total, n > 0 and len(g) > len(groups[n - 1])))
    d = spark.createDataFrame(events, "client int, t int").select("client", F.timestamp_seconds("t").alias("ts"), F.lit(True).alias("blocked"))
    s = offender_sessions(d).select("client", "session_no", F.unix_seconds("session_start"), F.unix_seconds("session_end"), "blocks", "blocks_so_far", "escalated")
    assert sorted(map(tuple, s.collect())) == want


def request_log(spark, rows):
    """provider, blocked, latency, status, tokens in, tokens out"""
    d = spark.createDataFrame(rows, "provider string, blocked boolean, latency_ms bigint, status int, input_tokens bigint, output_tokens bigint")
    return d.select("*", F.lit(1).alias("client"), F.timestamp_seconds(F.lit(0)).alias("ts"))


def test_statistics_round_and_order_as_expected(spark):
    rows = [("groq", i < 1, 1 if i == 0 else 2, 502 if i == 0 else 200, 2, 3) for i in range(2)]
    rows += [("openai", i < 1, 3, 200, 1, 0) for i in range(8)] + [("unknown", True, 1, 200, 1, 1)]
    got = [tuple(r) for r in S.by_provider(request_log(spark, rows)).collect()]
    # 12.5 stays, 1.5 rounds half to even
    assert got == [(1, "openai", 8, 1, 12.5, 3, 0, 8, 0, 8), (7, "groq", 2, 1, 50.0, 2, 1, 4, 6, 10)]
    total = {r.provider: r for r in S.with_total(request_log(spark, rows)).collect()}["all"]
    assert (total.requests, total.blocked, total.block_rate_pct) == (10, 2, 20.0)


def test_rates_round_as_python_does(spark):
    pairs = [(247, 2000)] + [(k, n) for n in (8, 40, 400, 2000) for k in range(0, n + 1, max(1, n // 400))]
    d = spark.createDataFrame(pairs, "k long, n long")
    got = [r[0] for r in d.select(S._rate(F.col("k"), F.col("n"))).collect()]
    assert got == [round(k / n * 100, 1) for k, n in pairs]
    assert got[0] == 12.3


def test_requests_without_a_client_share_a_limit(spark):
    d = spark.createDataFrame([(1, None, 0), (2, None, 5), (3, "a", 5)], "id int, client string, ts_ms long")
    assert {r.id: (r.in_window, r.allowed) for r in rate_limit(d, 1).collect()} == {1: (1, True), 2: (2, False), 3: (1, True)}
    assert all(r.allowed for r in rate_limit(d, 1, enabled=False).collect())
    assert {r.id: r.allowed for r in rate_limit_strict(d, 1, "id").collect()} == {1: True, 2: False, 3: True}


def test_empty_log_has_a_zero_total(spark):
    assert S.with_total(request_log(spark, [])).count() in (0, 1)
    assert S.by_provider(request_log(spark, [])).count() == 0


def test_counters_end_a_week_after_the_last_request(spark):
    day = 86400
    d = spark.createDataFrame([(1, 0), (1, 6 * day), (2, 0)], "client int, t int").select("client", F.timestamp_seconds("t").alias("ts"))
    now = F.timestamp_seconds(F.lit(7 * day))
    assert [tuple(r)[:2] for r in S.kept_counters(d, now).collect()] == [(1, 2)]


def test_percentiles_exact_and_approximate_agree(spark):
    rows = [("openai", False, i, 200, 0, 0) for i in range(1, 1002)]
    exact = S.latency_percentiles(request_log(spark, rows)).first()
    approx = S.latency_percentiles(request_log(spark, rows), exact=False).first()
    assert (exact.p50_ms, exact.min_ms, exact.max_ms, exact.mean_ms) == (501.0, 1, 1001, 501.0)
    assert abs(approx.p95_ms - exact.p95_ms) <= 1


def test_findings_diff_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(map(tuple, findings_diff(a, b, ["x"]).collect())) == [("added", 3, 1), ("removed", 1, 2), ("removed", 2, 1)]


def chunk(text):
    return '{"type":"content_block_delta","delta":{"text":"%s"}}' % text


def test_assembly_over_block_borders(spark):
    n = 2 * BLOCK + 5
    rows = [(1, "anthropic", i, chunk(f"{i} ")) for i in range(n)]
    rows += [(2, "anthropic", i, chunk("x")) for i in range(BLOCK)] + [(2, "anthropic", BLOCK, "[DONE]"), (2, "anthropic", BLOCK + 1, chunk("late")), (2, "anthropic", 3 * BLOCK, chunk("later"))]
    rows += [(3, "anthropic", 0, '{"type":"message_start","message":{"usage":{"input_tokens":9}}}'), (3, "anthropic", 1, '{"type":"message_delta","usage":{"output_tokens":4}}'), (3, "anthropic", 2, '{"type":"message_delta","usage":{"output_tokens":6}}')]
    d = spark.createDataFrame(rows, "request_id int, provider string, seq bigint, data string").withColumn("ts", F.timestamp_seconds("seq"))
    got = {r.request_id: r for r in assemble(d.repartition(4)).collect()}
    assert got[1].text == "".join(f"{i} " for i in range(n))
    assert got[2].text == "x" * BLOCK
    assert (got[3].text, got[3].input_tokens, got[3].output_tokens) == ("", 9, 6)


def test_stream_in_several_files_equals_batch_and_drops_late_rows(spark):
    folder = shared_folder(spark)
    rows = [(i, "anthropic", s, chunk(f"mail{i}@b.example " if s == 2 else "w "), 1000 * i + s) for i in range(20) for s in range(5)]
    d = spark.createDataFrame(rows, "request_id bigint, provider string, seq bigint, data string, t bigint")
    d = d.select("request_id", "provider", "seq", F.timestamp_seconds("t").alias("ts"), "data")
    for part in range(4):
        d.where(F.col("request_id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{folder}/chunks")
    ahead = d.limit(1).select(F.lit(-1).cast("bigint").alias("request_id"), "provider", "seq", F.timestamp_seconds(F.lit(10**9)).alias("ts"), F.lit("[DONE]").alias("data"))
    stream = spark.readStream.schema(d.schema).parquet(f"{folder}/chunks")

    def run():
        run_available(stream_response_scan(stream), f"{folder}/found", f"{folder}/checkpoint")
        return sorted(r.request_id for r in spark.read.schema("request_id bigint").parquet(f"{folder}/found").collect())

    assert len(run()) < 20  # the last responses are still open
    ahead.write.mode("append").parquet(f"{folder}/chunks")
    assert run() == list(range(20))
    # a chunk far behind the watermark no longer opens a response
    d.limit(1).withColumn("request_id", F.lit(99).cast("bigint")).write.mode("append").parquet(f"{folder}/chunks")
    assert run() == list(range(20))
