"""Streams that are stopped, started again and fed late rows, next to their batch forms."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from textguard.operators.ratelimit import offender_sessions, rate_limit
from textguard.operators.stats import kept_counters, windowed
from textguard.plans.stream_queries import audit_of_stream, findings_of_stream, in_batches
from textguard.streaming.jobs import audit_batches, count_arrivals, run_audit, stream_audit
from textguard.streaming.stateful import _Counter, _Offender, alive, stream_counters, stream_offenders, stream_rate_limit


@pytest.fixture(autouse=True)
def few_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def at(spark, rows, schema="client long, ms long"):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ms"))


def test_rate_limit_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = [(c, (i * i * 37 + (c or 5) * 11) % 400_000, i) for c in (1, 2, None) for i in range(150)] + [(3, 59_999, 0), (3, 60_000, 1), (3, 119_999, 2), (3, 119_999, 3), (3, 120_000, 4)]
    df = spark.createDataFrame(rows, "client long, ts_ms long, n long").coalesce(2)
    # cut inside a window, and once where nothing new arrives
    parts = [df.where("ts_ms < 130000"), df.where("ts_ms >= 130000 AND ts_ms < 131000"), df.where("ts_ms >= 131000"), df.limit(0), spark.sql("SELECT 9L client, 900000000L ts_ms, -1L n")]
    got = in_batches(spark, parts, lambda s: stream_rate_limit(s, 4, late="1 second"), str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, rate_limit(df, 4).collect()), key=repr)


def test_rate_limit_keeps_late_requests_of_open_slots(spark, tmp_path):
    schema = "client long, ts_ms long, n long"
    one = spark.createDataFrame([(1, 30_000, 0), (1, 100_000, 1), (None, 100_000, 2)], schema).coalesce(1)
    # behind the watermark, in a slot that it has not passed; a millisecond twice
    two = spark.createDataFrame([(1, 70_000, 3), (1, 70_000, 4), (None, 119_999, 5)], schema).coalesce(1)
    end = spark.sql("SELECT 9L client, 900000000L ts_ms, -1L n")
    got = in_batches(spark, [one, two, end], lambda s: stream_rate_limit(s, 2, late="1 second"), str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, rate_limit(one.unionByName(two), 2).collect()), key=repr)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert "TransformWithState" not in stream_rate_limit(stream, 2)._jdf.queryExecution().analyzed().toString()


def test_counters_end_and_begin_again(spark, tmp_path):
    day = 86_400_000
    rows = [(1, 0), (1, day), (2, 0), (2, 8 * day), (3, 2 * day), (3, 9 * day), (4, 3 * day), (4, 4 * day), (5, 9 * day + 5)]
    df = at(spark, rows)
    now = 10 * day
    parts = [df.where(f"ms < {5 * day}"), df.where(f"ms >= {5 * day}"), at(spark, [(None, now)])]
    got = alive(in_batches(spark, parts, lambda s: stream_counters(s.select("client", "ts"), late="0 seconds"), str(tmp_path))).collect()
    want = kept_counters(df, F.timestamp_millis(F.lit(now))).select("client", "requests", F.unix_micros("last_ts")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [(2, 1, 8 * day * 1000), (3, 1, 9 * day * 1000), (4, 2, 4 * day * 1000), (5, 1, (9 * day + 5) * 1000)]


class _Handle:
    """Stands for a key's state: counts calls, and knows its timers without listing them."""

    def __init__(self):
        self.timers, self.values = set(), {}

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def get(self):
                return handle.values.get(name)

            def update(self, value):
                handle.values[name] = value

        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.mark.parametrize(("make", "ends"), [(lambda: _Counter(7), lambda last: (last + 7 * 86_400_000_000) // 1000), (lambda: _Offender(60_000_000), lambda last: -(-(last + 120_000_000) // 1000))])
def test_a_key_has_one_timer_and_does_not_look_it_up(make, ends):
    state, handle = make(), _Handle()
    state.init(handle)
    for times in ([5, 70_000_001], [70_000_001], [3], [90_000_000_000]):
        rows = [{"first_us": t, "last_us": t, "n": 1} for t in times]
        list(state.handleInputRows((1,), iter(rows), None))
        last = (handle.values.get("counter") or handle.values["open"])[1]
        assert handle.timers == {ends(last)}


def test_no_window_goes_to_python(spark, tmp_path):
    at(spark, [(1, 0)]).withColumn("blocked", F.lit(True)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client long, ts timestamp, blocked boolean").parquet(str(tmp_path / "in"))
    for out in (stream_counters(stream), stream_offenders(stream)):
        plan = out._jdf.queryExecution().analyzed()
        assert "TransformWithState" in plan.nodeName()
        assert "timestamp" not in plan.children().apply(0).schema().simpleString()


def test_offenders_across_batches(spark, tmp_path):
    minute = 60_000
    rows = [(1, m * minute, True) for m in (0, 29, 58, 100, 130, 131, 132, 161, 300)] + [(2, 5 * minute, True), (None, 7 * minute, True), (1, 90 * minute, False)]
    df = at(spark, rows, "client long, ms long, blocked boolean")
    parts = [df.where(f"ms < {59 * minute}"), df.where(f"ms >= {59 * minute}"), at(spark, [(9, 90_000 * minute, True)], "client long, ms long, blocked boolean")]
    got = in_batches(spark, parts, lambda s: stream_offenders(s.drop("ms"), late="0 seconds"), str(tmp_path)).collect()
    want = offender_sessions(df).withColumn("session_start", F.unix_micros("session_start")).withColumn("session_end", F.unix_micros("session_end"))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want.select(*got[0].asDict()).collect()), key=repr)


def test_late_rows_are_counted(spark, tmp_path):
    hour = 3_600_000
    one = at(spark, [("a", 10 * hour), ("a", 11 * hour), ("b", 12 * hour)], "provider string, ms long").withColumn("blocked", F.lit(False))
    two = at(spark, [("a", 10 * hour + 5), ("b", 3 * hour), ("b", 12 * hour + 1), ("c", 20 * hour)], "provider string, ms long").withColumn("blocked", F.lit(True))
    ahead = at(spark, [("z", 1000 * hour)], "provider string, ms long").withColumn("blocked", F.lit(False))
    out = in_batches(spark, [one, two, ahead], lambda s: windowed(count_arrivals(s), "1 hour", watermark="10 minutes"), str(tmp_path), str(tmp_path / "arrivals"))
    arrivals = spark.read.parquet(str(tmp_path / "arrivals")).collect()
    assert sum(r["arrived"] for r in arrivals) == 8 and sum(r["dropped"] for r in arrivals) == 2
    assert out.agg(F.sum("requests")).first()[0] == 5


def test_audit_entries_are_written_once(spark, tmp_path):
    """The query ends between the write and the commit of a batch; the batch then runs again."""
    rows = [(i, "openai", 3, "mail ann@example.org" if i % 2 else "nothing") for i in range(20)]
    schema = "request_id long, provider string, latency_ms long, text string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))

    def stream():
        return stream_audit(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "text")

    def fails(path):
        write = audit_batches(path)

        def sink(entries, batch):
            write(entries, batch)
            raise RuntimeError("ended before the commit")

        return sink

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    with pytest.raises(StreamingQueryException):
        run_audit(stream(), out, checkpoint, sink=fails)
    assert spark.read.json(out).count() == 20
    run_audit(stream(), out, checkpoint)
    run_audit(stream(), out, checkpoint)
    got = spark.read.schema(stream().schema).json(out).collect()
    assert sorted(r["request_id"] for r in got) == list(range(20))
    assert sum(r["finding_count"] for r in got) == 10


@pytest.mark.parametrize("query", [audit_of_stream, findings_of_stream])
def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path, query):
    rows = [(1, 0, "user", "mail ann@example.org"), (1, 1, "assistant", "nothing"), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.repartition(2).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file" / "conversations.parquet")
    of_folder, of_file = (sorted(map(tuple, query(spark, str(tmp_path / t)).collect()), key=repr) for t in ("folder", "file"))
    assert of_folder == of_file and len(of_file) == (3 if query is audit_of_stream else 1)
