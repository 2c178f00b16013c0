"""Queries over response streams and streams of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.operators.providers import PROVIDERS
from textguard.operators.scan import scan_rows
from textguard.operators.stats import windowed
from textguard.plans.decision_queries import BLOCKING, messages, messages_sql
from textguard.plans.finding_sql import COLUMNS, findings_sql
from textguard.plans.fixtures import PROVIDER_LIST, RATE_LIMIT, REQUEST_LOG_SQL, pack, rate_events, request_log, sql_list, texts_sql
from textguard.plans.log_queries import OFFENDERS_SQL, RATE_SQL, _ttl_sql, _window_sql, with_pauses
from textguard.plans.payload_queries import quoted
from textguard.rules import SEVERITIES, rule_pack
from textguard.sources.shared import shared_folder
from textguard.streaming.assemble import DONE, assemble
from textguard.streaming.jobs import count_arrivals, run_audit, run_available, stream_audit, stream_findings, stream_response_scan
from textguard.streaming.stateful import alive, state_store, stream_counters, stream_offenders, stream_rate_limit

FINDING_LIST = [c.strip() for c in COLUMNS.split(",")]
START = "2024-01-01 00:00:00 UTC"


def chunks(spark, sf_dir):
    """Every message as a stream of one chunk per word, with an end marker and one
    chunk after it that must be ignored."""
    m = messages(spark, sf_dir).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.get(F.array(*[F.lit(p) for p in PROVIDERS]), ((F.col("conv_id") + F.col("turn")) % 10).cast("int")).alias("provider"),
        F.split("text", " ").alias("words"),
    )
    n = F.size("words")
    deltas = F.transform("words", lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)))
    d = m.select("request_id", "provider", n.alias("n"), F.posexplode(F.concat(deltas, F.array(F.lit(""), F.lit("late")))).alias("seq", "delta"))
    text, count = quoted(F.col("delta")), F.col("n").cast("string")
    last = F.col("seq") == F.col("n") - 1
    delta_form = F.concat(
        F.lit('{"choices":[{"delta":{"content":'), text, F.lit("}}]"),
        F.when(last, F.concat(F.lit(',"usage":{"prompt_tokens":11,"completion_tokens":'), count, F.lit("}"))).otherwise(""), F.lit("}"),
    )
    anthropic = F.concat(F.lit('{"type":"content_block_delta","delta":{"text":'), text, F.lit("}}"))
    data = (
        F.when(F.col("seq") == F.col("n"), F.lit(DONE))
        .when(F.col("provider").isin("openai", "azure", "groq", "mistral", "deepseek"), delta_form)
        .when(F.col("provider") == "anthropic", anthropic)
        .when(F.col("provider") == "gemini", F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":'), text, F.lit('},{"text":""}]}}]}')))
        .when(F.col("provider") == "cohere", F.concat(F.lit('{"type":"content-delta","delta":{"message":{"content":{"text":'), text, F.lit("}}}}")))
        .otherwise(F.concat(F.lit('{"response":'), text, F.lit("}")))
    )
    ts = F.timestamp_millis(F.unix_millis(F.lit(START).cast("timestamp")) + F.col("request_id") + F.col("seq"))
    out = d.select("request_id", "provider", (F.col("seq") * 2).cast("long").alias("seq"), ts.alias("ts"), data.alias("data"))
    # Anthropic reports usage at the start and before the end
    usage = F.array(
        F.struct(F.lit(-1).cast("long").alias("seq"), F.lit('{"type":"message_start","message":{"usage":{"input_tokens":12}}}').alias("data")),
        F.struct((n * 2 - 1).cast("long").alias("seq"), F.concat(F.lit('{"type":"message_delta","usage":{"output_tokens":'), n.cast("string"), F.lit("}}")).alias("data")),
    )
    first = F.timestamp_millis(F.unix_millis(F.lit(START).cast("timestamp")) + F.col("request_id"))
    extra = m.where(F.col("provider") == "anthropic").select("request_id", "provider", first.alias("ts"), F.inline(usage))
    return out.unionByName(extra)


_ASSEMBLED = f"""answers AS MATERIALIZED (
  SELECT msg_id AS request_id, provider, CASE WHEN provider IN ('bedrock', 'ollama') THEN '' ELSE text END AS text,
         len(string_split(text, ' ')) AS n
  FROM (SELECT *, ({PROVIDER_LIST})[CAST((conv_id + turn) % 10 AS INT) + 1] AS provider FROM messages))"""


def assembled(spark, sf_dir):
    return assemble(chunks(spark, sf_dir)).select("request_id", "provider", "text")


ASSEMBLED_SQL = f"WITH {messages_sql()}{_ASSEMBLED}\nSELECT request_id, provider, text FROM answers"


def stream_usage(spark, sf_dir):
    return assemble(chunks(spark, sf_dir)).select("request_id", "provider", "input_tokens", "output_tokens")


_DELTA = "provider IN ('openai', 'azure', 'groq', 'mistral', 'deepseek')"
USAGE_SQL = f"""WITH {messages_sql()}{_ASSEMBLED}
SELECT request_id, provider, CAST(CASE WHEN {_DELTA} THEN 11 WHEN provider = 'anthropic' THEN 12 ELSE 0 END AS BIGINT) AS input_tokens,
       CAST(CASE WHEN {_DELTA} OR provider = 'anthropic' THEN n ELSE 0 END AS BIGINT) AS output_tokens FROM answers"""


def scan_assembled(spark, sf_dir):
    d = scan_rows(assembled(spark, sf_dir), "text", rule_pack(["pii"]), context="output")
    return d.select("request_id", "provider", F.inline(F.array_compact("findings"))).select("request_id", "provider", *FINDING_LIST)


SCAN_SQL = (
    f"WITH {messages_sql()}{_ASSEMBLED},\n{texts_sql('answers', 'request_id')},\n"
    f"{findings_sql(pack('pii'), 'request_id', 'output')}\n"
    f"SELECT request_id, provider, {COLUMNS} FROM findings JOIN answers USING (request_id)"
)


def stream_scan(spark, sf_dir):
    """The same from a stream: chunks are read as they were written, responses are closed
    by the watermark and scanned.  The last row's time lies far ahead, so that the
    watermark passes all responses; its own session stays open."""
    folder = shared_folder(spark)
    rows = chunks(spark, sf_dir)
    rows.write.parquet(f"{folder}/chunks/part=1")
    ahead = spark.range(1).select(
        F.lit(-1).cast("long").alias("request_id"), F.lit("none").alias("provider"), F.lit(0).cast("long").alias("seq"),
        (F.lit(START).cast("timestamp") + F.expr("INTERVAL 100 YEARS")).alias("ts"), F.lit(DONE).alias("data"),
    )
    ahead.write.parquet(f"{folder}/chunks/part=2")
    schema = spark.read.parquet(f"{folder}/chunks").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/chunks").drop("part")
    run_available(stream_response_scan(stream), f"{folder}/found", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/found").select("request_id", "provider", *FINDING_LIST)


def _as_stream(spark, sf_dir, name):
    """A table as a stream, whether it is one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    # a stream takes a plain path for a folder; a pattern stands for either
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def findings_of_stream(spark, sf_dir):
    """Findings of the conversations read as a stream."""
    folder = shared_folder(spark)
    stream = _as_stream(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    run_available(stream_findings(stream, ["conv_id", "turn"], "text", rule_pack()), f"{folder}/found", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/found").select("conv_id", "turn", *FINDING_LIST)


STREAM_FINDINGS_SQL = (
    "WITH numbered AS (SELECT conv_id * 1000 + turn AS msg_id, conv_id, turn, text FROM conversations),\n"
    f"{texts_sql('numbered', 'msg_id')},\n{findings_sql(rule_pack(), 'msg_id')}\n"
    f"SELECT conv_id, turn, {COLUMNS} FROM findings JOIN numbered USING (msg_id)"
)


def audit_of_stream(spark, sf_dir):
    """Audit entries of the conversations read as a stream."""
    folder = shared_folder(spark)
    provider = F.get(F.array(*[F.lit(p) for p in PROVIDERS]), ((F.col("conv_id") + F.col("turn")) % 10).cast("int"))
    stream = (
        _as_stream(spark, sf_dir, "conversations")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), provider.alias("provider"), F.col("turn").alias("latency_ms"), "text")
    )
    entries = stream_audit(stream, "text")
    run_audit(entries, f"{folder}/audit", f"{folder}/checkpoint")
    listed = F.transform("findings", lambda f: F.concat_ws("|", f["category"], f["severity"], f["pattern_hash"]))
    written = spark.read.schema(entries.schema).json(f"{folder}/audit").drop("batch")
    return written.withColumn("findings", F.array_join(listed, ";"))


STREAM_AUDIT_SQL = (
    f"WITH numbered AS (SELECT conv_id * 1000 + turn AS msg_id, ({PROVIDER_LIST})[CAST((conv_id + turn) % 10 AS INT) + 1] AS provider, turn, text FROM conversations),\n"
    f"{texts_sql('numbered', 'msg_id')},\n{findings_sql(rule_pack(), 'msg_id')}\n"
    f"SELECT msg_id AS request_id, any_value(provider) AS provider, coalesce(bool_or({BLOCKING}), false) AS blocked, any_value(turn) AS latency_ms, "
    f"coalesce(({sql_list(SEVERITIES)})[max(severity_rank) + 1], 'none') AS max_severity, CAST(count(rule_id) AS INTEGER) AS finding_count, "
    "coalesce(string_agg(concat_ws('|', category, severity, substr(sha256(matched_pattern), 1, 16)), ';' ORDER BY ord, occurrence) FILTER (WHERE rule_id IS NOT NULL), '') AS findings "
    "FROM numbered LEFT JOIN findings USING (msg_id) GROUP BY msg_id"
)


def stream_stats(spark, sf_dir):
    """Hourly statistics of the request log read as a stream, ten minutes of lateness allowed."""
    folder = shared_folder(spark)
    log = request_log(spark, sf_dir)
    log.write.parquet(f"{folder}/log/part=1")
    ahead = spark.range(1).select(*[
        {"ts": (F.lit(START).cast("timestamp") + F.expr("INTERVAL 100 YEARS")), "provider": F.lit("none")}
        .get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
        for f in log.schema.fields
    ])
    ahead.write.parquet(f"{folder}/log/part=2")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/log").schema).parquet(f"{folder}/log").drop("part")
    run_available(windowed(stream, "1 hour", watermark="10 minutes"), f"{folder}/stats", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/stats").withColumn("window_start", F.unix_micros("window_start"))


def in_batches(spark, batches, make, folder, arrivals=None):
    """Every table of ``batches`` arrives after the query over the ones before it has ended; each time it goes on from its checkpoint."""
    schema = batches[0].schema
    for i, batch in enumerate(batches):
        batch.select(*schema.fieldNames()).write.parquet(f"{folder}/in/part={i}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in").drop("part")
        with state_store(spark):
            run_available(make(stream), f"{folder}/out", f"{folder}/checkpoint", arrivals=arrivals)
    return spark.read.parquet(f"{folder}/out")


def _ahead(spark, like, **values):
    """One row of the schema of ``like``: the given columns (SQL), all others null."""
    return spark.range(1).select(*[F.expr(values.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def rate_limited_stream(spark, sf_dir):
    """Rate limits of a stream that is stopped and started again twice."""
    rows = rate_events(spark, sf_dir)
    half = rows.agg(F.expr("percentile_approx(ts_ms, 0.5)")).first()[0] or 0
    end = _ahead(spark, rows, event_id="-1", ts_ms="unix_millis(timestamp'2124-01-01')")
    batches = [rows.where(F.col("ts_ms") < half), rows.where(F.col("ts_ms") >= half), end]
    return in_batches(spark, batches, lambda s: stream_rate_limit(s, RATE_LIMIT), shared_folder(spark))


def counters_of_stream(spark, sf_dir):
    """The counters that live at the end of the last minute."""
    log = with_pauses(request_log(spark, sf_dir))
    early, late = log.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    cut = [F.timestamp_micros(F.lit(early + (late - early) * k // 3)) for k in (1, 2)]
    end = _ahead(spark, log, request_id="-1", ts=f"timestamp_micros({late // 60_000_000 * 60_000_000 + 60_000_000})")
    batches = [log.where(F.col("ts") < cut[0]), log.where((F.col("ts") >= cut[0]) & (F.col("ts") < cut[1])), log.where(F.col("ts") >= cut[1]), end]
    return alive(in_batches(spark, batches, lambda s: stream_counters(s, late="0 seconds"), shared_folder(spark)))


def offenders_of_stream(spark, sf_dir):
    log = request_log(spark, sf_dir)
    end = _ahead(spark, log, ts="timestamp'2124-01-01 00:00:00 UTC'", blocked="true")
    half = F.lit("2024-01-16 00:00:00 UTC").cast("timestamp")
    batches = [log.where(F.col("ts") < half), log.where(F.col("ts") >= half), end]
    return in_batches(spark, batches, stream_offenders, shared_folder(spark))


def late_rows(spark, sf_dir):
    """Requests that arrived, those counted in hourly statistics, and those that came too late for them."""
    log = request_log(spark, sf_dir)
    again = log.where("request_id % 10 = 3")
    on_time = log.where("request_id % 10 = 4").withColumn("ts", F.col("ts") + F.expr("INTERVAL 60 DAYS"))
    folder = shared_folder(spark)
    batches = [log, again.unionByName(on_time), _ahead(spark, log, ts="timestamp'2124-01-01 00:00:00 UTC'", provider="'none'")]
    counted = in_batches(spark, batches, lambda s: windowed(count_arrivals(s), "1 hour", watermark="10 minutes"), folder, f"{folder}/arrivals")
    kept = counted.agg(F.sum("requests").alias("kept"))
    # the last row's own window stays open
    arrived = spark.read.parquet(f"{folder}/arrivals").agg((F.sum("arrived") - 1).alias("arrived"))
    return arrived.join(kept).select("arrived", "kept", (F.col("arrived") - F.col("kept")).alias("late"))


LATE_SQL = f"""WITH {REQUEST_LOG_SQL},
mark AS (SELECT max(epoch_us(ts)) - 600000000 AS m FROM request_log),
again AS (SELECT (epoch_us(ts) // 3600000000 + 1) * 3600000000 <= m AS late FROM request_log, mark WHERE request_id % 10 = 3)
SELECT n + again + on_time AS arrived, n + again + on_time - late AS kept, late
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE request_id % 10 = 4) AS on_time FROM request_log),
     (SELECT count(*) AS again, count(*) FILTER (WHERE late) AS late FROM again)"""


def entries():
    return {
        "stream_rate_limit": (rate_limited_stream, RATE_SQL),
        "stream_ttl": (counters_of_stream, _ttl_sql("(t // 60000000 + 1) * 60000000")),
        "stream_offenders": (offenders_of_stream, OFFENDERS_SQL),
        "stream_late_rows": (late_rows, LATE_SQL),
        "assemble_stream": (assembled, ASSEMBLED_SQL),
        "stream_usage": (stream_usage, USAGE_SQL),
        "scan_assembled": (scan_assembled, SCAN_SQL),
        "stream_scan": (stream_scan, SCAN_SQL),
        "stream_findings": (findings_of_stream, STREAM_FINDINGS_SQL),
        "stream_audit": (audit_of_stream, STREAM_AUDIT_SQL),
        "stream_stats": (stream_stats, _window_sql(1, 60)),
    }
