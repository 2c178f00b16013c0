"""Scans of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textguard.operators.audit import audit_rows
from textguard.operators.decide import is_blocked
from textguard.operators.scan import scan, scan_rows
from textguard.rules import Rule, rule_pack
from textguard.streaming.assemble import assemble_stream


def stream_findings(texts: DataFrame, keys: list[str], text: str, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of a stream of texts.  Stateless, so rows leave as they arrive."""
    return scan(texts, keys, text, rules)


def stream_audit(requests: DataFrame, text: str, rules: list[Rule] | None = None) -> DataFrame:
    """Audit entries of a stream of requests (request_id, provider, latency_ms and the text). Stateless."""
    d = scan_rows(requests, text, rules)
    d = d.select("*", is_blocked(F.col("findings")).alias("blocked"))
    return audit_rows(d, "request_id", "provider", "blocked", "latency_ms")


def stream_response_scan(chunks: DataFrame) -> DataFrame:
    """Personal data in streamed responses, reported once each response has ended.

    Log only: the chunks have already been delivered.
    """
    done = assemble_stream(chunks)
    d = scan_rows(done, "text", rule_pack(["pii"]), context="output")
    return d.select("request_id", "provider", F.inline(F.array_compact("findings")))


def count_arrivals(stream: DataFrame) -> DataFrame:
    """``stream``, with its rows counted before any watermark drops late ones; ``run_available`` stores the counts."""
    return stream.observe("arrived", F.count(F.lit(1)).alias("n"))


def run_available(stream: DataFrame, out: str, checkpoint: str, partition_by: list[str] | None = None, arrivals: str | None = None) -> None:
    """Process everything that is available now into parquet files at ``out``.

    ``arrivals`` names a folder for the counts of ``count_arrivals``: batch, arrived and dropped (groups of late rows, as Spark counts them). A
    batch that runs again after a failure replaces its count.
    """
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    query: StreamingQuery = w.trigger(availableNow=True).start(out)
    query.awaitTermination()
    if arrivals:
        for p in query.recentProgress:
            arrived = (p.observedMetrics.get("arrived") or {"n": 0})["n"]
            dropped = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            row = stream.sparkSession.range(1).select(F.lit(arrived).cast("long").alias("arrived"), F.lit(dropped).cast("long").alias("dropped"))
            row.write.mode("overwrite").parquet(f"{arrivals}/batch={p.batchId}")


def audit_batches(path: str):
    """A sink of audit entries for ``foreachBatch``: JSON lines in a folder for every batch.

    A batch that runs again, because the query ended between the write and its commit, replaces its folder, so no entry is lost or written twice.
    """

    def write(entries: DataFrame, batch: int) -> None:
        entries.write.mode("overwrite").json(f"{path}/batch={batch}")

    return write


def run_audit(entries: DataFrame, path: str, checkpoint: str, sink=audit_batches) -> None:
    """Write the audit entries of everything that is available now, each once."""
    query = entries.writeStream.foreachBatch(sink(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
