"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from tests.session import session
from textguard.operators.scan import scan
from textguard.plans.registry import entries
from textguard.rules import rule_pack
from textguard.sources.tables import spread, table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

QUERIES = [
    "scan_all", "scan_corpus", "scan_pages", "scan_injection", "scan_jailbreak", "scan_pii", "scan_secrets",
    "scan_financial", "scan_cloud", "scan_toxic", "mask_pii", "pii_exposure", "verdict", "policy_verdict",
    "explain_report", "scan_batch", "many_shot_conversations", "char_entropy", "extract_request", "mask_output",
    "normalize_provider", "token_budget", "stats_rollup", "latency_percentiles", "top_blocked", "stats_sliding",
    "rate_limit", "offender_sessions", "assemble_stream", "stream_findings",
]


def run(df) -> float:
    t0 = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main() -> None:
    spark = session(CPUS, "16g")
    # start the JVM's compilers before anything is timed
    run(entries()["scan_secrets"][0](spark, SF_DIR))
    times = {}
    for name in QUERIES:
        t0 = time.time()
        run(entries()[name][0](spark, SF_DIR))
        times[name] = round(time.time() - t0, 3)

    # throughput of the bare scan: all built-in rules over the documents as they are
    docs = spread(table(spark, SF_DIR, "documents").select("doc_id", "text"), "doc_id").cache()
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    seconds = min(run(scan(docs, ["doc_id"], "text", rule_pack())) for _ in range(2))
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(CPUS),
        "scan_docs_per_sec": round(n / seconds, 1),
        "scan_mb_per_sec": round(size / seconds / 1e6, 2),
    }))


if __name__ == "__main__":
    main()
