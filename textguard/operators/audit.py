"""Audit rows and their append-only JSON-lines sink.  Raw text never appears in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions.validators import value_hash
from textguard.operators.decide import max_severity


def audit_rows(
    df: DataFrame, request_id: str, provider: str, blocked: str, latency_ms: str, findings: str = "findings"
) -> DataFrame:
    """One entry per request; matched patterns are hashed, confidences rounded to three digits."""
    listed = F.transform(
        findings,
        lambda f: F.struct(
            f["category"].alias("category"),
            f["severity"].alias("severity"),
            F.round(f["confidence"], 3).alias("confidence"),
            f["description"].alias("description"),
            value_hash(F.coalesce(f["matched_pattern"], F.lit(""))).alias("pattern_hash"),
        ),
    )
    return df.select(
        F.col(request_id).alias("request_id"),
        F.col(provider).alias("provider"),
        F.col(blocked).alias("blocked"),
        F.col(latency_ms).alias("latency_ms"),
        max_severity(F.col(findings)).alias("max_severity"),
        F.size(findings).alias("finding_count"),
        listed.alias("findings"),
    )


def write_audit(entries: DataFrame, path: str, ts: str | None = None) -> None:
    """Append entries as JSON lines, one folder per day."""
    stamp = F.col(ts) if ts else F.current_timestamp()
    iso = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    day = F.to_date(stamp)
    rest = [c for c in entries.columns if c != ts]
    entries.select(iso.alias("ts"), *rest, day.alias("day")).write.mode("append").partitionBy("day").json(path)
