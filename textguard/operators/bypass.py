"""Bypass tokens: approved callers whose requests skip some detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions.validators import value_hash
from textguard.rules import DETECTORS

# Modes, the detectors each one skips, and their descriptions.
SKIPPED = {
    "full": list(DETECTORS),
    "injection": ["injection", "jailbreak", "toxic"],
    "pii": ["pii", "secrets", "financial", "cloud", "company"],
}
DESCRIPTIONS = {
    "full": "All detectors bypassed (allowlisted service account)",
    "pii": "PII detector bypassed (allowlisted — document generation context)",
    "injection": "Injection/jailbreak detectors bypassed (allowlisted — trusted internal prompt)",
    "none": "",
}


def parse_tokens(spark: SparkSession, setting: str) -> DataFrame:
    """``TOKEN:MODE,TOKEN:MODE`` as (token_hash, mode).  A missing mode means full,
    an unknown one drops the entry, and the last entry of a token wins."""
    entry = F.trim("entry")
    named = F.contains(entry, F.lit(":"))
    rest = F.expr("substring(trim(entry), instr(trim(entry), ':') + 1)")
    return (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(setting), ",")).alias("place", "entry"))
        .select(
            "place",
            F.when(named, F.trim(F.substring_index(entry, ":", 1))).otherwise(entry).alias("token"),
            F.when(named, F.lower(F.trim(rest))).otherwise(F.lit("full")).alias("mode"),
        )
        .where(F.col("mode").isin(list(SKIPPED)) & (F.col("token") != ""))
        .groupBy("token")
        .agg(F.max_by("mode", "place").alias("mode"))
        .select(F.sha2("token", 256).alias("token_hash"), "mode")
    )


def with_mode(requests: DataFrame, header: str, setting: str) -> DataFrame:
    """Adds ``mode`` (none without a valid token).  The token list comes out of one configuration string;
    Spark sees its size and chooses the join."""
    tokens = parse_tokens(requests.sparkSession, setting)
    return (
        requests.withColumn("_h", F.sha2(F.trim(header), 256))
        .join(tokens, F.col("_h") == F.col("token_hash"), "left")
        .drop("_h", "token_hash")
        .withColumn("mode", F.coalesce("mode", F.lit("none")))
    )


def remaining(findings: Column, mode: Column) -> Column:
    """Findings of the detectors that the mode does not skip."""

    def kept(f: Column) -> Column:
        out = F.lit(True)
        for m, detectors in SKIPPED.items():
            out = F.when(mode == m, ~f["detector"].isin(detectors)).otherwise(out)
        return out

    return F.filter(findings, kept)


def description(mode: Column) -> Column:
    out = F.lit("")
    for m, d in DESCRIPTIONS.items():
        out = F.when(mode == m, F.lit(d)).otherwise(out)
    return out


def audit(requests: DataFrame, keys: list[str], header: str) -> DataFrame:
    """One row per bypassed request, with a token hash instead of the token."""
    return requests.where(F.col("mode") != "none").select(
        *keys, "mode", value_hash(F.col(header), 12).alias("token_hash"), description(F.col("mode")).alias("description")
    )
