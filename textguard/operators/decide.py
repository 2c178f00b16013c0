"""Block/allow decisions from an array of findings.  All narrow: one row in, one row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.rules import DETECTORS, SEVERITIES
from textguard.rules.injection import THRESHOLD

# Default action by finding category; other categories warn.
DEFAULT_POLICY = {
    "prompt_injection": "block",
    "jailbreak": "block",
    "pii_input": "block",
    "toxic": "warn",
    # credentials follow the personal-data action
    "secrets": "block",
}
MAX_BATCH = 100

HIGH = SEVERITIES.index("high")
CRITICAL = SEVERITIES.index("critical")


def blocking(f: Column, threshold: float = THRESHOLD) -> Column:
    """Whether one finding makes its detector block."""
    return (
        F.when(f["detector"] == "pii", f["severity_rank"] == CRITICAL)
        .when(f["detector"] == "injection", (f["severity_rank"] >= HIGH) & (f["confidence"] >= threshold))
        .otherwise(f["severity_rank"] >= HIGH)
    )


def is_blocked(findings: Column, threshold: float = THRESHOLD) -> Column:
    return F.exists(findings, lambda f: blocking(f, threshold))


def verdict(df: DataFrame, findings: str = "findings", threshold: float = THRESHOLD) -> DataFrame:
    """Adds blocked (any detector blocks), finding_count and max_severity."""
    f = F.col(findings)
    return df.select(
        "*",
        is_blocked(f, threshold).alias("blocked"),
        F.size(f).alias("finding_count"),
        max_severity(f).alias("max_severity"),
    )


def verdict_by_detector(
    df: DataFrame, keys: list[str], findings: str = "findings", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per key and detector that ran: blocked and finding_count."""
    per_detector = F.transform(
        F.array(*[F.lit(d) for d in DETECTORS]),
        lambda d: F.struct(
            d.alias("detector"),
            F.exists(findings, lambda f: (f["detector"] == d) & blocking(f, threshold)).alias("blocked"),
            F.size(F.filter(findings, lambda f: f["detector"] == d)).alias("finding_count"),
        ),
    )
    return df.select(*keys, F.inline(per_detector))


def policy_blocks(findings: Column, policy: dict[str, str] | None = None) -> Column:
    """A category set to ``block`` blocks on high and critical findings."""
    blocked = [c for c, action in (DEFAULT_POLICY if policy is None else policy).items() if action == "block"]
    return F.exists(findings, lambda f: f["category"].isin(blocked) & (f["severity_rank"] >= HIGH))


def policy_actions(findings: Column, policy: dict[str, str] | None = None) -> Column:
    """The distinct actions that the findings of a row call for, sorted."""
    policy = DEFAULT_POLICY if policy is None else policy

    def action(f: Column) -> Column:
        out = F.lit("warn")
        for category, a in policy.items():
            out = F.when(f["category"] == category, F.lit(a)).otherwise(out)
        return out

    return F.array_sort(F.array_distinct(F.transform(findings, action)))


def max_severity(findings: Column) -> Column:
    rank = F.array_max(F.transform(findings, lambda f: f["severity_rank"]))
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.coalesce(F.get(names, rank), F.lit("none"))


def message_verdicts(
    df: DataFrame, keys: list[str], role: str, text: str, findings: str = "findings", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per message of a batch: its keys (batch and place), role, blocked and findings.

    Blank messages have no findings and never block.
    """
    blank = F.trim(text) == ""
    found = F.when(blank, F.filter(findings, lambda f: F.lit(False))).otherwise(F.col(findings))
    return df.select(*keys, role, found.alias(findings)).select("*", is_blocked(F.col(findings), threshold).alias("blocked"))


def batch_verdict(df: DataFrame, batch: str, text: str, findings: str = "findings", limit: int = MAX_BATCH) -> DataFrame:
    """Totals per batch of messages, whatever its length; ``over_limit`` marks those that a server would not take.

    Blank messages count as messages but never block.
    """
    hit = is_blocked(F.col(findings)) & (F.trim(text) != "")
    totals = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.count_if(hit).alias("blocked_count"),
        F.sum(F.when(F.trim(text) != "", F.size(findings)).otherwise(0)).alias("finding_count"),
    )
    return totals.select(
        "*", (F.col("message_count") > limit).alias("over_limit"), (F.col("blocked_count") > 0).alias("blocked")
    )
