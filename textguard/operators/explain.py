"""Readable explanations, recommendations and error documents for findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators.decide import HIGH, is_blocked

# Sentences by category; {} takes the finding's description or severity.
EXPLANATIONS = {
    "prompt_injection": "Prompt injection detected: '{}'. This pattern attempts to override the AI system's instructions. Attackers use this to make the AI ignore its safety guidelines or reveal system prompts.",
    "jailbreak": "Jailbreak attempt detected: '{}'. This pattern tries to bypass the AI's safety training. Common techniques include DAN prompts, developer mode requests, and role-play exploits.",
    "pii_input": "Personally Identifiable Information detected: '{}'. Sending PII to external AI providers may violate DPDP Act, GDPR, or internal data policies. Remove or anonymize this information before sending to the AI.",
    "pii_output": "PII detected in AI response: '{}'. The AI output contained personal information. This has been masked before returning to your application.",
    "toxic": "Harmful content request detected: '{}'. This request asks for content that could cause real-world harm. This category is always blocked regardless of configuration.",
}
RECOMMENDATIONS = {
    "prompt_injection": "Validate and sanitize all user input before passing to the LLM. Use structural separation between system instructions and user content.",
    "jailbreak": "Review your system prompt hardening. Consider adding explicit anti-jailbreak instructions. Monitor repeated attempts from the same user.",
    "pii_input": "Strip PII before sending to LLM, or set the pii_input action to warn if this service legitimately needs PII. Add this service to the allowlist if intentional.",
    "pii_output": "Output PII has been masked. Consider whether your system prompt should instruct the model to avoid repeating personal information.",
    "toxic": "This request violated zero-tolerance policies. Consider blocking the user account and investigating the source.",
}
OTHER_EXPLANATION = "{}. Category: "
OTHER_RECOMMENDATION = "Review the {} severity finding and adjust your application or scanner configuration."
BLOCKED_SUMMARY = "This request was blocked because {} security finding(s) were detected."
PASSED_SUMMARY = "This request passed all security checks."
ERROR_MESSAGE = "Request blocked by the text security layer"
ERROR_TYPE = "content_policy_violation"
ERROR_CODE = "request_blocked"


def _fill(template: str, value: Column) -> Column:
    head, tail = template.split("{}")
    return F.concat(F.lit(head), value, F.lit(tail))


def explanation(category: Column, description: Column) -> Column:
    out = F.concat(_fill(OTHER_EXPLANATION, description), category, F.lit("."))
    for c, sentence in EXPLANATIONS.items():
        out = F.when(category == c, _fill(sentence, description)).otherwise(out)
    return out


def recommendation(category: Column, severity: Column) -> Column:
    out = _fill(OTHER_RECOMMENDATION, severity)
    for c, sentence in RECOMMENDATIONS.items():
        out = F.when(category == c, F.lit(sentence)).otherwise(out)
    return out


def explain(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding with its explanation and recommendation."""
    return findings.select(
        *keys, "detector", "rule_id", "occurrence", "severity",
        (F.col("severity_rank") >= HIGH).alias("blocked"),
        explanation(F.col("category"), F.col("description")).alias("explanation"),
        recommendation(F.col("category"), F.col("severity")).alias("recommendation"),
    )


def explain_report(df: DataFrame, keys: list[str], findings: str = "findings") -> DataFrame:
    """One row per text: verdict, number of findings, the summary sentence, and each finding with its sentences."""
    f = F.col(findings)
    blocked = is_blocked(f)
    listed = F.transform(
        f,
        lambda x: F.struct(
            x["category"].alias("category"), x["severity"].alias("severity"), (x["severity_rank"] >= HIGH).alias("blocked"),
            explanation(x["category"], x["description"]).alias("explanation"),
            recommendation(x["category"], x["severity"]).alias("recommendation"),
        ),
    )
    return df.select(
        *keys,
        blocked.alias("blocked"),
        F.size(f).alias("finding_count"),
        F.when(blocked, _fill(BLOCKED_SUMMARY, F.size(f).cast("string"))).otherwise(F.lit(PASSED_SUMMARY)).alias("explanation"),
        listed.alias("findings"),
    )


def error_payload(df: DataFrame, request_id: str, findings: str = "findings") -> DataFrame:
    """The JSON error document of each blocked request."""
    listed = F.transform(
        findings,
        lambda f: F.struct(f["category"].alias("category"), f["severity"].alias("severity"), f["description"].alias("description")),
    )
    error = F.struct(
        F.lit(ERROR_MESSAGE).alias("message"), F.lit(ERROR_TYPE).alias("type"), F.lit(ERROR_CODE).alias("code"),
        F.col(request_id).cast("string").alias("request_id"), listed.alias("findings"),
    )
    return df.where(is_blocked(F.col(findings))).select(
        request_id, F.to_json(F.struct(error.alias("error"))).alias("payload")
    )
