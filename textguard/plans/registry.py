"""All queries by name."""

from __future__ import annotations

from functools import cache

from textguard.plans import decision_queries, log_queries, payload_queries, stream_queries, text_queries


@cache
def entries() -> dict:
    out: dict = {}
    for module in (text_queries, decision_queries, payload_queries, log_queries, stream_queries):
        out |= module.entries()
    return out
