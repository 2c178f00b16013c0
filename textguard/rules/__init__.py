"""Rule packs by detector."""

from __future__ import annotations

from textguard.rules import cloud, company, financial, injection, jailbreak, pii, secrets, toxic
from textguard.rules.base import DETECTORS, SEVERITIES, Rule, numbered, rejected

_BUILT_IN = {
    "injection": injection.rules,
    "jailbreak": jailbreak.rules,
    "pii": pii.rules,
    "secrets": secrets.rules,
    "financial": financial.rules,
    "cloud": cloud.rules,
    "toxic": toxic.rules,
}


def rule_pack(detectors=DETECTORS, config: dict | None = None, extra_cloud=()) -> list[Rule]:
    """Numbered rules of the chosen detectors.  Company rules come from ``config``;
    invalid caller-supplied patterns are left out (``rejected`` lists them)."""
    rows: list[Rule] = []
    for d in DETECTORS:
        if d not in detectors:
            continue
        if d == "company":
            rows += company.rules(config)[0] if config else []
        else:
            rows += _BUILT_IN[d]()
        if d == "cloud" and extra_cloud:
            rows += rejected(cloud.extra_rules(list(extra_cloud)))[0]
    return numbered(rows)


__all__ = ["DETECTORS", "SEVERITIES", "Rule", "rule_pack", "rejected", "company"]
