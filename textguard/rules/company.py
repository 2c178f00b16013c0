"""Company rules, built from a configuration dictionary.

Recognised keys: internal_domains, aws_account_ids, gcp_project_ids,
azure_subscription_ids, employee_id_pattern, customer_account_pattern,
blocked_keywords, custom_patterns (pattern, label, severity).
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from textguard.rules.base import SEVERITIES, Rule, rejected

CONFIG_VARIABLE = "TEXTGUARD_COMPANY_CONFIG"
CONFIG_NAMES = ("textguard.json", "textguard.yaml")


def find_config(start: str | Path = ".", home: str | Path | None = None) -> dict:
    """First configuration found: named by the environment, then config/,
    then the working directory, then the home directory; {} if there is none."""
    start, home = Path(start), Path(home) if home else Path.home()
    places = [Path(os.environ[CONFIG_VARIABLE])] if os.environ.get(CONFIG_VARIABLE) else []
    places += [start / "config" / n for n in CONFIG_NAMES]
    places += [start / n for n in CONFIG_NAMES]
    places += [home / f".{n}" for n in CONFIG_NAMES]
    for p in places:
        if p.is_file():
            return read_config(p)
    return {}


def read_config(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text or "{}")
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a YAML configuration needs PyYAML; JSON works without it") from e
    return yaml.safe_load(text) or {}


def _literal_need(value: str) -> str:
    """The longest plain run of a configured value; empty when it has none."""
    runs = re.findall(r"[a-z0-9._\-]+", value.lower())
    return max(runs, key=len, default="")


def rules(config: dict) -> tuple[list[Rule], list[tuple[str, str]]]:
    """Usable rules and the (rule_id, reason) list of invalid patterns."""
    company = config.get("company", config) or {}
    rows: list[Rule] = []

    def add(code, regex, desc, severity, label, flags="i", shape="wrap40", confidence=0.97, needs=""):
        n = sum(r.rule_id.startswith(code + "-") for r in rows) + 1
        rows.append(Rule(f"{code}-{n}", "company", regex, desc, severity, confidence, "pii_input",
                         flags=flags, label=label, shape=shape, needs=needs, origin="configured"))

    # The patterns around configured values, and their severities and confidences.
    domains = [str(d) for d in company.get("internal_domains", [])]
    for d in domains:
        add("CO-1", r"[\w._%+\-]+@" + re.escape(d), f"Internal company email ({d})", "high", "INTERNAL_EMAIL", needs=_literal_need(d))
    for d in domains:
        add("CO-2", r"https?://[\w\-\.]*" + re.escape(d) + r"[\w/\-?=#&.]*", f"Internal URL ({d})", "high", "INTERNAL_URL", needs=_literal_need(d))
    for a in company.get("aws_account_ids", []):
        a = str(a).replace("-", "")
        add("CO-3", rf"\b{re.escape(a)}\b", f"Company AWS Account ID ({a[:4]}****)", "critical", "COMPANY_AWS_ACCOUNT", flags="", needs=_literal_need(a))
    for p in company.get("gcp_project_ids", []):
        add("CO-4", rf"\b{re.escape(str(p))}\b", f"Company GCP Project ID ({p})", "critical", "COMPANY_GCP_PROJECT", needs=_literal_need(str(p)))
    for s in company.get("azure_subscription_ids", []):
        add("CO-5", rf"\b{re.escape(str(s))}\b", "Company Azure Subscription ID", "critical", "COMPANY_AZURE_SUB", needs=_literal_need(str(s)))
    if company.get("employee_id_pattern"):
        add("CO-6", company["employee_id_pattern"], "Company Employee ID", "high", "EMPLOYEE_ID")
    if company.get("customer_account_pattern"):
        add("CO-7", company["customer_account_pattern"], "Customer Account ID", "high", "CUSTOMER_ACCOUNT_ID")
    for c in company.get("custom_patterns", []):
        label = c.get("label", "custom")
        severity = str(c.get("severity", "high")).lower()
        add("CO-8", c.get("pattern", ""), f"Custom pattern: {label}",
            severity if severity in SEVERITIES else "high", "CUSTOM_" + label.upper().replace(" ", "_"))
    for k in company.get("blocked_keywords", []):
        add("CO-9", rf"\b{re.escape(k)}\b", "Blocked keyword detected", "high", "KEYWORD",
            shape="keyword", confidence=0.99, needs=_literal_need(k))
    return rejected(rows)
