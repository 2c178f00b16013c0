"""What a scan must report, one text at a time, in plain Python."""

from __future__ import annotations

import base64
import re
import unicodedata

from textguard.functions.normalize import BIDI, INVISIBLE
from textguard.rules import Rule
from textguard.rules.injection import BASE64_KEYWORDS
from textguard.rules.jailbreak import CONFUSABLES, MANY_SHOT_PAIRS, MANY_SHOT_WORDS
from textguard.rules.pii import PRIVATE_IP


def clean(text: str) -> str:
    return unicodedata.normalize("NFKC", re.sub(f"[{INVISIBLE}{BIDI}]", "", text))


def folded(text: str) -> str:
    return clean(text).translate(str.maketrans(CONFUSABLES))


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()][::-1]
    doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)]
    return len(digits) >= 13 and sum(doubled) % 10 == 0


def digits_only(value: str) -> str:
    return re.sub(r"[\s\-]", "", value)


CHECKS = {
    "luhn": luhn,
    "aadhaar": lambda v: len(digits_only(v)) == 12 and digits_only(v)[0] != "0",
    "abha": lambda v: len(digits_only(v)) == 14,
    "public_ip": lambda v: not re.match(PRIVATE_IP, v),
}


def decodes_to_payload(blob: str) -> bool:
    try:
        decoded = base64.b64decode(blob + "==").decode("utf-8", errors="ignore").lower()
    except ValueError:
        return False
    return any(w in decoded for w in BASE64_KEYWORDS)


def hits(rule: Rule, text: str) -> list[tuple[str, int]]:
    """(match, position) pairs of one rule; the toxic short cut is left to the caller."""
    text = {"raw": str, "clean": clean, "folded": folded}[rule.column](text)
    pattern = rule.compiled()
    if rule.validator == "many_shot":
        words = sum(w in text.lower() for w in MANY_SHOT_WORDS)
        pairs = len(pattern.findall(text))
        shown = f"[{pairs} Q&A pairs, {words} harmful keywords]"
        return [(shown, 0)] if pairs >= MANY_SHOT_PAIRS and words else []
    if rule.validator == "base64":
        found = [(m.group(), m.start()) for m in pattern.finditer(text) if decodes_to_payload(m.group())]
        return found[:1]
    if rule.detector == "pii":
        check = CHECKS.get(rule.validator, lambda v: True)
        return [(m.group(), m.start()) for m in pattern.finditer(text) if check(m.group())]
    m = pattern.search(text)
    return [(m.group(), m.start())] if m else []


def findings(rules: list[Rule], text: str) -> list[tuple[str, str, int]]:
    """(rule_id, match, position) in report order."""
    zero = [r for r in rules if r.detector == "toxic" and r.shape == "hidden" and hits(r, text)]
    out = []
    for r in rules:
        if r.detector == "toxic" and zero and r is not zero[0]:
            continue
        out += [(r.rule_id, m, p) for m, p in hits(r, text)]
    return out


def masked(rules: list[Rule], text: str) -> str | None:
    out, found = text, False
    for r in rules:
        for value, _ in hits(r, text):
            found = True
            out = out.replace(value, f"[REDACTED:{r.label}]")
    return out if found else None
