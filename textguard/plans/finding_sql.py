"""The findings of a rule pack as DuckDB SQL, from the same rule rows.

RE2 has no lookahead.  The rules that use one are written as: hide the occurrences the
lookahead rules out (or check the groups afterwards), then match the rest.
"""

from __future__ import annotations

import re

from textguard.plans.fixtures import lit
from textguard.rules import Rule
from textguard.rules.injection import BASE64_KEYWORDS
from textguard.rules.jailbreak import MANY_SHOT_PAIRS, MANY_SHOT_WORDS
from textguard.rules.pii import PRIVATE_IP

COLUMNS = (
    "detector, rule_id, ord, occurrence, category, severity, severity_rank, confidence, "
    "description, matched_pattern, position"
)

# rule: (occurrence to hide, its replacement of equal length, pattern without lookahead)
HIDDEN = {
    "INJ-H01": (r"(?is)you(\s+are\s+now\san\s+(?:AI|assistant|language\s+model))", r"###\1", r"you\s+are\s+now\s+(a\s+)?"),
    "INJ-H02": (r"(?is)act(\s+as\san\s+(?:AI|assistant))", r"###\1", r"act\s+as\s+(if\s+you\s+are\s+)?(a\s+)?"),
    "INJ-H03": (r"(?is)pretend(\s+(?:you\s+are|to\s+be)\san\s+(?:AI|assistant))", r"#######\1", r"pretend\s+(you\s+are|to\s+be)\s+(a\s+)?"),
    "INJ-HI07": (r"(?s)आप(\s+अब\s+एक\s(?:AI|सहायक))", r"##\1", r"आप\s+अब\s+एक\s+"),
    "INJ-HG07": (r"(?is)ab(\s+tum\s(?:AI|assistant))", r"##\1", r"ab\s+tum\s+(ek\s+)?"),
}


def _flagged(rule: Rule, regex: str | None = None) -> str:
    regex = rule.regex if regex is None else regex
    if rule.origin == "configured":
        # forms of Python that RE2 spells differently
        regex = re.sub(r"\(\?#[^)]*\)", "", re.sub(r"\{,(\d+)\}", r"{0,\1}", regex)).replace(r"\Z", r"\z")
    return f"(?{rule.flags}:{regex})" if rule.flags else f"(?:{regex})"


def _shown(rule: Rule) -> str:
    label = rule.label.replace("'", "''")
    return {
        "cut80": "substr(m, 1, 80)",
        "wrap60": f"'[{label}: ' || substr(m, 1, 60) || ']'",
        "wrap40": f"'[{label}: ' || substr(m, 1, 40) || ']'",
        "keyword": "'[KEYWORD: ' || m || ']'",
        "length": f"'[{label}:' || CAST(length(m) AS VARCHAR) || ' chars]'",
        "hidden": "'[REDACTED]'",
        "blob30": "substr(m, 1, 30) || '...'",
        "as_is": "m",
    }[rule.shape]


def _select(rule: Rule, key: str, inner: str, context: str, description: str | None = None) -> str:
    category = rule.category
    text = lit(rule.description) if description is None else description
    if rule.detector == "pii":
        category = "pii_input" if context == "input" else "pii_output"
        text = lit(f"{rule.description} detected in {context}")
    return (
        f"SELECT {key}, '{rule.detector}' AS detector, '{rule.rule_id}' AS rule_id, {rule.ord} AS ord, "
        f"CAST(occurrence AS INTEGER) AS occurrence, '{category}' AS category, '{rule.severity}' AS severity, "
        f"{rule.severity_rank} AS severity_rank, CAST({rule.confidence} AS DOUBLE) AS confidence, "
        f"{text} AS description, {_shown(rule)} AS matched_pattern, CAST(position AS INTEGER) AS position "
        f"FROM ({inner})"
    )


def _first(rule: Rule, key: str) -> str:
    t, regex, group = rule.column, rule.regex, 0
    if rule.rule_id in HIDDEN:
        hide, by, regex = HIDDEN[rule.rule_id]
        t = f"regexp_replace({t}, {lit(hide)}, {lit(by)}, 'g')"
    p = _flagged(rule, regex)
    if rule.rule_id == "CLD-33":
        p, group = r"(?im:(https?://[a-z0-9\-\.]+:\d{4,5})/api/v[12])", 1
    before = lit(r"^(?s:(.*?))" + p)
    return (
        f"SELECT {key}, 1 AS occurrence, regexp_extract(t, {lit(p)}, {group}) AS m, "
        f"length(regexp_extract(t, {before}, 1)) AS position "
        f"FROM (SELECT {key}, {t} AS t FROM texts) WHERE regexp_matches(t, {lit(p)})"
    )


def _valid(rule: Rule) -> str:
    if rule.validator == "luhn":
        d = r"reverse(regexp_replace(m, '\D', '', 'g'))"
        v = f"CAST(substr({d}, k, 1) AS INTEGER)"
        return (
            f"length({d}) >= 13 AND list_sum(list_transform(range(1, length({d}) + 1), lambda k: "
            f"CASE WHEN k % 2 = 1 THEN {v} WHEN {v} > 4 THEN 2 * {v} - 9 ELSE 2 * {v} END)) % 10 = 0"
        )
    if rule.validator == "aadhaar":
        return r"regexp_full_match(regexp_replace(m, '[\s-]', '', 'g'), '[1-9]\d{11}')"
    if rule.validator == "abha":
        return r"length(regexp_replace(m, '[\s\-]', '', 'g')) = 14"
    if rule.validator == "public_ip":
        return f"NOT regexp_matches(m, {lit(PRIVATE_IP)})"
    if rule.rule_id == "PII-13":
        return r"NOT regexp_matches(m, '^(000|666|9)') AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'"
    return "true"


def matches_sql(rule: Rule, key: str) -> str:
    """All valid matches of a personal-data rule: key, occurrence, m, position."""
    regex = r"\b\d{3}[\s\-]\d{2}[\s\-]\d{4}\b" if rule.rule_id == "PII-13" else rule.regex
    p = lit(_flagged(rule, regex))
    found = (
        f"SELECT {key}, i AS occurrence, ms[i] AS m, "
        f"list_sum(list_transform(gs[1:i], lambda x: length(x))) "
        f"+ coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS position "
        f"FROM (SELECT {key}, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM "
        f"(SELECT {key}, regexp_extract_all(raw, {p}) AS ms, string_split_regex(raw, {p}) AS gs "
        f"FROM texts WHERE regexp_matches(raw, {p})))"
    )
    number = f"row_number() OVER (PARTITION BY {key} ORDER BY position)" if rule.rule_id == "PII-13" else "occurrence"
    return f"SELECT {key}, {number} AS occurrence, m, position FROM ({found}) WHERE {_valid(rule)}"


def base64_sql(rule: Rule, key: str) -> str:
    p = lit(_flagged(rule))
    body = "rtrim(m, '=')"
    text = f"lower(TRY(decode(from_base64(rpad({body}, CAST(ceil(length({body}) / 4.0) * 4 AS INTEGER), '=')))))"
    words = " OR ".join(f"contains({text}, {lit(w)})" for w in BASE64_KEYWORDS)
    return (
        f"SELECT {key}, occurrence, m, position FROM (SELECT {key}, i AS occurrence, ms[i] AS m, "
        f"list_sum(list_transform(gs[1:i], lambda x: length(x))) "
        f"+ coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS position "
        f"FROM (SELECT {key}, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM "
        f"(SELECT {key}, regexp_extract_all(clean, {p}) AS ms, string_split_regex(clean, {p}) AS gs "
        f"FROM texts WHERE regexp_matches(clean, {p})))) WHERE {words} "
        f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY occurrence) = 1"
    )


def many_shot_counts(rule: Rule, text: str) -> tuple[str, str]:
    words = " + ".join(f"CAST(contains(lower({text}), {lit(w)}) AS INTEGER)" for w in MANY_SHOT_WORDS)
    return f"len(regexp_extract_all({text}, {lit(_flagged(rule))}))", f"({words})"


def _many_shot(rule: Rule, key: str, context: str) -> str:
    pairs, words = many_shot_counts(rule, "folded")
    inner = (
        f"SELECT {key}, 1 AS occurrence, 0 AS position, n, "
        f"'[' || CAST(n AS VARCHAR) || ' Q&A pairs, ' || CAST(w AS VARCHAR) || ' harmful keywords]' AS m "
        f"FROM (SELECT {key}, {pairs} AS n, {words} AS w FROM texts) WHERE n >= {MANY_SHOT_PAIRS} AND w >= 1"
    )
    head, tail = rule.description.split("{}")
    return _select(rule, key, inner, context, f"{lit(head)} || CAST(n AS VARCHAR) || {lit(tail)}")


def findings_sql(rules, key: str, context: str = "input", name: str = "findings") -> str:
    """CTE ``name``; needs the CTE ``texts``."""
    parts, ending = [], []
    for r in rules:
        if r.validator == "many_shot":
            parts.append(_many_shot(r, key, context))
        elif r.validator == "base64":
            parts.append(_select(r, key, base64_sql(r, key), context))
        elif r.detector == "pii":
            parts.append(_select(r, key, matches_sql(r, key), context))
        elif r.detector == "toxic" and r.shape == "hidden":
            ending.append(_select(r, key, _first(r, key), context))
        else:
            parts.append(_select(r, key, _first(r, key), context))
    union = "\n  UNION ALL ".join(parts) if parts else None
    if not ending:
        return f"{name} AS MATERIALIZED (\n  {union})"
    last = (
        f"{name}_zero AS MATERIALIZED (SELECT * FROM (\n  " + "\n  UNION ALL ".join(ending)
        + f") QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ord) = 1)"
    )
    if union is None:
        return f"{last},\n{name} AS (SELECT * FROM {name}_zero)"
    return (
        f"{last},\n{name}_rest AS MATERIALIZED (\n  {union}),\n"
        f"{name} AS MATERIALIZED (SELECT * FROM {name}_zero UNION ALL SELECT * FROM {name}_rest "
        f"WHERE detector <> 'toxic' OR {key} NOT IN (SELECT {key} FROM {name}_zero))"
    )
