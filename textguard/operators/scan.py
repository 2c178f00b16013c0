"""Scan a table of texts with a rule pack.

One narrow pass: every rule becomes a guarded expression over the row's text, so
a scan adds no shuffle and reads each text once.  Cheap literal tests decide
which regexes run at all; extraction happens only for rules that match.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.columns import constant, running_total
from textguard.functions.dialect import java_regex
from textguard.functions.literals import Literals
from textguard.functions.normalize import clean, fold_confusables, is_ascii, lowered
from textguard.functions.validators import VALIDATORS
from textguard.rules import Rule, rejected, rule_pack
from textguard.rules.jailbreak import MANY_SHOT_PAIR, MANY_SHOT_PAIRS, MANY_SHOT_WORDS

HIT = "struct<rule:int,matches:array<string>,gaps:array<int>,note:int>"
META = (
    "array<struct<detector:string,rule_id:string,ord:int,category:string,severity:string,"
    "severity_rank:int,confidence:double,description:string,label:string,shape:string>>"
)
FINDING_COLUMNS = [
    "detector", "rule_id", "ord", "occurrence", "category", "severity", "severity_rank",
    "confidence", "description", "matched_pattern", "position",
]
_TEXT = {"raw": "_raw", "clean": "_clean", "folded": "_folded"}
# Lower-cased text for the gates.  Where normalisation changes a text it holds both
# forms, so one column serves the rules of every form.
_LOW = "_low"
# The gates' literals that it holds.
_FOUND = "_found"


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _holds(token: str, low: str) -> str:
    if token.startswith("re:"):
        return f"rlike({low}, {quoted(java_regex(token[3:]))})"
    return f"contains({low}, {quoted(token)})"


class _Gates:
    """Boolean columns for the first need group of each rule, shared between rules.

    All literals of these groups are looked for in one pass over the text; the columns look into the short list of those found.
    """

    def __init__(self, rules: list[Rule]) -> None:
        self.columns: dict[str, str] = {}
        for r in rules:
            for t in r.need_groups[0] if r.need_groups else []:
                self.columns.setdefault(t, f"_g{len(self.columns)}")
        self.literals = Literals(t for t in self.columns if not t.startswith("re:"))

    def condition(self, rule: Rule) -> list[str]:
        return [
            "(" + " OR ".join(self.columns.get(t) or _holds(t, _LOW) for t in group) + ")"
            for group in rule.need_groups
        ]

    def found(self) -> Column:
        return self.literals.found(F.col(_LOW))

    def expressions(self) -> list[Column]:
        def held(t: str) -> str:
            if t.startswith("re:"):
                return _holds(t, _LOW)
            return " OR ".join(f"array_contains({_FOUND}, {quoted(x)})" for x in self.literals.standing_for(t))

        return [F.expr(f"{held(t)} AS {n}") for t, n in self.columns.items()]


def _hit(rule: int, matches: str, gaps: str, note: str = "CAST(NULL AS INT)") -> str:
    return f"named_struct('rule', {rule}, 'matches', {matches}, 'gaps', {gaps}, 'note', {note})"


def _first_match(index: int, rule: Rule) -> tuple[str, str]:
    text, p = _TEXT[rule.column], quoted(java_regex(rule.regex, rule.flags))
    before = f"array(length(element_at(split({text}, {p}, 2), 1)))"
    return f"rlike({text}, {p})", _hit(index, f"array(regexp_extract({text}, {p}, 0))", before)


def _all_matches(index: int, rule: Rule) -> tuple[str, str]:
    text, p = _TEXT[rule.column], quoted(java_regex(rule.regex, rule.flags))
    gaps = f"transform(split({text}, {p}, -1), g -> length(g))"
    return f"rlike({text}, {p})", _hit(index, f"regexp_extract_all({text}, {p}, 0)", gaps)


def pair_count(text: str) -> str:
    """Number of compliant question-and-answer pairs in a transcript."""
    return f"size(regexp_extract_all({text}, {quoted(java_regex(MANY_SHOT_PAIR, 'is'))}, 0))"


def harmful_words(low: str) -> str:
    """How many of the many-shot words occur in a lower-cased text."""
    return "(" + " + ".join(f"CAST(contains({low}, {quoted(w)}) AS INT)" for w in MANY_SHOT_WORDS) + ")"


def _many_shot(index: int) -> tuple[str, str]:
    text, low = _TEXT["folded"], f"lower({_TEXT['folded']})"
    answered = java_regex(r"(?:assistant|ai|a)\s*:\s*(?:sure|of course|certainly|yes|happy to|absolutely|here)")
    words, pairs = harmful_words(low), pair_count(text)
    cond = (
        f"contains({_LOW}, ':') AND rlike({_LOW}, {quoted(answered)})"
        f" AND {words} >= 1 AND {pairs} >= {MANY_SHOT_PAIRS}"
    )
    shown = f"concat('[', {pairs}, ' Q&A pairs, ', {words}, ' harmful keywords]')"
    return cond, _hit(index, f"array({shown})", "array(0)", pairs)


def _found(rules: list[tuple[int, Rule]], gates: _Gates) -> str:
    """array<HIT> of the given rules, in rule order, without the ones that miss."""
    parts = []
    for index, rule in rules:
        if rule.validator == "many_shot":
            cond, hit = _many_shot(index)
        elif rule.detector == "pii" or rule.validator == "base64":
            cond, hit = _all_matches(index, rule)
        else:
            cond, hit = _first_match(index, rule)
        lead, *rest = gates.condition(rule) or ["true"]
        # nested, because Spark would compute tests shared by several conditions for every row
        checked = f"CASE WHEN {' AND '.join([*rest, cond])} THEN {hit} END"
        parts.append(f"CASE WHEN {lead} THEN {checked} END")
    return f"array_compact(array({', '.join(parts)}))"


def _hits(rules: list[Rule], gates: _Gates) -> str:
    numbered = list(enumerate(rules))
    ending = [x for x in numbered if x[1].shape == "hidden" and x[1].detector == "toxic"]
    toxic = [x for x in numbered if x[1].detector == "toxic" and x not in ending]
    other = [x for x in numbered if x[1].detector != "toxic"]
    parts = [_found(other, gates)] if other else []
    if ending:
        # a zero-tolerance hit is reported alone and nothing else of the detector is tried
        rest = _found(toxic, gates) if toxic else f"CAST(array() AS ARRAY<{HIT}>)"
        parts.append(
            f"element_at(transform(array({_found(ending, gates)}),"
            f" z -> CASE WHEN size(z) > 0 THEN slice(z, 1, 1) ELSE {rest} END), 1)"
        )
    elif toxic:
        parts.append(_found(toxic, gates))
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _prepared(df: DataFrame, text: str, rules: list[Rule], keep: list[str]) -> DataFrame:
    """Add the text forms the rules need and the lower-cased text for the gates."""
    used = {r.column for r in rules}
    d = df.select(*keep, F.col(text).alias("_raw"))
    gate_text = F.col("_raw")
    if used & {"clean", "folded"}:
        d = d.select("*", clean(F.col("_raw")).alias("_clean"))
        d = d.select("*", F.when(is_ascii(F.col("_raw")), F.col("_raw")).otherwise(fold_confusables(F.col("_clean"))).alias("_folded"))
        gate_text = F.when(F.col("_folded") == F.col("_raw"), F.col("_raw")).otherwise(
            F.concat("_folded", F.lit("\n"), "_raw")
        )
    return d.select("*", gate_text.alias("_gate")).select("*", lowered(F.col("_gate")).alias(_LOW))


def _valid(rule: Column, match: Column, rules: list[Rule]) -> Column:
    out = F.lit(True)
    for index, r in enumerate(rules):
        if r.validator in VALIDATORS:
            out = F.when(rule == index, VALIDATORS[r.validator](match)).otherwise(out)
    return out


def _located(rules: list[Rule]):
    """HIT -> array of its valid matches with their character positions."""
    single = [i for i, r in enumerate(rules) if r.validator == "base64"]

    def located(h: Column) -> Column:
        steps = F.transform(
            h["matches"],
            lambda m, i: F.get(h["gaps"], i)
            + F.when(i > 0, F.length(F.get(h["matches"], i - 1))).otherwise(0),
        )
        numbered = F.arrays_zip(
            h["matches"].alias("match"),
            running_total(steps).alias("position"),
            F.sequence(F.lit(1), F.size(h["matches"])).alias("occurrence"),
        )
        kept = F.filter(numbered, lambda x: _valid(h["rule"], x["match"], rules))
        if single:
            kept = F.when(h["rule"].isin(single), F.slice(kept, 1, 1)).otherwise(kept)
        return F.transform(
            kept,
            lambda x: F.struct(
                h["rule"].alias("rule"), x["occurrence"].alias("occurrence"), x["match"].alias("match"),
                x["position"].alias("position"), h["note"].alias("note"),
            ),
        )

    return located


def with_hits(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """``df`` plus ``_raw`` and ``_hits``, the array of rules that match each row."""
    # a pattern made without a session may turn out to have no Java form: such a rule matches nothing
    own = [r for r in rules if r.origin == "configured"]
    usable = set(rejected(own)[0]) if own else set()
    rules = [r if r.origin != "configured" or r in usable else replace(r, regex="(?!)", needs="") for r in rules]
    gates = _Gates(rules)
    d = _prepared(df, text, rules, df.columns)
    d = d.select("*", gates.found().alias(_FOUND)).select("*", *gates.expressions())
    hits = F.expr(_hits(rules, gates)) if rules else F.array().cast(f"array<{HIT}>")
    # made by a generator, so that filters on its result stay above it (and do not repeat the scan),
    # while filters on other columns pass on to the file
    return d.select(*df.columns, "_raw", F.inline_outer(F.array(F.struct(hits.alias("_hits")))))


def matched_values(df: DataFrame, text: str, rules: list[Rule], out: str = "matches") -> DataFrame:
    """``df`` plus the array of raw matches: rule (index), occurrence, match, position, note."""
    d = with_hits(df, text, rules)
    return d.select(*df.columns, F.flatten(F.transform("_hits", _located(rules))).alias(out))


def _finding(meta: Column):
    def finding(x: Column) -> Column:
        r = F.get(meta, x["rule"])
        m, shape, label = x["match"], r["shape"], r["label"]
        shown = (
            F.when(shape == "cut80", F.substring(m, 1, 80))
            .when(shape == "wrap60", F.concat(F.lit("["), label, F.lit(": "), F.substring(m, 1, 60), F.lit("]")))
            .when(shape == "wrap40", F.concat(F.lit("["), label, F.lit(": "), F.substring(m, 1, 40), F.lit("]")))
            .when(shape == "keyword", F.concat(F.lit("[KEYWORD: "), m, F.lit("]")))
            .when(shape == "length", F.concat(F.lit("["), label, F.lit(":"), F.length(m).cast("string"), F.lit(" chars]")))
            .when(shape == "blob30", F.concat(F.substring(m, 1, 30), F.lit("...")))
            .when(shape == "as_is", m)
            .otherwise(F.lit("[REDACTED]"))
        )
        described = F.coalesce(F.replace(r["description"], F.lit("{}"), x["note"].cast("string")), r["description"])
        values = {
            "occurrence": x["occurrence"], "description": described,
            "matched_pattern": shown, "position": x["position"],
        }
        return F.struct(*[values.get(c, r[c]).alias(c) for c in FINDING_COLUMNS])

    return finding


def _meta(rules: list[Rule], context: str) -> Column:
    pii_category = "pii_input" if context == "input" else "pii_output"
    return constant(
        [
            {
                "detector": r.detector, "rule_id": r.rule_id, "ord": r.ord,
                "category": pii_category if r.detector == "pii" else r.category,
                "severity": r.severity, "severity_rank": r.severity_rank, "confidence": r.confidence,
                "description": f"{r.description} detected in {context}" if r.detector == "pii" else r.description,
                "label": r.label, "shape": r.shape,
            }
            for r in rules
        ],
        META,
    )


def scan_rows(
    df: DataFrame, text: str, rules: list[Rule] | None = None, context: str = "input", out: str = "findings"
) -> DataFrame:
    """``df`` plus the array of findings of each row, in rule order.  No shuffle.

    The matched value is shown only as far as the rule allows.
    """
    rules = rule_pack() if rules is None else rules
    d = matched_values(df, text, rules, "_matches")
    return d.select(*df.columns, F.transform("_matches", _finding(_meta(rules, context))).alias(out))


def scan(
    df: DataFrame, keys: list[str], text: str, rules: list[Rule] | None = None, context: str = "input"
) -> DataFrame:
    """One row per finding of ``rules`` (default: all built-in ones) in column ``text``."""
    d = scan_rows(df.select(*keys, text), text, rules, context, "_findings")
    return d.select(*keys, F.inline_outer("_findings")).where("rule_id IS NOT NULL")
