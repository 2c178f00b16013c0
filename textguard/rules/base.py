"""Rule rows.

A rule is data: a regex in Python ``re`` syntax plus everything needed to turn
a match into a finding.  ``needs`` lists literals that any matching text must
contain (lower-cased): groups joined by `` & ``, alternatives inside a group by
`` or ``.  A token ``re:...`` is a small pattern instead of a literal.  Needs
only decide whether the regex is tried at all, so they must be implied by it.
``hit`` and ``miss`` are one matching and one non-matching example.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textguard.functions.dialect import java_regex

# Severities in rising order, detectors in reporting order.
SEVERITIES = ("low", "medium", "high", "critical")
DETECTORS = (
    "injection",
    "jailbreak",
    "pii",
    "secrets",
    "financial",
    "cloud",
    "company",
    "toxic",
)

# Room for the rules of one detector in ``ord``.
RULES_PER_DETECTOR = 100_000_000


@dataclass(frozen=True)
class Rule:
    rule_id: str
    detector: str
    regex: str
    description: str
    severity: str
    confidence: float
    category: str
    flags: str = ""
    label: str = ""
    # text the rule looks at: raw, clean or folded
    column: str = "raw"
    # how the match is shown: cut80, wrap60, wrap40, keyword, length, hidden
    shape: str = "cut80"
    needs: str = ""
    hit: str = ""
    miss: str = ""
    validator: str = ""
    origin: str = "specified"
    ord: int = 0

    @property
    def severity_rank(self) -> int:
        return SEVERITIES.index(self.severity)

    @property
    def need_groups(self) -> list[list[str]]:
        return [g.split(" or ") for g in self.needs.split(" & ")] if self.needs else []

    def compiled(self) -> re.Pattern:
        """The rule as a Python pattern, for examples and tests."""
        letters = {"i": re.IGNORECASE, "m": re.MULTILINE, "s": re.DOTALL}
        value = 0
        for f in self.flags:
            value |= letters[f]
        return re.compile(self.regex, value)


def numbered(rules: list[Rule]) -> list[Rule]:
    """Give each rule its place: detector order first, list order second."""
    seen: dict[str, int] = {}
    out = []
    for r in rules:
        seen[r.detector] = n = seen.get(r.detector, 0) + 1
        if n >= RULES_PER_DETECTOR:
            raise ValueError(f"too many rules for {r.detector}")
        out.append(replace(r, ord=DETECTORS.index(r.detector) * RULES_PER_DETECTOR + n))
    return out


# Groups that test another group, and flags that change what letters and digits are, have no Java form.
_NO_JAVA_FORM = re.compile(r"(?<!\\)(?:\\\\)*\(\?(?:\(|[imsx]*[aLu])")


def _refused(patterns: list[str]) -> dict[str, str]:
    """Patterns that Spark's own matcher does not take, with the reason. Without a session it is not asked; a scan asks again."""
    spark = SparkSession.getActiveSession()
    if spark is None or not patterns:
        return {}

    def reason(some: list[str]) -> str:
        try:
            spark.range(1).select(*[F.rlike(F.lit(""), F.lit(p)) for p in some]).collect()
        except PySparkException as e:
            return str(e).split("\n")[0]
        return ""

    return {p: r for p in patterns if (r := reason([p]))} if reason(patterns) else {}


def rejected(rules: list[Rule]) -> tuple[list[Rule], list[tuple[str, str]]]:
    """Split rules into usable ones and (rule_id, reason) for regexes that Python or Spark's matcher does not take."""
    good, bad = [], []
    for r in rules:
        try:
            r.compiled()
            if _NO_JAVA_FORM.search(r.regex):
                raise re.error("no form in Java")
            good.append(r)
        except (re.error, OverflowError, RecursionError) as e:
            bad.append((r.rule_id, str(e)))
    java = {r.rule_id: java_regex(r.regex, r.flags) for r in good}
    refused = _refused(list(java.values()))
    bad += [(r.rule_id, refused[java[r.rule_id]]) for r in good if java[r.rule_id] in refused]
    return [r for r in good if java[r.rule_id] not in refused], bad
