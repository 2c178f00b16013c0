"""Unicode's compatibility composition (NFKC) as column expressions: decomposition, canonical order, composition.

All tables are made from the character database of the running Python. A text of everyday letters is settled by one
pattern; only texts with another character are taken apart, and of these only characters near a mark go through all three steps.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.columns import constant, let

#: Characters of a page; tables are lists of pages, so that a look-up is two steps whatever the size of the table.
PAGE = 256
#: Everyday letters, digits and signs that no step changes: ranges of code points, the commonest first.
EVERYDAY = ((0x0, 0x9F), (0xC0, 0x131), (0x2010, 0x2010), (0x2012, 0x2016), (0x2018, 0x2023), (0x4E00, 0x9FFF), (0x410, 0x44F), (0x3041, 0x3093))

# The arithmetic of Hangul syllables (first letters, vowels, final consonants, syllables).
LEAD, VOWEL, TAIL, SYLLABLE = 0x1100, 0x1161, 0x11A7, 0xAC00
LEADS, VOWELS, TAILS = 19, 21, 28


@cache
def _all() -> list[str]:
    return [chr(p) for p in range(0x80, sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF and unicodedata.category(chr(p)) != "Cn"]


@cache
def _pairs() -> dict[str, dict[str, str]]:
    """Composed characters by second, then first character. Hangul goes by arithmetic."""
    out: dict[str, dict[str, str]] = {}
    for c in _all():
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            first, second = (chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", first + second) == c:
                out.setdefault(second, {})[first] = c
    return out


def _order(c: str) -> int:
    return unicodedata.combining(c)


def _syllable(c: str) -> bool:
    return SYLLABLE <= ord(c) < SYLLABLE + LEADS * VOWELS * TAILS


def _follows(c: str) -> bool:
    """Whether the character may be composed with one before it, or moved in front of one."""
    first = unicodedata.normalize("NFKD", c)[0]
    return bool(_order(first)) or first in _pairs() or VOWEL <= ord(first) < TAIL + TAILS


@cache
def _classes() -> tuple[str, str, str]:
    """Character classes for patterns: what may change, what may act on the character before it, and what canonical order moves."""
    every = _all()
    changes = [c for c in every if unicodedata.normalize("NFKC", c) != c or (_follows(c) and not _order(c)) or c in _pairs()]
    return tuple(map(_listed, (changes, [c for c in every if _follows(c)], [c for c in every if _order(c)])))


def _class(listed: str) -> str:
    """Everyday characters are ruled out before the list is looked at."""
    return f"[[^{_everyday()}]&&[{listed}]]"


def _listed(chars: list[str]) -> str:
    """Characters by pages, so that one is compared with the ranges of its own page only."""
    pages: dict[int, list[str]] = {}
    points = [ord(c) for c in chars]
    start = points[0]
    for p, following in zip(points, [*points[1:], -1]):
        if following != p + 1 or following // PAGE != p // PAGE:
            pages.setdefault(p // PAGE, []).append(f"\\x{{{start:x}}}-\\x{{{p:x}}}")
            start = following
    return "".join(f"[\\x{{{b * PAGE:x}}}-\\x{{{b * PAGE + PAGE - 1:x}}}&&[{''.join(rs)}]]" for b, rs in pages.items())


def _everyday() -> str:
    """The ranges, each nested in the one before: the commonest characters are settled by the first comparison."""
    ranges = [f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in EVERYDAY]
    return "[".join(ranges) + "]" * (len(ranges) - 1)


def _table(values: dict[str, object], kind: str) -> Column:
    pages: list[list] = [[] for _ in range(max(map(ord, values)) // PAGE + 1)]
    for c, v in sorted(values.items()):
        page = pages[ord(c) // PAGE]
        page += [None] * (ord(c) % PAGE - len(page)) + [v]
    return constant(pages, f"array<array<{kind}>>")


def _look_up(table: Column, c: Column) -> Column:
    code = F.ascii(c)
    return F.get(F.get(table, F.floor(code / PAGE).cast("int")), code % PAGE)


def _each(text: Column, table: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(_look_up(table, c), c)), "")


@cache
def decompositions(form: str = "NFKD") -> dict[str, str]:
    """Every character that the form changes, but Hangul syllables."""
    return {c: f for c in _all() if not _syllable(c) and (f := unicodedata.normalize(form, c)) != c}


def _forms(form: str) -> Column:
    return _table(decompositions(form), "string")


def _character(code: Column) -> Column:
    """The character of a code point with three bytes in UTF-8."""
    code = code.cast("long")
    high, middle, low = F.shiftright(code, 12), F.shiftright(code, 6) % 64, code % 64
    return F.unhex(F.hex(0xE08080 + high * 0x10000 + middle * 0x100 + low)).cast("string")


def _composed(first: Column, second: Column) -> Column:
    """The composition of two characters, or null."""
    pairs = {s: (list(by_first), list(by_first.values())) for s, by_first in _pairs().items()}
    rows = _table({s: {"first": "".join(f), "both": "".join(b)} for s, (f, b) in pairs.items()}, "struct<first: string, both: string>")
    a, b = F.ascii(first), F.ascii(second)
    lead_vowel = a.between(LEAD, LEAD + LEADS - 1) & b.between(VOWEL, VOWEL + VOWELS - 1)
    tail = a.between(SYLLABLE, SYLLABLE + LEADS * VOWELS * TAILS - 1) & ((a - SYLLABLE) % TAILS == 0) & b.between(TAIL + 1, TAIL + TAILS - 1)
    listed = let(_look_up(rows, second), lambda r: let(F.instr(r["first"], first), lambda at: F.when(at > 0, F.substring(r["both"], at, F.lit(1)))))
    return (
        F.when(lead_vowel, _character(SYLLABLE + ((a - LEAD) * VOWELS + (b - VOWEL)) * TAILS))
        .when(tail, _character(a + b - TAIL))
        .otherwise(listed)
    )


def _in_order(text: Column, moved: str, order: Column) -> Column:
    """Every stretch of marks sorted by their canonical classes; equal ones keep their order."""

    def place(run: Column) -> Column:
        marks = F.transform(F.split(run, ""), lambda c, i: F.struct(F.coalesce(_look_up(order, c), F.lit(0)).alias("k"), i.alias("i"), c.alias("c")))
        return F.array_join(F.transform(F.array_sort(marks), lambda m: m["c"]), "")

    runs = F.regexp_extract_all(text, F.lit(f"{moved}+|[^{moved}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^{moved}{{2}}"), place(r)).otherwise(r)), "")


def _put_together(text: Column, order: Column) -> Column:
    """Canonical composition of a decomposed and ordered text.

    The state of the fold: place and present form of the last starter, class of the last mark kept after it (-1: none), places of
    characters that were taken in, and starters that took some in. Only few characters are ever taken in by one starter.
    """
    start = F.struct(
        F.lit(-1).alias("i"), F.lit(-1).alias("at"), F.lit("").alias("form"), F.lit(-1).alias("last"),
        F.array().cast("array<int>").alias("taken"), F.array().cast("array<struct<at: int, form: string>>").alias("new"),
    )

    def step(s: Column, c: Column) -> Column:
        def decide(x: Column) -> Column:
            k, both = x["k"], x["both"]
            open_ = (s["at"] >= 0) & ((s["last"] == -1) | (s["last"] < k))
            joined, starter = open_ & both.isNotNull(), k == 0
            here = F.struct(s["at"].alias("at"), both.alias("form"))
            earlier = F.filter(s["new"], lambda n: n["at"] != s["at"])
            return F.struct(
                (s["i"] + 1).alias("i"),
                F.when(joined | ~starter, s["at"]).otherwise(s["i"] + 1).alias("at"),
                F.when(joined, both).when(starter, c).otherwise(s["form"]).alias("form"),
                F.when(joined, s["last"]).when(starter, -1).otherwise(k).alias("last"),
                F.when(joined, F.array_append(s["taken"], s["i"] + 1)).otherwise(s["taken"]).alias("taken"),
                F.when(joined, F.array_append(earlier, here)).otherwise(s["new"]).alias("new"),
            )

        return let(F.struct(F.coalesce(_look_up(order, c), F.lit(0)).alias("k"), _composed(s["form"], c).alias("both")), decide)

    def written(chars: Column) -> Column:
        def one(s: Column) -> Column:
            form = F.transform(
                chars, lambda c, i: F.when(F.array_contains(s["taken"], i), F.lit("")).otherwise(F.coalesce(F.get(F.filter(s["new"], lambda n: n["at"] == i), F.lit(0))["form"], c))
            )
            return F.when(F.size(s["taken"]) == 0, text).otherwise(F.array_join(form, ""))

        return let(F.aggregate(chars, start, step), one)

    return let(F.split(text, ""), written)


@cache
def _orders() -> dict[str, int]:
    return {c: _order(c) for c in _all() if _order(c)}


def nfkc(text: Column) -> Column:
    """The NFKC form of a text, equal to Python's for every character of its database; null stays null."""
    listed = _classes()
    changes, follows, moved = map(_class, listed)
    everyday, rare = f"[{_everyday()}]", f"[[^{_everyday()}]&&[^{listed[1]}]]"
    order = _table(_orders(), "int")

    def settled(piece: Column) -> Column:
        # only a character with what follows on it goes through all steps; everyday letters go through none
        ordered = _in_order(_each(piece, _forms("NFKD")), moved, order)
        # the first two characters tell what a piece is, however long it is
        same = F.when(piece.rlike(f"^{everyday}(?!{follows})"), piece).when(~piece.rlike(f"{changes}|{moved}{{2}}"), piece)
        near = same.when(piece.rlike(f"^[^{follows}]?{follows}"), let(ordered, lambda t: _put_together(t, order)))
        return near.otherwise(_each(piece, _forms("NFKC")))

    # a character and what acts on it; everyday letters; other characters
    pieces = F.regexp_extract_all(text, F.lit(f"[^{follows}]?{follows}+|{everyday}+(?!{follows})|{rare}+(?!{follows})"), F.lit(0))
    whole = F.array_join(F.transform(pieces, settled), "")
    return F.when(text.rlike(f"^{everyday}*+\\z"), text).otherwise(whole)
