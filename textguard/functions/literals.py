"""All of many literals that occur in a text, found in one pass.

The literals become one pattern: a trie in which every node splits its letters in halves, so a position of the text
costs a few class tests however many literals there are. At a position the longest literal is reported; it stands for all literals that it begins with.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letter(c: str) -> str:
    return f"\\x{{{ord(c):x}}}"


def _branches(children: dict[str, dict]) -> str:
    letters = sorted(children)
    if len(letters) == 1:
        return _letter(letters[0]) + _node(children[letters[0]])
    half = len(letters) // 2
    first, second = letters[:half], letters[half:]
    left, right = (_branches({c: children[c] for c in part}) for part in (first, second))
    if len(letters) > 2:
        left = f"(?=[{''.join(map(_letter, first))}])(?:{left})"
    return f"{left}|{right}"


def _node(node: dict) -> str:
    children = {c: n for c, n in node.items() if c}
    if not children:
        return ""
    inner = _branches(children)
    if "" in node:
        return f"(?:{inner})?"
    return f"(?:{inner})" if len(children) > 1 else inner


def pattern(literals: Iterable[str]) -> str:
    """A pattern whose first group is, at every position where a literal begins, the longest one."""
    root: dict = {}
    for literal in literals:
        node = root
        for c in literal:
            node = node.setdefault(c, {})
        node[""] = {}
    return f"(?=({_node(root)}))"


class Literals:
    """A set of literals (none of them empty) and the columns that say which of them a text holds."""

    def __init__(self, literals: Iterable[str]) -> None:
        self.all = sorted(set(literals))

    def found(self, text: Column) -> Column:
        """The longest literals of all positions, each once."""
        if not self.all:
            return F.array().cast("array<string>")
        return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern(self.all)), F.lit(1)))

    def standing_for(self, literal: str) -> list[str]:
        """The reported literals that show that ``literal`` occurs."""
        return [x for x in self.all if x.startswith(literal)]
