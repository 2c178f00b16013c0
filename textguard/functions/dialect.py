"""Python ``re`` patterns as Java patterns with the same meaning.

The rules are written in Python syntax.  Java reads almost all of it alike; the
shorthand classes, word boundaries and line ends differ outside ASCII, so these
are spelled out.
"""

from __future__ import annotations

import re

WORD = r"\p{L}\p{N}_"
SPACE = r"\p{Z}\t-\r\x1c-\x1f\x85"
_CLASS = {"w": WORD, "d": r"\p{Nd}", "s": SPACE}
_BOUNDARY = {
    "b": rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    "B": rf"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))",
}

# An atom that always takes word characters, right after or right before a boundary.
_ATOM = r"(?:\\[dw]|(?<!\\)[A-Za-z0-9_]|\[(?:[A-Za-z0-9](?:-[A-Za-z0-9])?|\\[dw])+\])"
_WORD_NEXT = re.compile(_ATOM + r"(?!\?|\*|\{0|\{,)")
_WORD_BEFORE = re.compile(_ATOM + r"(?:\+|\{[1-9]\d*(?:,\d*)?\})?$")


def _boundary(before: str, after: str) -> str:
    """A word boundary; one side suffices when the other side is known to be a word."""
    if _WORD_NEXT.match(after):
        return f"(?<![{WORD}])"
    if _WORD_BEFORE.search(before):
        return f"(?![{WORD}])"
    return _BOUNDARY["b"]


_NAMED = re.compile(r"\(\?P<([^>]+)>")
_REFERENCE = re.compile(r"\(\?P=([^)]+)\)")
_COMMENT = re.compile(r"\(\?#[^)]*\)")
_AT_MOST = re.compile(r"\{,(\d+)\}")
_LONG_POINT = re.compile(r"\\U([0-9a-fA-F]{8})")


def java_regex(pattern: str, flags: str = "") -> str:
    """``pattern`` for Java, with ``flags`` (any of i, m, s) as an inline prefix.

    Groups keep their names in a form Java allows. What has no Java form comes out as it is; ``rules.base.rejected`` finds it.
    """
    out: list[str] = []
    in_class = False
    names: dict[str, str] = {}
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if not in_class:
            if m := _NAMED.match(pattern, i):
                out.append(f"(?<{names.setdefault(m[1], f'g{len(names)}')}>")
                i = m.end()
                continue
            if m := _REFERENCE.match(pattern, i):
                out.append(f"\\k<{names.get(m[1], 'unknown')}>")
                i = m.end()
                continue
            if m := _COMMENT.match(pattern, i):
                i = m.end()
                continue
            if m := _AT_MOST.match(pattern, i):
                out.append(f"{{0,{m[1]}}}")
                i = m.end()
                continue
        if m := _LONG_POINT.match(pattern, i):
            out.append(f"\\x{{{m[1]}}}")
            i = m.end()
            continue
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            i += 2
            if n == "Z" and not in_class:
                out.append("\\z")
                continue
            if n in _CLASS:
                out.append(_CLASS[n] if in_class else f"[{_CLASS[n]}]")
            elif n.lower() in _CLASS and n.isupper():
                body = _CLASS[n.lower()]
                out.append(f"[^{body}]")
            elif n == "b" and not in_class:
                out.append(_boundary(pattern[: i - 2], pattern[i:]))
            elif n == "B" and not in_class:
                out.append(_BOUNDARY[n])
            else:
                out.append("\\" + n)
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c in "[&":
                c = "\\" + c
        elif c == "[":
            in_class = True
            # a leading ^ or ] belongs to the class
            if pattern[i + 1 : i + 2] == "^":
                c += "^"
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                c += "\\]"
                i += 1
        out.append(c)
        i += 1
    letters = "d" + "".join(f for f in "ims" if f in flags) + ("u" if "i" in flags else "")
    return f"(?{letters})" + "".join(out)
