"""Personal data, with a skip-chain conditional random field that keeps a document's labels consistent.

Patterns with checks find e-mail addresses, IP addresses, payment cards and phone numbers. What people repeat
they often write differently: a card with other gaps or a wrong digit group, a phone number without its prefix,
the name of a mailbox alone. Such tokens look like data but prove nothing by themselves. In the field every
mention is a node with a label; neighbours in the text are joined by a chain, and mentions that repeat or
resemble each other, however far apart, by skip edges. Loopy message passing then carries the certainty of the
proven mentions to the others. The potentials are counted over all documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

# The patterns of the four kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same; a run of digits that fails at its start fails everywhere, so no other place is tried.
_IP = re.compile(r"(?<![0-9])" + IP.pattern)
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_ANY = re.compile(r"[0-9@]").search
_MAILBOX = re.compile(r"[A-Za-z0-9._%+-]+")
#: Mentions that are not proven: numbers with gaps, addresses with their signs spelled out, single words.
_NUMBER = re.compile(r"[0-9](?:[\x20().,/_-]{0,3}[0-9]){6,18}")
_SPELLED = re.compile(
    r"([A-Za-z0-9][A-Za-z0-9._%+-]*)\s?[\[({<]?\s?(?:@|at|AT)\s?[\])}>]?\s?([A-Za-z0-9-]+(?:\s?[\[({<]?\s?(?:\.|dot|DOT)\s?[\])}>]?\s?[A-Za-z0-9-]+)+)"
)
_DOT = re.compile(r"\s?[\[({<]?\s?(?:\.|dot|DOT)\s?[\])}>]?\s?")
_WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*[A-Za-z0-9]")
_GROUPS = re.compile(r"[0-9]+")
#: Forms that stand for themselves, also where a pattern ran on into a neighbouring number and failed.
_WHOLE_CARD = re.compile(r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2})(?![\w-])")
_WHOLE_PHONE = re.compile(r"\+[0-9]{1,3}[ -]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ -][0-9]{3}[ -][0-9]{4}(?![\w-])")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Matches of EMAIL. Between two signs no match can begin, so only what stands before each sign is tried, read from its end."""
    at, free = text.find("@"), 0
    while at >= 0:
        size = 256
        while (box := _MAILBOX.match(text[max(free, at - size) : at][::-1])) and box.end() == size and at - size > free:
            size *= 4
        if box and (m := EMAIL.match(text, at - box.end())):
            yield m
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """What the patterns and checks find, by kind, then start; offsets in code points, end exclusive."""
    if not _ANY(text):
        return []
    out = [("email", m.start(), m.end()) for m in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(len, _GROUPS.findall(m[0]))) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _keys(kind: str, raw: str) -> set[str]:
    """What a mention of the kind shares with its like, however it is written."""
    digits = "".join(_GROUPS.findall(raw))
    if kind == "card":
        return {"card " + digits, "card " + digits[:6] + digits[-4:]}
    if kind == "phone":
        return {"phone " + digits[-7:]}
    if kind == "ip":
        return {"ip " + ".".join(g.lstrip("0") or "0" for g in _GROUPS.findall(raw))}
    box, _, host = raw.lower().partition("@")
    return {"email " + box + "@" + host, "box " + box}


def _whole_forms(text: str) -> list[tuple[int, int, str]]:
    """start, end, shape of numbers in the usual form of a kind, checked as the kind is."""
    out = [(m.start(), m.end(), "whole card") for m in _WHOLE_CARD.finditer(text) if _luhn("".join(_GROUPS.findall(m[0])))]
    phones = [m for m in _WHOLE_PHONE.finditer(text) if 9 <= sum(map(len, _GROUPS.findall(m[0]))) <= 15]
    return out + [(m.start(), m.end(), "whole phone") for m in phones]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with those that overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mentions(text: str, base: list[Span]) -> list[tuple[int, int, str, frozenset[str]]]:
    """start, end, shape and keys of what might be data but is not in ``base``: whole forms, and what resembles them or ``base``."""
    known: set[str] = set()
    for kind, a, b in base:
        known |= _keys(kind, text[a:b])
    taken = sorted((a, b) for _, a, b in base)
    found = []
    for a, b, shape in _whole_forms(text):
        keys = frozenset(_keys(shape.split(" ")[1], text[a:b]))
        if not any(x < b and a < y for x, y in taken):
            known |= keys
            found.append((a, b, shape, keys))
    if not known:
        return []
    # what is data already does not run into its neighbours
    cuts = [0, *(e for span in _union([*taken, *((x[0], x[1]) for x in found)]) for e in span), len(text)]
    text = "".join(text[a:b] if i % 2 == 0 else "\n" * (b - a) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    for m in _NUMBER.finditer(text):
        digits = _GROUPS.findall(m[0])
        n = sum(map(len, digits))
        keys = set()
        if 13 <= n <= 19:
            keys |= _keys("card", m[0])
        if 7 <= n <= 15:
            keys |= _keys("phone", m[0])
        if len(digits) == 4:
            keys |= _keys("ip", m[0])
        found.append((m.start(), m.end(), f"number {min(n, 20)}", frozenset(keys & known)))
    for m in _SPELLED.finditer(text) if any(k.startswith("box ") for k in known) else ():
        raw = m[1] + "@" + _DOT.sub(".", m[2])
        found.append((m.start(), m.end(), "spelled", frozenset(_keys("email", raw) & known)))
    boxes = {k for k in known if k.startswith("box ") and len(k) >= 8 and re.search(r"[0-9._]", k[4:])}
    for m in _WORD.finditer(text) if boxes else ():
        key = "box " + m[0].lower()
        if key in boxes:
            found.append((m.start(), m.end(), "box", frozenset([key])))
    out, at, end = [], 0, -1
    whole = sorted((a, b) for a, b, shape, _ in found if shape.startswith("whole"))
    inside = [x for x in found if x[3] and (x[2].startswith("whole") or not any(a < x[1] and x[0] < b for a, b in whole))]
    for x in sorted(inside, key=lambda x: (x[0], -x[1])):
        while at < len(taken) and taken[at][1] <= x[0]:
            at += 1
        if x[0] >= end and (at == len(taken) or taken[at][0] >= x[1]):
            out.append(x)
            end = x[1]
    return out


@dataclass
class Potentials:
    """Logarithms of potentials; ``chain`` and ``skip`` by the labels at both ends."""

    shape: dict[str, list[float]] = field(default_factory=dict)
    chain: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))
    skip: np.ndarray = field(default_factory=lambda: np.eye(len(LABELS)) * 4.0)


#: No token outside the patterns is taken for data by its look alone: "none" leads by at least this much.
DOUBT = 1.0
#: Lead of the kind of a whole form before anything was counted.
SURE = 3.0
#: Messages that have not settled after a round for every node are halved with those before; graphs that swing on end after so many rounds for every node.
SWINGS = 20
PROVEN = 30.0


def marginals(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Beliefs (nodes x labels) by loopy sum-product; ``edges`` (k x 2), ``pair`` (k x labels x labels) in logarithms.

    Rounds go on until the messages settle, so certainty passes along chains of any length; exact where the edges form no loop.
    """
    n = len(unary)
    k = len(edges)
    if not k:
        b = unary - unary.max(axis=1, keepdims=True)
        return np.exp(b) / np.exp(b).sum(axis=1, keepdims=True)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(k, 2 * k), np.arange(k)])
    messages = np.zeros((2 * k, unary.shape[1]))
    for round_ in range(SWINGS * (n + 1)):
        total = unary.copy()
        np.add.at(total, target, messages)
        out = (total[source] - messages[back])[:, :, None] + table
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        if round_ > n:
            new = (new + messages) / 2
        done = np.abs(new - messages).max() < 1e-6
        messages = new
        if done:
            break
    total = unary.copy()
    np.add.at(total, target, messages)
    b = np.exp(total - total.max(axis=1, keepdims=True))
    return b / b.sum(axis=1, keepdims=True)


def all_spans(text: str, potentials: Potentials) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the field adds."""
    base = base_spans(text)
    extra = mentions(text, base) if _ANY(text) else []
    if not extra:
        return base, []
    nodes = [(a, b, kind, None, frozenset(_keys(kind, text[a:b]))) for kind, a, b in base]
    nodes += [(a, b, None, shape, keys) for a, b, shape, keys in extra]
    nodes.sort(key=lambda x: (x[0], x[1]))
    unary = np.zeros((len(nodes), len(LABELS)))
    for i, (_, _, kind, shape, _) in enumerate(nodes):
        if kind:
            unary[i, LABELS.index(kind)] = PROVEN
        else:
            whole = shape.startswith("whole")
            usual = [SURE * (shape == "whole " + label) for label in LABELS] if whole else [0.0] * len(LABELS)
            own = np.array(potentials.shape.get(shape, usual))
            if not whole:
                own[1:] = np.minimum(own[1:], own[0] - DOUBT)
            unary[i] = own
    edges = [(i, i + 1) for i in range(len(nodes) - 1)]
    kinds = [0] * len(edges)
    # mentions of one key: each to the one before it, and to the last proven one; linear in the mentions
    last: dict[str, int] = {}
    proven: dict[str, int] = {}
    for i, (_, _, kind, _, keys) in enumerate(nodes):
        for key in sorted(keys):
            for j in {last.get(key), proven.get(key)} - {None}:
                edges.append((j, i))
                kinds.append(1)
            if kind and key not in proven:
                for j in [j for j in (last.get(key),) if j is not None and not nodes[j][2]]:
                    edges.append((j, i))
                    kinds.append(1)
            last[key] = i
            if kind:
                proven[key] = i
    tables = np.stack([potentials.chain, potentials.skip])
    belief = marginals(unary, np.array(edges, int).reshape(-1, 2), tables[kinds])
    added = []
    for (a, b, kind, _, _), p in zip(nodes, belief):
        if not kind and p.argmax() and p.max() > 0.5:
            added.append((LABELS[p.argmax()], a, b))
    return base, added


def joined(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def fit(docs: DataFrame, text: str = "text") -> Potentials:
    """Potentials counted over all documents; a task gives one small table of counts.

    How often a shape is proven data of each kind, which kinds follow each other, and how often mentions of one key agree.
    """
    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column("t").to_pylist():
                base = base_spans(t)
                inside = {(a, b): k for k, a, b in base}
                numbers = [(m.start(), m.end(), f"number {min(sum(map(len, _GROUPS.findall(m[0]))), 20)}") for m in _NUMBER.finditer(t)]
                for start, end, shape in numbers + _whole_forms(t):
                    kind = next((k for (a, b), k in inside.items() if a <= start and end <= b), "none")
                    seen["shape", shape, kind] += 1
                order = [k for _, k in sorted(inside.items())]
                for x, y in zip(order, order[1:]):
                    seen["chain", x, y] += 1
                groups = defaultdict(list)
                for k, a, b in base:
                    for key in _keys(k, t[a:b]):
                        groups[key].append(k)
                for ks in groups.values():
                    for x, y in zip(ks, ks[1:]):
                        seen["skip", "same" if x == y else "other", ""] += 1
        rows = [(*k, v) for k, v in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 3 else pa.string()) for i in range(4)], ["what", "a", "b", "n"])

    counted = docs.select(F.coalesce(text, F.lit("")).alias("t")).mapInArrow(count, "what string, a string, b string, n long")
    # as many rows as there are kinds of shapes and pairs of labels
    rows = counted.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    out = Potentials()
    shapes: dict[str, Counter] = defaultdict(Counter)
    chain = np.ones((len(LABELS), len(LABELS)))
    same = other = 1.0
    for r in rows:
        if r["what"] == "shape":
            shapes[r["a"]][r["b"]] += r["n"]
        elif r["what"] == "chain":
            chain[LABELS.index(r["a"]), LABELS.index(r["b"])] += r["n"]
        else:
            same, other = same + r["n"] * (r["a"] == "same"), other + r["n"] * (r["a"] == "other")
    for shape, c in shapes.items():
        total = sum(c.values()) + 0.5 * len(LABELS)
        out.shape[shape] = [float(np.log((c[label] + 0.5) / total)) for label in LABELS]
    p = chain / chain.sum()
    lift = np.log(p / np.outer(p.sum(axis=1), p.sum(axis=0)))
    lift[0], lift[:, 0] = 0, 0
    out.chain = np.clip(lift, -0.5, 0.5)
    agree = float(np.clip(np.log(same / other), 3.0, 8.0))
    out.skip = np.full((len(LABELS), len(LABELS)), 0.0) + np.eye(len(LABELS)) * agree
    return out


def find_pii(docs: DataFrame, potentials: Potentials, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (kind, start, end, base) in the order of the base list, then start.

    ``base`` is true for what patterns and checks prove, false for what the field adds; added spans never overlap base ones.
    Whole texts are read; a null text counts as empty. Null and repeated ids, an empty table and
    other columns of any name are fine. Narrow: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(potentials)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                rows = []
                for t in batch.column("t").to_pylist():
                    base, added = all_spans(t, shared.value)
                    spans = sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                    rows.append([{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in spans])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], ["id", "spans"])

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    schema = f"id {own.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)
