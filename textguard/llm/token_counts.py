"""Exact token counts of byte-level BPE at every prefix of a text.

The pieces that the vocabulary's pattern cuts a text into are encoded by prefix dynamic programming
(``merge_pairs``), which leaves the exact count of every prefix of every piece. Sums over pieces answer
how many tokens a text has, how many a prefix has, and how much of it fits a budget, without
encoding anything again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.merge_pairs import PairTokens

# White space as Unicode has it, and the cut of byte-level BPE vocabularies into pieces.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

blank = regex.compile(f"[{WHITE}]").match

#: Entries of a worker's memory of words; when it is full it starts anew.
MEMORY = 300_000
#: Texts are worked on in windows of about so many characters, cut where a piece begins.
WINDOW = 1 << 20
BUDGET = 1024


@cache
def _letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


#: Longer pieces are not remembered.
LONG = 64


class Counter:
    """Counts for the vocabulary in ``spec``, the text of a tokenizers JSON file (byte-level BPE)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE vocabularies are known")
        byte = _letters()
        units = {t: "".join(chr(byte[c]) for c in t) for t in model["vocab"] if all(c in byte for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = {(units[a], units[b]): i for i, (a, b) in enumerate(merges)}
        self.pairs = PairTokens(units.values(), lambda a, b: ranks.get((a, b)))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.find = regex.compile(PIECES).findall
        self.of_piece: dict[str, int] = {}
        self.of_word: dict[str, int | None] = {}

    def _learn_pieces(self, pieces: set[str]) -> None:
        new = {p.encode().decode("latin-1"): p for p in pieces.difference(self.of_piece)}
        for units, _, count in self.pairs.sweep(sorted(new)):
            self.of_piece[new[units]] = count[-1]

    def _learn_words(self, words: set[str]) -> None:
        """Counts of words that follow a space; None for a word that may share a piece with its neighbours."""
        new = words.difference(self.of_word)
        cut = {w: self.find(" " + w) for w in new if w and not w[0].isspace() and not w[-1].isspace()}
        self._learn_pieces({p for ps in cut.values() for p in ps})
        for w in new:
            self.of_word[w] = sum(map(self.of_piece.__getitem__, cut[w])) if w in cut else None

    def _plain(self, text: str) -> int:
        pieces = self.find(text)
        self._learn_pieces(set(pieces))
        return sum(map(self.of_piece.__getitem__, pieces))

    def windows(self, text: str) -> Iterator[str]:
        """``text`` in parts whose counts add up: a part begins at a space between two other characters."""
        start = 0
        while len(text) - start > WINDOW:
            at = text.find(" ", start + WINDOW)
            while at > 0 and (at + 1 == len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[start:at]
            start = at
        yield text[start:]

    def _forget(self) -> None:
        if len(self.of_piece) > MEMORY or len(self.of_word) > MEMORY:
            self.of_piece.clear()
            self.of_word.clear()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings count as one token each."""
        self._forget()
        marked = [any(s in t for s in self.special) for t in texts]
        words = [None if m or len(t) > WINDOW else t.split(" ") for t, m in zip(texts, marked)]
        self._learn_words(set().union(*(ws[1:] for ws in words if ws)))
        out = []
        for text, ws, special in zip(texts, words, marked):
            if special:
                segments = self.cut_special.split(text)
                out.append(len(segments) - 1 + sum(self.count(segments)))
            elif ws is None:
                out.append(sum(self.count([part])[0] if len(part) <= WINDOW else self._plain(part) for part in self.windows(text)))
            else:
                try:
                    if ws[0] and ws[0][-1].isspace():
                        raise TypeError
                    out.append(sum(map(self.of_word.__getitem__, ws[1:]), self._plain(ws[0])))
                except (TypeError, KeyError):
                    out.append(self._plain(text))
        return out

    def prefixes(self, text: str) -> list[int]:
        """The token count of every prefix of ``text`` by code points, from the empty prefix on; one forward pass, nothing is encoded again."""
        self._forget()
        out, start = [0], 0
        marks = [(m.start(), m.end()) for m in self.cut_special.finditer(text)] + [(len(text), len(text))]
        for begin, end in marks:
            base = out[-1]
            out += [base + n for n in self._segment(text[start:begin])[1:]]
            if end > begin:
                # inside a special string its characters are plain text; only the whole of it is special
                inside = self._segment(text[start : end - 1])[begin - start + 1 :]
                out += [base + n for n in inside] + [out[-1] + 1]
            start = end
        return out

    def _segment(self, text: str) -> list[int]:
        out, base = [0], 0
        counts_of_run, run = (0,), 0  # of the white space that a prefix ends in, and where it begins
        run_base, at = 0, 0
        for piece in self.find(text):
            counts = self._inside(piece)
            for k, char in enumerate(piece, 1):
                end = at + k
                if not blank(char):
                    out.append(base + counts[k])
                    continue
                if k == 1 and (at == 0 or not blank(text[at - 1])):
                    run, run_base, stop = at, base, end
                    while stop < len(text) and blank(text[stop]):
                        stop += 1
                    counts_of_run = self._inside(text[run:stop])
                # a prefix that ends in white space has all of that run as its last piece
                out.append(run_base + counts_of_run[end - run])
            base += counts[-1]
            at += len(piece)
        return out

    def _inside(self, piece: str) -> tuple[int, ...]:
        """Counts of the prefixes of one piece; a contraction that is not whole is two pieces."""
        return _piece_prefixes(self, piece) if len(piece) <= LONG else _prefixes_of(self, piece)

    def fitting(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        counts = self.prefixes(text)
        return max(i for i, n in enumerate(counts) if n <= budget)


@lru_cache(100_000)
def _piece_prefixes(counter: Counter, piece: str) -> tuple[int, ...]:
    return _prefixes_of(counter, piece)


def _prefixes_of(counter: Counter, piece: str) -> tuple[int, ...]:
    units = piece.encode().decode("latin-1")
    for _, _, count in counter.pairs.sweep([units]):
        ends = [0, *accumulate(len(c.encode()) for c in piece)]
        out = [count[e] for e in ends]
    if piece in ("'re", "'ve", "'ll"):
        out[2] = sum(counter._plain(p) for p in piece[:2])
    return tuple(out)


@cache
def _counter(spec: str) -> Counter:
    return Counter(spec)


def read_spec(path: str) -> str:
    """The vocabulary file, read once on the driver; it is a few MB and goes to the executors by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8) and ``n_tokens`` (both long) of the whole text.

    ``vocabulary`` is the path of a tokenizers JSON file. No tokens are added, and special strings inside a
    text count as one token. A null text counts as empty (0 and 0). Null and repeated ids, an empty table and other columns of any
    name are fine: only the two columns are read. Narrow: no shuffle; a worker remembers a bounded number of words.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches):
        counter = _counter(spec.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                n = counter.count(batch.column("t").to_pylist())
                size = pc.cast(pc.binary_length(pc.cast(batch.column("t"), pa.large_string())), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(id_col), size, pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    own = docs.select(id_col, F.coalesce(text, F.lit("")).alias("t"))
    kind = own.schema[id_col].dataType.simpleString()
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def prefix_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, and in ``counts`` the exact token count of every prefix by code points, from the empty one on (array<int>).

    A null text counts as empty and has the one count 0. Null and repeated ids, an empty table and other columns of any name are fine.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches):
        counter = _counter(spec.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                counts = pa.array([counter.prefixes(row.column("t")[0].as_py())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([row.column(id_col), counts], [id_col, "counts"])

    own = docs.select(id_col, F.coalesce(text, F.lit("")).alias("t"))
    return own.mapInArrow(run, f"`{id_col}` {own.schema[id_col].dataType.simpleString()}, counts array<int>")


def fits_budget(counts: str = "counts", budget: int = BUDGET):
    """Code points of the longest prefix within the budget, from the stored counts."""
    ok = F.transform(F.col(counts), lambda n, i: F.when(n <= budget, i))
    return F.array_max(ok)
