"""SentencePiece encoding and decoding by a forward pass over a trie of marked words.

Spaces become a mark in front of each word, and no piece has a mark after another character, so
words are encoded apart. The distinct marked words of a batch are sorted and walked like a trie, depth
first; each prefix keeps its forward state (the best last piece), which all words below it share.

* Unigram models: the state is the best sum of scores, as in Viterbi's algorithm.
* BPE models: merges, not sums of scores, decide which segmentation is right. There the state is the one
  last piece that goes with the piece before it (``merge_pairs``), which gives the model's own result.

Characters outside the vocabulary fall back to one piece per UTF-8 byte.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import fresh
from textguard.llm.merge_pairs import PairTokens

MARK = "▁"
#: Entries of a worker's memory of words; when it is full, words that came once go.
MEMORY = 200_000
#: Texts are encoded in windows of about so many characters, cut at a space.
WINDOW = 1 << 20

WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """What a model file says: piece, score and kind of every id."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        probe = "ﬁ  Å x "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models that leave texts as they are, with a mark in front, are known")
        ids = range(sp.get_piece_size())
        self.names = [sp.id_to_piece(i) for i in ids]
        self.scores = [sp.get_score(i) for i in ids]
        byte = [sp.is_byte(i) for i in ids]
        self.plain = [not (b or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i, b in zip(ids, byte)]
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in ids if byte[i]}
        self.unknown = sp.unk_id()
        if any(MARK in n.lstrip(MARK) for n, p in zip(self.names, self.plain) if p):
            raise ValueError("a piece crosses words")
        # scores of a BPE model are the negative order of its merges
        steps = [s for s, p in zip(self.scores, self.plain) if p]
        self.bpe = all(float(s).is_integer() for s in steps)

    def bytes_of(self) -> list[bytes]:
        at = {i: bytes([b]) for b, i in self.byte_ids.items()}
        return [at.get(i, n.replace(MARK, " ").encode() if p else b"") for i, (n, p) in enumerate(zip(self.names, self.plain))]


class BestSums:
    """Forward pass of a unigram model over sorted words."""

    def __init__(self, scores: dict[str, float], missing: float):
        self.scores, self.missing = scores, missing
        self.longest = max(map(len, scores), default=1)

    def sweep(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Each word with the best segmentation; equal sums go to the longer last piece."""
        best, last, before = [0.0], [""], ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, piece = best[end - 1] + self.missing, word[end - 1]
                for start in range(end - 1, max(0, end - self.longest) - 1, -1):
                    score = self.scores.get(word[start:end])
                    if score is not None and best[start] + score >= top:
                        top, piece = best[start] + score, word[start:end]
                best.append(top)
                last.append(piece)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield word, out[::-1]
            before = word


class Encoder:
    """Packed ids (int32) of texts, with a bounded memory of words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.ids = {n: i for i, (n, p) in enumerate(zip(pieces.names, pieces.plain)) if p}
        if pieces.bpe:
            order = {n: -pieces.scores[i] for n, i in self.ids.items()}
            self.pairs = PairTokens(self.ids, lambda a, b: order.get(a + b))
            # no merge crosses two characters that no piece has next to each other
            self.adjacent = {n[i : i + 2] for n in self.ids for i in range(len(n) - 1)}
            self.own, self.sizes = [self.ids[n] for n in self.pairs.names], [len(n) for n in self.pairs.names]
        else:
            scores = {n: pieces.scores[i] for n, i in self.ids.items()}
            self.sums = BestSums(scores, min(scores.values()) - 10)
        self.of_word: dict[str, bytes | None] = {"": None}
        self.again: set[str] = set()
        self.of_part: dict[str, bytes] = {}
        self.of_marked: dict[str, bytes] = {}

    def _outside(self, char: str) -> list[int]:
        """The ids of a character that is not in the vocabulary."""
        bytes_ = self.pieces.byte_ids
        return [bytes_[b] for b in char.encode()] if bytes_ else [self.pieces.unknown]

    def _packed(self, names: list[str]) -> bytes:
        out: list[int] = []
        for n in names:
            out += [self.ids[n]] if n in self.ids else self._outside(n)
        return array("i", out).tobytes()

    def segment(self, marked: list[str]) -> Iterator[tuple[str, bytes]]:
        """The packed ids of each of the sorted marked words."""
        if not self.pieces.bpe:
            for word, names in self.sums.sweep(marked):
                yield word, self._packed(names)
            return
        ids, sizes = self.own, self.sizes
        for word, last, _ in self.pairs.sweep([w for w in marked if not w.startswith(MARK + MARK)]):
            out, end = [], len(word)
            while end:
                token = last[end]
                if token >= 0:
                    out.append(ids[token])
                    end -= sizes[token]
                else:
                    out += self._outside(word[end - 1])[::-1]
                    end -= 1
            out.reverse()
            yield word, array("i", out).tobytes()
        # runs of marks have merges of equal rank: plain merging, on the run and the word it touches
        for word in marked:
            if word.startswith(MARK + MARK):
                yield word, self._packed(self.pairs.merged(word))

    def _learn(self, marked: set[str]) -> None:
        self.of_marked.update(self.segment(sorted(marked.difference(self.of_marked))))

    def _parts(self, word: str) -> list[str]:
        """A marked word in parts that are encoded apart."""
        adjacent = self.adjacent
        cuts = [i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in adjacent]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def _learn_words(self, words: set[str]) -> None:
        new = words.difference(self.of_word)
        self.again |= words.difference(new)
        if not self.pieces.bpe:
            for word, packed in self.segment(sorted(MARK + w for w in new)):
                self.of_word[word[1:]] = packed
            return
        parts = {w: self._parts(MARK + w) for w in new}
        self.of_part.update(self.segment(sorted({p for ps in parts.values() for p in ps}.difference(self.of_part))))
        for w, ps in parts.items():
            self.of_word[w] = self.of_part[ps[0]] if len(ps) == 1 else b"".join(map(self.of_part.__getitem__, ps))

    def _forget(self) -> None:
        if len(self.of_word) > MEMORY:
            self.again.discard("")
            kept = self.again if len(self.again) <= MEMORY // 2 else ()
            self.of_word = {"": None, **{w: self.of_word[w] for w in kept}}
            self.again = set()
        if len(self.of_part) > MEMORY:
            self.of_part.clear()
        if len(self.of_marked) > MEMORY:
            self.of_marked.clear()

    def windows(self, text: str) -> Iterator[str]:
        """``text`` in parts that are encoded apart: a part ends before a space between two other characters, which the next part's mark stands for."""
        start = 0
        while len(text) - start > WINDOW:
            at = text.find(" ", start + WINDOW)
            while at > 0 and (text[at - 1] == " " or text[at + 1 : at + 2] in ("", " ")):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[start:at]
            start = at + 1
        yield text[start:]

    def encode(self, texts: list[str]) -> list[bytes]:
        self._forget()
        split = [[p.split(" ") for p in self.windows(t.replace(MARK, " "))] if t else [] for t in texts]
        self._learn_words(set().union(*(words for parts in split for words in parts)))
        out = []
        for parts in split:
            packed = []
            for words in parts:
                try:
                    packed.append(b"".join(map(self.of_word.__getitem__, words)))
                except TypeError:  # an empty word: two spaces in a row, or one at an end
                    marked = WORDS.findall(MARK + MARK.join(words))
                    self._learn(set(marked))
                    packed.append(b"".join(map(self.of_marked.__getitem__, marked)))
            out.append(b"".join(packed))
        return out


@cache
def _encoder(model: bytes) -> Encoder:
    return Encoder(Pieces(model))


@cache
def _table(model: bytes) -> list[bytes]:
    return Pieces(model).bytes_of()


def read_model(path: str) -> bytes:
    """The model file, read once on the driver; it is below a MB and goes to the executors by broadcast."""
    with open(path, "rb") as f:
        return f.read()


#: Texts whose words are learnt together.
BATCH = 1024


def encode(docs: DataFrame, model: str, text: str = "text", into: str = "piece_ids") -> DataFrame:
    """``docs`` with ``text`` replaced by ``into``, the ids of its pieces (array<int>); other columns stay as they are.

    No begin or end pieces. A null or empty text has no pieces. A mark (U+2581) in a text counts as a
    space. Null, repeated or clashing values in other columns do not matter; ``into`` replaces a column of that name.
    Narrow: no shuffle; a worker remembers a bounded number of words.
    """
    keep, own_text = [c for c in docs.columns if c not in (text, into)], fresh(docs, "text_")
    proto = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches):
        encoder = _encoder(proto.value)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                packed = encoder.encode(batch.column(own_text).to_pylist())
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], names=[*keep, into])

    own = docs.select(*keep, F.coalesce(text, F.lit("")).alias(own_text))
    return own.mapInArrow(run, own.drop(own_text).withColumn(into, F.lit(None).cast("array<int>")).schema)


def decode(rows: DataFrame, model: str, ids: str = "piece_ids", into: str = "text") -> DataFrame:
    """``rows`` with ``ids`` replaced by the text they stand for in ``into``; other columns stay.

    The inverse of ``encode`` but for marks in the text, which come back as spaces. Null ids give an empty
    text; ids of control pieces give nothing; bytes that are not UTF-8 give U+FFFD.
    """
    keep, own_ids = [c for c in rows.columns if c not in (ids, into)], fresh(rows, "ids_")
    proto = rows.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches):
        table = _table(proto.value)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                lists = batch.column(own_ids)
                ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                texts = []
                for a, b in zip(ends[:-1], ends[1:]):
                    raw = b"".join(map(table.__getitem__, values[a:b].tolist()))
                    texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, into])

    own = rows.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias(own_ids))
    return own.mapInArrow(run, own.drop(own_ids).withColumn(into, F.lit(None).cast("string")).schema)
