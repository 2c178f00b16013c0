"""Collocations: phrases of 2 to 5 words that occur together far more often than their parts would by chance.

Texts are tokenised once into blocks: the words of many texts of one language as numbers into a small word list of the block.
Then, level by level:

1. *Candidates.* A phrase can only be frequent if its parts are, and if the bucket that it hashes into is. So a phrase of k words is
   hashed where a phrase of k - 1 words that may be frequent is followed by a frequent word, and by such a phrase from the next word on.
   Blocks send the places of their buckets, not phrases; buckets are summed range by range, and the full ones come
   back as a bitmap of bounded size. Phrases in full buckets are candidates: a superset of the frequent ones.
2. *Counts.* Frequent words have numbers, which are broadcast. A task counts the candidates in its own blocks as rows of these numbers and sends them
   by the range of their bucket; ranges are summed. The same pass hashes the phrases with one word more, so a level is one pass over the blocks,
   however many candidates it has.

*Tries* count where the frequent words are too many for a broadcast. Candidates of all tasks go into double-array tries of bounded size, which
are broadcast one after the other. A task moves the states of all positions of a block at once, word by word, and counts the accepting states; the
counts of all blocks are summed. Every trie is a pass over the blocks.

The scores are joins of these counts with those of the phrases' parts, in exact decimals.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import join_groups, stored, text_of

LONGEST = 5
SUPPORT = 100
TOP = 2000
UNKNOWN = "und"
#: Words of a block, and words that a task keeps in open blocks at most (one text more).
BLOCK = 1 << 18
OPEN = 1 << 21
#: Frequent words that are broadcast with their numbers at most (some 30 bytes each); beyond, tries count.
WORDS = 1 << 22
#: Places of phrases that a task holds, roughly, before it sums them up.
HELD = 1 << 19
#: Candidates of a trie: bounds what the driver holds and broadcasts at a time (some 30 MB).
TRIE = 300_000
#: Buckets of a range at most (one array of counts in a task), ranges at least, and bits of a broadcast bitmap at most (16 MB).
RANGE = 1 << 24
RANGES = 256
BITS = 1 << 27
#: Candidates that a task holds at most, and a block's.
GIVEN = 500_000
#: Phrases of a trie whose counts of a task are one row.
SLICE = 1 << 12
#: Rows that one task ranks, roughly, before the ranks of a language are merged.
RANKED = 50_000

_FOLD = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\v\f\r", bytes(range(97, 123)) + b"." * 9)


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case, with b"." between pieces."""
    return text.encode("utf-8", "replace").translate(_FOLD).replace(b".", b" . ").split()


def _blocks(docs: DataFrame) -> DataFrame:
    """lang, words (distinct ones), counts (of each), codes (1 + place in ``words``, 0 between pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        number: dict[str, defaultdict] = {}
        size: dict[str, int] = defaultdict(int)

        def close(lang: str) -> pa.RecordBatch:
            known = [w for w in number.pop(lang) if w != b"."]
            codes = np.concatenate(held.pop(lang))
            size.pop(lang)
            counts = np.bincount(codes, minlength=len(known) + 1)[1:]
            codes = _packed(codes, len(known))
            lists = [
                pa.ListArray.from_arrays([0, len(known)], pa.array(known, pa.binary()).cast(pa.string())),
                pa.ListArray.from_arrays([0, len(known)], pa.array(counts, pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), *lists, pa.array([codes], pa.binary())],
                ["lang", "words", "counts", "codes"],
            )

        for batch in batches:
            for text, lang in zip(batch.column("t").to_pylist(), batch.column("lang").to_pylist()):
                if lang not in number:
                    number[lang] = defaultdict(itertools.count().__next__, {})
                    number[lang][b"."]
                words = words_of(text)
                held[lang].append(np.fromiter(map(number[lang].__getitem__, [*words, b"."]), np.int32, len(words) + 1))
                size[lang] += len(words) + 1
                if size[lang] > BLOCK:
                    yield close(lang)
                elif sum(size.values()) > OPEN:
                    yield from [close(each) for each in list(size)]
        yield from [close(each) for each in list(size)]

    return docs.mapInArrow(run, "lang string, words array<string>, counts array<long>, codes binary")


def _hash(lang: str, words: list[str]) -> np.ndarray:
    """64 bits for every word of a language."""
    start = hashlib.blake2b(f"{lang}\0".encode(), digest_size=8)

    def one(word: str) -> int:
        h = start.copy()
        h.update(word.encode())
        return int.from_bytes(h.digest(), "little")

    return np.fromiter(map(one, words), np.uint64, len(words))


def _extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases with one word more."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Buckets:
    """How hashes fall into buckets: a power of two of them, dealt out over ranges by their lowest bits."""

    size: int
    ranges: int

    @staticmethod
    def of(words: int) -> Buckets:
        """About a bucket for every word, so that few are full that hold no frequent phrase."""
        size = 1 << max(16, int(words).bit_length())
        return Buckets(size, max(RANGES, size // RANGE))

    @property
    def bits(self) -> int:
        """Bits of a range's part of the bitmap; places beyond share them."""
        return max(8, min(self.size, BITS) // self.ranges)

    def split(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = h & np.uint64(self.size - 1)
        return (bucket & np.uint64(self.ranges - 1)).astype(np.int64), (bucket // np.uint64(self.ranges)).astype(np.int64)

    def rows(self, h: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """(range, places, counts) of all buckets that occur, as bytes that compress well: differences, lowest bytes first."""
        of, place = self.split(h)
        code, n = np.unique(of * (self.size // self.ranges) + place, return_counts=True)
        of, place = np.divmod(code, self.size // self.ranges)
        n = np.minimum(n, 0xFFFFFFFF).astype(np.uint32)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
            yield int(of[a]), _bytes_apart(np.diff(place[a:b], prepend=0).astype(np.uint32)), _bytes_apart(n[a:b])

    def full(self, rows: DataFrame, support: int) -> np.ndarray:
        """The bitmap of the buckets with enough support: a row of bits for every range."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, np.zeros(0, np.int64)

            def close():
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([self.bitmap(total, support)], pa.binary())], ["range", "hot"])

            for r in _each(batches):
                if r["range"] != now:
                    if now is not None:
                        yield close()
                    now, total = r["range"], self.empty()
                self.add(total, r)
            if now is not None:
                yield close()

        dealt = rows.repartition("range").sortWithinPartitions("range")
        return self.gathered(dealt.mapInArrow(run, "range long, hot binary"))

    def empty(self) -> np.ndarray:
        """A range's counts."""
        return np.zeros(self.size // self.ranges, np.int64)

    def add(self, total: np.ndarray, row: dict) -> None:
        """Adds a row of ``rows`` to its range's counts."""
        total[np.cumsum(_bytes_together(row["places"]))] += _bytes_together(row["counts"])

    def bitmap(self, total: np.ndarray, support: int) -> bytes:
        """A range's part of the bitmap."""
        hot = np.zeros(self.bits, bool)
        hot[np.flatnonzero(total >= support) % self.bits] = True
        return np.packbits(hot).tobytes()

    def gathered(self, parts: DataFrame) -> np.ndarray:
        """The bitmap from its parts (range, hot)."""
        out = np.zeros((self.ranges, max(1, self.bits // 8)), np.uint8)
        # BITS bits at most
        for r in parts.collect():
            out[r["range"]] = np.frombuffer(r["hot"], np.uint8)
        return out

    def among(self, h: np.ndarray, hot: np.ndarray) -> np.ndarray:
        of, place = self.split(h)
        place %= self.bits
        return (hot[of, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, one at a time; none is held while the next batch is read."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for row in range(batch.num_rows):
            yield {name: c[row].as_py() for name, c in columns.items()}
        del batch, columns


def _bytes_apart(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()


def _bytes_together(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _word_buckets(frequent: DataFrame, buckets: Buckets) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_lang: dict[str, list[str]] = defaultdict(list)
            for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist()):
                of_lang[lang].append(word)
            for lang, words in of_lang.items():
                yield _range_batch(list(buckets.rows(_hash(lang, words))))

    return frequent.select("lang", "word").mapInArrow(run, "range long, places binary, counts binary")


def _range_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    of, places, counts = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], ["range", "places", "counts"])


def _kept(codes: np.ndarray, places: np.ndarray, words: int) -> bytes:
    """The codes of a block of so many words if its list is cut down to those at ``places``; a 0 stands for all that is between."""
    new = np.zeros(words + 1, np.int32)
    new[places + 1] = np.arange(1, len(places) + 1)
    codes = new[codes]
    # several gaps in a row are one
    return _packed(codes[(codes > 0) | np.concatenate([[True], codes[:-1] > 0])], len(places))


def _frequent_only(blocks: DataFrame, buckets: Buckets, hot: np.ndarray) -> DataFrame:
    """Blocks (lang, words, codes) without the words that are surely rare; a 0 stands for all that is between."""
    shared = blocks.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes in _rows(batches):
            places = np.flatnonzero(buckets.among(_hash(lang, words), shared.value))
            kept = pa.array([words[i] for i in places], pa.string())
            codes = _kept(codes, places, len(words))
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.ListArray.from_arrays([0, len(kept)], kept), pa.array([codes], pa.binary())], ["lang", "words", "codes"])

    return blocks.select("lang", "words", "codes").mapInArrow(run, "lang string, words array<string>, codes binary")


def _packed(codes: np.ndarray, words: int) -> bytes:
    return codes.astype(np.uint16 if words < 1 << 16 else np.uint32).tobytes()


def _unpacked(codes: pa.Scalar, words: int) -> np.ndarray:
    return np.frombuffer(codes.as_buffer(), np.uint16 if words < 1 << 16 else np.uint32).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], np.ndarray]]:
    """lang, words and codes of blocks."""
    for batch in batches:
        for row in range(batch.num_rows):
            words = batch.column("words")[row].as_py()
            yield batch.column("lang")[row].as_py(), words, _unpacked(batch.column("codes")[row], len(words))


@dataclass
class Trie:
    """A double-array trie whose letters are (language, word): state s goes with letter x to t = base[g] + x if check[t] is g.

    A state has a group g of its own for every 2 or so of its letters (``first[s] + (x & mask[s])``), so that states with very many letters find
    room, too. The state alone would not tell t: with another letter of it, another base may lead there.
    """

    letters: dict[str, dict[str, int]]
    first: np.ndarray
    mask: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    phrases: list[str]


def build_trie(langs: list[str], phrases: list[str]) -> Trie:
    """The trie of phrases of equally many words; phrases that begin alike share states."""
    letters: dict[str, dict[str, int]] = defaultdict(dict)
    number = itertools.count(1)
    rows = []
    for lang, phrase in zip(langs, phrases):
        known, row = letters[lang], []
        for w in phrase.split(" "):
            if w not in known:
                known[w] = next(number)
            row.append(known[w])
        rows.append(row)
    x = np.array(rows, np.int64)
    top = next(number)
    # the first letter is the first state
    levels, state = [], x[:, 0]
    for k in range(1, x.shape[1]):
        pairs, state = np.unique(np.stack([state, x[:, k]], axis=1), axis=0, return_inverse=True)
        levels.append(pairs)
    size = 2 * top + 3 * sum(map(len, levels)) + 1024
    first, mask, check = (np.zeros(size, np.int64) for _ in range(3))
    # the slots of first states are taken
    check[:top] = -1
    slots, bases, rng = np.arange(top), [np.zeros(1, np.int64)], np.random.default_rng(5)
    for pairs in levels:
        parents, letter = slots[pairs[:, 0]], pairs[:, 1]
        some, fan = np.unique(parents, return_counts=True)
        width = 1 << np.ceil(np.log2(np.maximum(fan / 2, 1))).astype(np.int64)
        mask[some] = width - 1
        first[some] = sum(map(len, bases)) + np.cumsum(width) - width
        group = first[parents] + (letter & mask[parents])
        found, slots = _place(letter, group, sum(map(len, bases)), int(width.sum()), check, top, rng)
        bases.append(found)
    accept = np.full(size, -1, np.int64)
    accept[slots[state.ravel()]] = np.arange(len(phrases))
    return Trie(dict(letters), first, mask, np.concatenate(bases), check, accept, phrases)


def _place(letter: np.ndarray, numbers: np.ndarray, start: int, groups: int, check: np.ndarray, top: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """A base for every group of letters (numbered from ``start``) at which all their slots are free, and the slots. Groups without room try again elsewhere."""
    group = numbers - start
    found, left = np.zeros(groups, np.int64), np.arange(len(group))
    while len(left):
        there = np.unique(group[left])
        found[there] = rng.integers(0, len(check) - top, len(there))
        slots = found[group[left]] + letter[left]
        alone = np.zeros(len(left), bool)
        alone[np.unique(slots, return_index=True)[1]] = True
        bad = np.zeros(len(found), bool)
        bad[group[left][~alone | (check[slots] != 0)]] = True
        good = ~bad[group[left]]
        check[slots[good]] = numbers[left[good]]
        left = left[~good]
    return found, found[group] + letter


def advance(trie: Trie, ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a phrase of the trie begins, and the phrase: all positions move one word at a time."""
    at = np.flatnonzero(ids[: max(0, len(ids) - words + 1)])
    state = ids[at]
    for k in range(1, words):
        letter = ids[at + k]
        group = trie.first[state] + (letter & trie.mask[state])
        to = trie.base[group] + letter
        on = (letter > 0) & (trie.check[to] == group)
        at, state = at[on], to[on]
    return at, trie.accept[state]


@dataclass
class _Step:
    """What a pass over blocks needs: the trie of phrases of ``words`` words (none: single words), whether it holds all of them, their languages."""

    words: int
    trie: Trie | None
    whole: bool
    langs: list[str]

    def begin(self, lang: str, known: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Where phrases begin, which they are, and their list."""
        if self.trie is None:
            at = np.flatnonzero(codes)
            return at, codes[at] - 1, known
        letters = self.trie.letters.get(lang, {})
        at, of = advance(self.trie, np.array([0, *[letters.get(w, 0) for w in known]], np.int64)[codes], self.words)
        return at, of, self.trie.phrases

    def longer(self, lang: str, known: list[str], codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places have a frequent word behind the phrase, and a frequent phrase from the next word on; the hashes of phrases and word."""
        starts = np.zeros(len(codes) + 1, bool)
        starts[at] = True
        end = at + self.words
        on = np.flatnonzero((end < len(codes)) & (starts[at + 1] if self.whole else True))
        on = on[codes[end[on]] > 0]
        of_word = np.concatenate([[0], _hash(lang, known)]).astype(np.uint64)
        h = of_word[codes[at[on]]]
        for k in range(1, self.words + 1):
            h = _extended(h, of_word[codes[at[on] + k]])
        return on, h


def _counted(blocks: DataFrame, step: _Step, buckets: Buckets | None) -> DataFrame:
    """(slice, places, counts) of the trie's phrases in all blocks of a task, a row for each ``SLICE`` of them, and (range, places, counts) of every
    block's buckets of phrases with one word more."""
    shared = blocks.sparkSession.sparkContext.broadcast(step)
    names = ["slice", "range", "places", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value.trie
        total = np.zeros(len(trie.phrases) if trie else 0, np.int64)
        with np.errstate(over="ignore"):
            for lang, known, codes in _rows(batches):
                at, of, _ = shared.value.begin(lang, known, codes)
                if trie:
                    total += np.bincount(of, minlength=len(total))
                if buckets:
                    rows = _range_batch(list(buckets.rows(shared.value.longer(lang, known, codes, at)[1])))
                    yield pa.RecordBatch.from_arrays([pa.nulls(rows.num_rows, pa.int64()), *rows.columns], names)
        there = np.flatnonzero(total)
        of, place = np.divmod(there, SLICE)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
            row = [pa.array([of[a]], pa.int64()), pa.nulls(1, pa.int64())]
            row += [pa.array([x.tobytes()], pa.binary()) for x in (place[a:b].astype(np.uint16), total[there[a:b]])]
            yield pa.RecordBatch.from_arrays(row, names)

    return blocks.mapInArrow(run, "slice long, range long, places binary, counts binary")


def _summed(rows: DataFrame, step: _Step, support: int) -> DataFrame:
    """(lang, phrase, f) of the trie's phrases that all tasks together have often enough."""
    shared = rows.sparkSession.sparkContext.broadcast((step.langs, step.trie.phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, phrases = shared.value
        now, total = None, np.zeros(SLICE, np.int64)

        def close() -> pa.RecordBatch:
            often = np.flatnonzero(total >= support)
            some = (now * SLICE + often).tolist()
            return pa.RecordBatch.from_arrays([pa.array([langs[i] for i in some], pa.string()), pa.array([phrases[i] for i in some], pa.string()), pa.array(total[often])], ["lang", "phrase", "f"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["slice"] != now:
                    if now is not None:
                        yield close()
                    now, total = r["slice"], np.zeros(SLICE, np.int64)
                total[np.frombuffer(r["places"], np.uint16)] += np.frombuffer(r["counts"], np.int64)
        if now is not None:
            yield close()

    dealt = rows.where("slice IS NOT NULL").select("slice", "places", "counts").repartition("slice").sortWithinPartitions("slice")
    return dealt.mapInArrow(run, "lang string, phrase string, f long")


def _candidates(blocks: DataFrame, step: _Step, buckets: Buckets, hot: np.ndarray) -> DataFrame:
    """(range, lang, phrases) of phrases with one word more in full buckets: a row for each range and language of a task, or for so many phrases.

    A phrase lies in the range of its bucket, whichever task has it.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((step, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, hot = shared.value
        held: dict[tuple[int, str], set[str]] = defaultdict(set)
        size = 0

        def given() -> pa.RecordBatch:
            of, langs = zip(*held) if held else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(langs, pa.string()), pa.array(map(list, held.values()), pa.list_(pa.string()))], ["range", "lang", "phrases"])

        with np.errstate(over="ignore"):
            for lang, known, codes in _rows(batches):
                at, of, phrases = step.begin(lang, known, codes)
                on, h = step.longer(lang, known, codes, at)
                full = buckets.among(h, hot)
                on, ranges = on[full], buckets.split(h[full])[0]
                code, first = np.unique(of[on] * (len(known) + 1) + codes[at[on] + step.words], return_index=True)
                heads, tails = np.divmod(code, len(known) + 1)
                for i, j, r in zip(heads.tolist(), tails.tolist(), ranges[first].tolist()):
                    held[r, lang].add(f"{phrases[i]} {known[j - 1]}")
                size += len(code)
                # counted again, as most have been there before
                if size > GIVEN and (size := sum(map(len, held.values()))) > GIVEN:
                    yield given()
                    held.clear()
                    size = 0
        yield given()

    return blocks.mapInArrow(run, "range long, lang string, phrases array<string>")


def _distinct(found: DataFrame) -> DataFrame:
    """(lang, phrase): each phrase of ``_candidates`` once. A range holds few of them, as it has few full buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, defaultdict(set)

        def close() -> Iterator[pa.RecordBatch]:
            for lang, phrases in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(list(phrases), pa.string())], ["lang", "phrase"])

        for batch in batches:
            for row in range(batch.num_rows):
                if (of := batch.column("range")[row].as_py()) != now:
                    yield from close()
                    now, held = of, defaultdict(set)
                held[batch.column("lang")[row].as_py()].update(batch.column("phrases")[row].as_py())
        yield from close()

    return found.repartition("range").sortWithinPartitions("range").mapInArrow(run, "lang string, phrase string")


def _tries(phrases: DataFrame, words: int, trie: int) -> Iterator[_Step]:
    """Tries of about ``trie`` phrases, one after the other."""
    parts = -(-phrases.count() // trie)
    dealt = phrases.select("lang", "phrase", F.pmod(F.xxhash64("lang", "phrase"), F.lit(max(1, parts))).alias("part"))
    for part in range(parts):
        mine = dealt.where(F.col("part") == part).select("lang", "phrase").toArrow()
        if mine.num_rows:
            langs = mine.column("lang").to_pylist()
            yield _Step(words, build_trie(langs, mine.column("phrase").to_pylist()), parts == 1, langs)


def _by_tries(blocks: DataFrame, frequent: DataFrame, buckets: Buckets, support: int, longest: int, trie: int) -> list[DataFrame]:
    """(lang, phrase, words, f) of the frequent phrases of 2 words, of 3 and so on, counted by tries."""
    counts = []
    blocks = stored(_frequent_only(blocks, buckets, buckets.full(_word_buckets(frequent, buckets), 1)))
    steps, rows = [_Step(1, None, True, [])], _counted(blocks, _Step(1, None, True, []), buckets)
    for k in range(2, longest + 1):
        hot = buckets.full(rows.where("range IS NOT NULL").select("range", "places", "counts"), support)
        found = reduce(DataFrame.unionByName, [_candidates(blocks, step, buckets, hot) for step in steps])
        found = stored(_distinct(found))
        last, seen, steps = k == longest, [], []
        for step in _tries(found, k, trie):
            seen.append(stored(_counted(blocks, step, None if last else buckets)))
            steps.append(step)
        if not seen:
            break
        rows = reduce(DataFrame.unionByName, seen)
        f = reduce(DataFrame.unionByName, [_summed(mine, step, support) for mine, step in zip(seen, steps)])
        counts.append(stored(f.select("lang", "phrase", F.lit(k).alias("words"), "f")))
    return counts


def _keys(lang: str, words: pa.Array, salt: int) -> np.ndarray:
    """64 bits for every word of a language, in one go."""
    key = hashlib.blake2b(f"{salt}\0{lang}".encode(), digest_size=8).hexdigest()
    return pd.util.hash_array(np.array(words.to_pylist(), object), hash_key=key, categorize=False)


@dataclass
class Vocabulary:
    """The frequent words of all languages, numbered from 1 on, the most frequent ones first. ``keys`` are sorted hashes, all different."""

    words: pa.Array
    langs: dict[str, int]
    of: np.ndarray
    salt: int
    keys: np.ndarray
    number: np.ndarray

    @staticmethod
    def make(frequent: pa.Table) -> Vocabulary:
        order = np.argsort(-frequent.column("f").to_numpy(), kind="stable")
        words = frequent.column("word").combine_chunks().cast(pa.string()).take(pa.array(order))
        coded = frequent.column("lang").combine_chunks().dictionary_encode()
        langs, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()[order]
        by_lang = np.argsort(of, kind="stable")
        parts = np.split(by_lang, np.cumsum(np.bincount(of, minlength=len(langs)))[:-1]) if langs else []
        for salt in itertools.count():
            keys = np.zeros(len(words), np.uint64)
            for lang, part in zip(langs, parts):
                keys[part] = _keys(lang, words.take(pa.array(part)), salt)
            number = np.argsort(keys)
            keys = keys[number]
            if (keys[1:] != keys[:-1]).all():
                return Vocabulary(words, {lang: i for i, lang in enumerate(langs)}, of, salt, keys, number + 1)

    def numbers(self, lang: str, words: pa.Array) -> np.ndarray:
        """The numbers of a language's words; 0 for rare ones."""
        out = np.zeros(len(words), np.int64)
        if lang not in self.langs or not len(words):
            return out
        keys = _keys(lang, words, self.salt)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        # a hash is a hint
        likely = np.flatnonzero(self.keys[at] == keys)
        found = self.number[at[likely]]
        same = pc.equal(self.words.take(pa.array(found - 1)), words.take(pa.array(likely))).to_numpy(zero_copy_only=False)
        out[likely] = np.where(same & (self.of[found - 1] == self.langs[lang]), found, 0)
        return out

    def phrases(self, columns: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The languages and the phrases of rows of numbers."""
        langs = pa.array(list(self.langs), pa.string()).take(pa.array(self.of[columns[0] - 1]))
        return langs, pc.binary_join_element_wise(*[self.words.take(pa.array(c - 1)) for c in columns], " ")


def _numbered(blocks: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(numbers, codes) of blocks without their rare words: the number of each word of the block, and 1 + its place in this list, a 0 for all that is between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column("words")[row].values
                number = vocabulary.value.numbers(batch.column("lang")[row].as_py(), words)
                places = np.flatnonzero(number)
                codes = _kept(_unpacked(batch.column("codes")[row], len(words)), places, len(words))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (number[places].astype(np.uint32).tobytes(), codes)], ["numbers", "codes"])

    return blocks.select("lang", "words", "codes").mapInArrow(run, "numbers binary, codes binary")


def _mixed(number: np.ndarray) -> np.ndarray:
    """64 bits for every number."""
    x = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _one_more(bits: np.ndarray, at: np.ndarray, h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places of phrases that another one follows from the next word on, and the hashes of phrases that are a word longer, ``words`` words now."""
    there = np.zeros(len(bits) + 1, bool)
    there[at] = True
    on = there[at + 1]
    at = at[on]
    return at, _extended(h[on], bits[at + words - 1])


@dataclass
class _Sums:
    """Phrases of equally many words, as columns of numbers, and their counts, summed beyond ``held`` of them or twice as many as there were left."""

    words: int
    held: int

    def __post_init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.limit = 0

    def add(self, h: np.ndarray, columns: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((h, columns, n))
        self.size += len(h)
        if self.size > max(self.held, self.limit):
            self.parts = [self.given()]
            self.size = len(self.parts[0][0])
            self.limit = 2 * self.size

    def given(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, columns and counts of all phrases, each once."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros((self.words, 0), np.uint32), np.zeros(0, np.int64)
        h, columns, n = (np.concatenate(x, axis=-1) for x in zip(*self.parts))
        order = np.argsort(h)
        new = _starts(h[None, order])
        if not np.array_equal(new, _starts(columns[:, order])):
            # phrases that share a hash
            order = np.lexsort(columns)
            new = _starts(columns[:, order])
        firsts = order[new]
        return h[firsts], columns[:, firsts], np.add.reduceat(n[order], new) if len(new) else n


def _starts(columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    differ = np.ones(columns.shape[1], bool)
    differ[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    return np.flatnonzero(differ)


def _cells(buckets: Buckets, h: np.ndarray, columns: np.ndarray, n: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Ranges, and their phrases and counts as bytes that compress well."""
    of = buckets.split(h)[0]
    order = np.argsort(of << 32 | columns[0])
    of, table = of[order], np.concatenate([columns, n[None].astype(np.uint32)])[:, order]
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    out = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
        part = table[:, a:b].copy()
        part[0, 1:] = np.diff(part[0])
        out.append(_bytes_apart(part.ravel()))
    return of[starts].tolist(), out


def _from_cells(raw: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, columns and counts."""
    table = _bytes_together(raw).reshape(words + 1, -1)
    table[0] = np.cumsum(table[0])
    h = _mixed(table[0])
    for c in table[1:-1]:
        h = _extended(h, _mixed(c))
    return h, table[:-1].astype(np.uint32), table[-1]


def _passed(blocks: DataFrame, words: int, hots: list[Broadcast], buckets: Buckets, last: bool) -> DataFrame:
    """(range, places, counts, cells) of numbered blocks: the candidates of ``words`` words and their counts, and the buckets of phrases with one word more.

    ``hots`` are the bitmaps of 2 to ``words`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, ahead, size, seen = _Sums(words, HELD), [], 0, 0

        def given() -> Iterator[pa.RecordBatch]:
            of, cells = _cells(buckets, *sums.given())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *[pa.nulls(len(of), pa.binary())] * 2, pa.array(cells, pa.binary())], ["range", "places", "counts", "cells"])

        def next_buckets() -> Iterator[pa.RecordBatch]:
            rows = _range_batch(list(buckets.rows(np.concatenate(ahead)))) if ahead else _range_batch([])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.binary())], ["range", "places", "counts", "cells"])

        for batch in batches:
            for row in range(batch.num_rows):
                number = np.frombuffer(batch.column("numbers")[row].as_buffer(), np.uint32)
                codes = _unpacked(batch.column("codes")[row], len(number))
                bits = np.concatenate([np.zeros(1, np.uint64), _mixed(number)])[codes]
                at = np.flatnonzero(codes)
                h = bits[at]
                for k, hot in enumerate(hots, 2):
                    at, h = _one_more(bits, at, h, k)
                    full = buckets.among(h, hot.value)
                    at, h = at[full], h[full]
                if words > 1:
                    ids = np.concatenate([np.zeros(1, np.uint32), number])[codes]
                    sums.add(h, np.stack([ids[at + k] for k in range(words)]), np.ones(len(at), np.int64))
                    seen += len(at)
                    # counts have 32 bits
                    if sums.limit > HELD or seen >> 31:
                        yield from given()
                        sums, seen = _Sums(words, HELD), 0
                if not last:
                    ahead.append(_one_more(bits, at, h, words + 1)[1])
                    size += len(ahead[-1])
                    if size > HELD:
                        yield from next_buckets()
                        ahead, size = [], 0
        yield from given()
        yield from next_buckets()

    return blocks.mapInArrow(run, "range long, places binary, counts binary, cells binary")


def _passed_on(rows: DataFrame, words: int, buckets: Buckets, support: int, vocabulary: Broadcast) -> DataFrame:
    """What the rows of ``_passed`` come to: (lang, phrase, f) of the frequent phrases, (range, hot) of the full buckets' bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, sums = None, None, _Sums(words, HELD)

        def close() -> Iterator[pa.RecordBatch]:
            _, columns, f = sums.given()
            often = f >= support
            langs, phrases = vocabulary.value.phrases(columns[:, often].astype(np.int64))
            here = [] if total is None else [buckets.bitmap(total, support)]
            empty, none = len(phrases), len(here)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * empty + [now] * none, pa.int64()),
                    pa.array([None] * empty + here, pa.binary()),
                    *[pa.concat_arrays([x, pa.nulls(none, pa.string())]) for x in (langs, phrases)],
                    pa.array([*f[often].tolist(), *[None] * none], pa.int64()),
                ],
                ["range", "hot", "lang", "phrase", "f"],
            )

        for r in _each(batches):
            if r["range"] != now:
                if now is not None:
                    yield from close()
                now, total, sums = r["range"], None, _Sums(words, HELD)
            if r["cells"] is not None:
                sums.add(*_from_cells(r["cells"], words))
            else:
                total = buckets.empty() if total is None else total
                buckets.add(total, r)
        if now is not None:
            yield from close()

    dealt = rows.repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "range long, hot binary, lang string, phrase string, f long")


def _by_numbers(blocks: DataFrame, frequent: DataFrame, buckets: Buckets, support: int, longest: int) -> list[DataFrame]:
    """(lang, phrase, words, f) of the frequent phrases of 2 words, of 3 and so on, counted as rows of numbers of words."""
    context = blocks.sparkSession.sparkContext
    vocabulary = context.broadcast(Vocabulary.make(frequent.select("lang", "word", "f").toArrow()))
    blocks = stored(_numbered(blocks, vocabulary))
    counts, hots = [], []
    for k in range(1, longest + 1):
        out = stored(_passed_on(_passed(blocks, k, hots, buckets, k == longest), k, buckets, support, vocabulary))
        if k > 1:
            counts.append(out.where("phrase IS NOT NULL").select("lang", "phrase", F.lit(k).alias("words"), "f"))
        if k < longest:
            hot = buckets.gathered(out.where("hot IS NOT NULL").select("range", "hot"))
            if not hot.any():
                break
            hots.append(context.broadcast(hot))
    return counts


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, trie: int = TRIE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of 1 to ``longest`` words with f >= ``support``, and (lang, n): the words of each language.

    Empty tables give empty tables. A null text counts as an empty one, a null language as ``und``.
    """
    own = docs.select(text_of(text).alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    blocks = stored(_blocks(own))
    words = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    totals = stored(blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= support))
    counts = [frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")]
    buckets = Buckets.of(totals.agg(F.sum("n")).first()[0] or 0)
    if frequent.count() <= WORDS:
        counts += _by_numbers(blocks, frequent, buckets, support, longest)
    else:
        counts += _by_tries(blocks, frequent, buckets, support, longest, trie)
    return stored(reduce(DataFrame.unionByName, counts)), totals


def _first(phrase, k):
    return F.array_join(F.slice(F.split(phrase, " "), 1, k), " ")


def _rest(phrase, k, words):
    return F.array_join(F.slice(F.split(phrase, " "), k + 1, words - k), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, trie: int = TRIE
) -> DataFrame:
    """Of every language the first ``top`` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are cut into pieces at ``[.,;:!?]`` and line ends, pieces into words at spaces and tabs, A-Z in lower case. n counts all words of the
    language, a the phrase, l and r the two parts of the cut with the lowest score floor(1000 * a * n / (l * r)), the first of several. A
    phrase whose words lie in a longer frequent phrase that occurs as often is left out. Order: score and a from the largest, then the phrase by
    its UTF-8 bytes. Null and empty texts give nothing; a null language is ``und``; repeated rows count again.
    """
    counts, totals = phrase_counts(docs, text, lang, support, longest, trie)
    phrases = counts.where("words > 1").withColumnRenamed("f", "a")

    # a phrase within a longer one that is as frequent lies in one with one word more that is as frequent, too
    longer = phrases.where("words > 2")
    inner = [F.struct(_first(F.col("phrase"), F.col("words") - 1).alias("phrase")), F.struct(_rest(F.col("phrase"), F.lit(1), F.col("words")).alias("phrase"))]
    inner = longer.select("lang", "a", F.explode(F.array(*inner)).alias("x")).select("lang", "x.phrase", "a").distinct()
    phrases = stored(phrases.join(inner, ["lang", "phrase", "a"], "left_anti"))

    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = stored(cuts.select("lang", "phrase", "a", "k", _first(F.col("phrase"), F.col("k")).alias("first"), _rest(F.col("phrase"), F.col("k"), F.col("words")).alias("rest")))
    for part, name in (("first", "l"), ("rest", "r")):
        wanted = cuts.groupBy("lang", part).agg(F.count(F.lit(1)).alias("w"))
        known = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        cuts = join_groups(cuts, stored(wanted.join(known, ["lang", part])), ["lang", part], "w", F.col("phrase")).drop("w")
    met = join_groups(cuts, totals.select("lang", "n", F.col("n").alias("w")), ["lang"], "w", F.col("phrase")).drop("w")
    exact = {c: F.col(c).cast("decimal(18,0)") for c in "anlr"}
    scored = met.withColumn("up", exact["a"] * 1000 * exact["n"]).withColumn("down", exact["l"] * exact["r"]).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    best = stored(best.drop("k"))

    # the first of every part of a language, then the first of these
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = 1 + best.count() // RANKED
    best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    for keys in (["lang", "part"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
