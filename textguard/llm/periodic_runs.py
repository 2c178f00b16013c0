"""All maximal periodic runs of words, found with string synchronising sets.

A run is a stretch of words with smallest period q and length 2q or more that no neighbour extends.

* *Small periods* are read off directly: where words q apart are equal.
* *Larger periods*, scale by scale (tau = 4, 8, 16 ...; q from 3 tau to 6 tau). A hash of the next tau words names every position.
  A position is chosen if the smallest name among the tau + 1 next positions is at either end of them, so whether it is chosen
  depends on its context of 2 tau words alone. Stretches without a chosen position are highly periodic (period of tau / 3 at most).
  A run repeats its contexts q words later; chosen positions with equal contexts at such a distance propose their distance as a period.
* *Highly periodic regions* are themselves runs of smaller scales. A run of a larger period that shows no chosen position begins with one
  of them and repeats it, so it lies over two that touch; their borders and phases propose its period.

Every proposal is compared word by word and extended both ways, so the result is exact whatever the hashes.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run counts from this many words.
LEAST = 12
#: Periods that are read off directly.
DIRECT = 11
#: Words that are worked on together; a longer text is worked on alone.
TOGETHER = 1 << 17

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _same(w: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i on, in the given direction, equal those from j on (i < j)."""
    n, size = 0, 16
    room = len(w) - j if step > 0 else i + 1
    while n < room:
        size = min(size, room - n)
        a = w[i + n : i + n + size] if step > 0 else w[i - n - size + 1 : i - n + 1][::-1]
        b = w[j + n : j + n + size] if step > 0 else w[j - n - size + 1 : j - n + 1][::-1]
        apart = np.flatnonzero(a != b)
        if len(apart):
            return n + int(apart[0])
        n, size = n + size, size * 4
    return n


def _proposed(w: np.ndarray, proposals: np.ndarray, runs: dict) -> None:
    """Adds the runs of proposals (period, position) to ``runs``: (start, end) -> smallest period."""
    period, reach = 0, 0
    for q, i in np.unique(proposals, axis=0).tolist():
        if q == period and i < reach:
            continue
        end = i + _same(w, i, i + q, 1)
        start = i - _same(w, i - 1, i + q - 1, -1) if i else i
        period, reach = q, end
        if end - start >= q:
            span = (start, end + q)
            runs[span] = min(q, runs.get(span, q))


def _chosen(names: np.ndarray, tau: int) -> np.ndarray:
    """The synchronising positions; ``names`` has ``_NONE`` where a highly periodic window begins."""
    least, width = names, 1
    while width < tau:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:-1], names[tau:])
    here = (least != _NONE) & ((names[: len(least)] == least) | (names[tau:] == least))
    return np.flatnonzero(here)


def _equal_contexts(contexts: np.ndarray, places: np.ndarray, tau: int) -> np.ndarray:
    """(distance, position) of chosen positions with equal contexts, 3 tau to 6 tau apart."""
    order = np.lexsort((places, contexts))
    contexts, places = contexts[order], places[order]
    found, lag = [np.zeros((0, 2), np.int64)], 1
    while lag < len(places):
        gap = places[lag:] - places[:-lag]
        near = (contexts[lag:] == contexts[:-lag]) & (gap < 6 * tau)
        if not near.any():
            break
        near &= gap >= 3 * tau
        found.append(np.stack([gap[near], places[:-lag][near]], axis=1))
        lag += 1
    return np.concatenate(found)


def _touching(w: np.ndarray, regions: np.ndarray, tau: int) -> np.ndarray:
    """(period, position) from pairs of touching regions (start, end, period) of equal period, in order of their starts."""
    found = []
    for (b1, e1, p), (b2, e2, _) in _neighbours(regions):
        found.append((e2 - e1, b2))
        # where the second one's first period begins in the first one
        phase = _phase(w[b1 : b1 + 2 * p - 1], w[b2 : b2 + p])
        if phase is None:
            continue
        apart = (b2 - b1 - phase) % p
        top = min(6 * tau - 1, e1 + 1 - b1, e2 + 1 - b1)
        low = max(3 * tau, b2 - b1)
        found += [(q, b1) for q in range(low + (apart - low) % p, top + 1, p)]
        top = min(6 * tau - 1, b2 - b1, e2 + 1 - b2)
        found += [(q, b2 - q) for q in range(3 * tau + (apart - 3 * tau) % p, top + 1, p)]
    out = np.array([(q, i) for q, i in found if 3 * tau <= q < 6 * tau and 0 <= i < len(w) - q], np.int64)
    return out.reshape(-1, 2)


def _phase(hay: np.ndarray, needle: np.ndarray) -> int | None:
    hay, needle, at = hay.tobytes(), needle.tobytes(), -1
    while (at := hay.find(needle, at + 1)) >= 0:
        if at % 8 == 0:
            return at // 8
    return None


def _neighbours(regions: np.ndarray):
    by_period: dict = {}
    for b, e, p in regions.tolist():
        last = by_period.get(p)
        if last is not None and b <= last[1] + 1:
            yield last, (b, e, p)
        by_period[p] = (b, e, p)


def find_runs(w: np.ndarray, longest: int, reach=None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of length 2 * period or more, in order of their starts, then periods.

    ``w`` are numbers of words. Several texts may follow each other if a number that occurs nowhere else parts them;
    ``longest`` is the length of the longest of them, and ``reach(n)`` the end of those with n words or more, which come first.
    """
    w = np.asarray(w, np.int64)
    runs: dict[tuple[int, int], int] = {}
    for q in range(1, min(DIRECT, longest // 2) + 1):
        # one more at each end, so that every stretch has a border
        edges = np.flatnonzero(np.diff(np.concatenate([[False], w[q:] == w[:-q], [False]]).astype(np.int8)))
        for start, end in edges.reshape(-1, 2)[edges[1::2] - edges[::2] >= q].tolist():
            runs.setdefault((start, end + q), q)
    with np.errstate(over="ignore"):
        names, tau = _mixed(w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), 1
        while 6 * tau <= longest:
            end = reach(6 * tau) if reach else len(w)
            names = names[: max(0, end - tau + 1)]
            twice = _mixed(names[:-tau] * np.uint64(0x9E3779B97F4A7C15) + names[tau:]) if len(names) > tau else names[:0]
            if tau >= 4 and len(twice):
                known = np.array([(b, e, p) for (b, e), p in runs.items() if 3 * p <= tau and e - b >= tau and b < end], np.int64).reshape(-1, 3)
                border = np.zeros(len(names) + 1, np.int64)
                np.add.at(border, known[:, 0], 1)
                np.add.at(border, np.minimum(known[:, 1] - tau + 1, len(names)), -1)
                shown = np.where(np.cumsum(border[:-1]) > 0, _NONE, _mixed(names))
                places = _chosen(shown, tau)
                long_ones = known[known[:, 1] - known[:, 0] >= 3 * tau - 1]
                long_ones = long_ones[np.argsort(long_ones[:, 0], kind="stable")]
                _proposed(w[:end], np.concatenate([_equal_contexts(twice[places], places, tau), _touching(w[:end], long_ones, tau)]), runs)
            names, tau = twice, 2 * tau
    return sorted((start, end - start, q) for (start, end), q in runs.items())


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text (its words) the runs of at least ``least`` words: start, length, period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    number = defaultdict(itertools.count(len(texts)).__next__)
    parts, starts, at = [], [], 0
    for k, i in enumerate(order):
        words = texts[i]
        parts += [np.fromiter(map(number.__getitem__, words), np.int64, len(words)), np.array([k])]
        starts.append(at)
        at += len(words) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not parts:
        return out
    sizes = np.array([len(texts[i]) for i in order])
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])

    def reach(n: int) -> int:
        return int(ends[np.searchsorted(-sizes, -n, side="right")])

    for start, length, q in find_runs(np.concatenate(parts), int(sizes[0]), reach):
        if length >= least:
            k = int(np.searchsorted(ends, start, side="right")) - 1
            out[order[k]].append((start - int(ends[k]), length, q))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    border = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        border[start + q] += 1
        border[start + length] -= 1
    return b" ".join(itertools.compress(words, np.cumsum(border[:-1]) == 0))


def find_periodic(docs: DataFrame, text: str = "text", into: str = "periodic", least: int = LEAST) -> DataFrame:
    """``docs`` with a struct ``into``: ``runs`` (array of start, length, period; by start, then period) and ``collapsed``.

    Words are runs without blanks (space, tab to carriage return), numbered from 0; whole texts are read. ``collapsed`` joins by
    one space the words that no run has after its first period. A null or empty text and one without words has no runs and an empty
    ``collapsed``. Equal rows get equal results. Narrow: no shuffle; other columns are neither read nor changed.
    """
    kind = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"

    def work(texts: list[str | None]) -> pa.Array:
        words = [(t or "").encode("utf-8", "replace").split() for t in texts]
        found = runs_of_texts(words, least)
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        ends = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
        spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        kept = pa.array([_collapsed(w, r).decode() for w, r in zip(words, found)], pa.string())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, spans), kept], ["runs", "collapsed"])

    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            done, start, size = [], 0, 0
            # about six bytes are a word
            for i, n in enumerate(pa.compute.binary_length(part).fill_null(0).to_pylist()):
                if size and size + n > 6 * TOGETHER:
                    done.append(work(part.slice(start, i - start).to_pylist()))
                    start, size = i, 0
                size += n
            done.append(work(part.slice(start).to_pylist()))
            yield pa.concat_arrays(done)

    return docs.withColumn(into, run(F.col(text)))
