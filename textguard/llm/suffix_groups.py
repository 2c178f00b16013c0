"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefixes, from the greatest group to the smallest: the members of a
group point to the nearest position on their left that is in a smaller group, and positions pointed
at by more members move to a group of their own right after the one they were in. The groups are then
read in ascending order; a sorted suffix puts the one before it, and those that one's pointers lead to,
next in their groups. Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(names: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``names`` (integers of any size) in ascending order.

    A shorter suffix comes before a longer one that it begins.
    """
    n = len(names) + 1
    if n == 1:
        return np.zeros(0, np.int64)
    # an end mark below all names, so that every suffix differs
    _, ranks = np.unique(names, return_inverse=True)
    ranks = np.concatenate([ranks.astype(np.int64) + 1, [0]])
    slots_np = np.argsort(ranks, kind="stable")
    slot_np = np.empty(n, np.int64)
    slot_np[slots_np] = np.arange(n)
    sizes = np.bincount(ranks)
    starts = np.cumsum(sizes) - sizes
    slots, slot = slots_np.tolist(), slot_np.tolist()
    group = starts[ranks].tolist()  # a group is known by its first slot; slots of a group are next to each other
    ends = dict(zip(starts.tolist(), (starts + sizes).tolist()))
    before = [-1] * n

    end = n
    while end:
        start = group[slots[end - 1]]
        if end - start == 1:
            s = slots[start]
            p = s - 1
            while p >= 0 and group[p] > start:
                p = before[p]
            before[s] = p
            pointed = (((p,), 1),) if p >= 0 else ()
        else:
            counts: dict[int, int] = {}
            # from the left, so that pointers of members on the left are known
            for s in sorted(slots[start:end]):
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
            by_count: dict[int, list[int]] = {}
            for p, c in counts.items():
                by_count.setdefault(c, []).append(p)
            pointed = [(by_count[c], c) for c in sorted(by_count, reverse=True)]
        for positions, _ in pointed:
            taken: dict[int, int] = {}
            # to the last slots of their groups ...
            for p in positions:
                old = group[p]
                last = ends[old] - 1
                ends[old] = last
                taken[old] = taken.get(old, 0) + 1
                at, other = slot[p], slots[last]
                slots[at], slot[other] = other, at
                slots[last], slot[p] = p, last
            # ... which are then a group of their own
            for old, moved in taken.items():
                new = ends[old]
                if new == old:
                    ends[old] = new + moved  # all of it moved: nothing changes
                    continue
                ends[new] = new + moved
                for k in range(new, new + moved):
                    group[slots[k]] = new
        end = start

    front = list(range(n + 1))
    out, done = [-1] * n, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            done[s] = 1
            s = before[s]
    return np.array(out[1:], np.int64)
