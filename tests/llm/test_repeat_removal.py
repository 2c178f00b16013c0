"""Removal of repeated strings next to a plain dictionary of all strings; suffix arrays next to sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textguard.llm import repeat_removal
from textguard.llm.repeat_removal import remove_repeats
from textguard.llm.suffix_groups import suffix_array


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß的 0") for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k))

    passages = [prose(rng.randint(10, 60)) for _ in range(6)]
    texts = [None, "", "x" * 700, "ab" * 400, "x" * 199, "0123456789" * 45, prose(40)]
    for _ in range(n):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng.randint(0, 30))]
        text = " ".join(parts)
        if rng.random() < 0.3:
            k = rng.randrange(len(text) + 1)
            text = rng.choice(texts[6:])[: rng.randint(100, 900)] + text[k:]
        texts.append(text)
    return texts + texts[-3:]


@pytest.mark.parametrize("hot", [False, True])
def test_same_as_all_strings(spark, monkeypatch, hot):
    if hot:
        # every key is divided, and groups of more than a few contexts are settled string by string
        monkeypatch.setattr(repeat_removal, "HOT", 2)
        monkeypatch.setattr(repeat_removal, "TOGETHER", 1200)
    texts = corpus(5 + hot, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    for i, (n, removed, spans, sha) in enumerate(brute(texts, 200)):
        r = got[i]
        have = (r["n_bytes"], sum(s["to"] - s["from"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
        assert have == (n, removed, spans, sha), i


def test_odd_tables(spark):
    text = "word " * 10 + "tail " * 60
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (5, None)], "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS t")
    got = remove_repeats(df).collect()
    assert sorted((r["doc_id"] or 0, len(r["kept"])) for r in got) == [(0, 0), (4, 0), (4, 0), (5, 0)]
    assert remove_repeats(df.limit(0)).collect() == []


def test_texts_without_runs_stay_where_they_are(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[5], None])), "doc_id long, text string").repartition(3)
    moved, join_same = [], repeat_removal.join_same

    def counted(left, *rest):
        moved.append(left.count())
        return join_same(left, *rest)

    monkeypatch.setattr(repeat_removal, "join_same", counted)
    got = {r["doc_id"]: (r["n_bytes"], [(s["from"], s["to"]) for s in r["spans"]], len(r["kept"])) for r in remove_repeats(df).collect()}
    assert got == {i: (400, [(0, 400)], 0) if i in (5, 60) else (400, [], 400) for i in range(61)} | {61: (0, [], 0)}
    assert max(moved) == 2


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(1500):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 3, 10])
        names = [rng.randrange(k) for _ in range(n)]
        if names and rng.random() < 0.3:
            names = (names[: rng.randint(1, 5)] * 20)[:n]
        assert suffix_array(np.array(names, np.int64)).tolist() == sorted(range(len(names)), key=lambda i: names[i:])


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_texts_worked_on_together_have_the_runs_of_each(letters):
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 39, 40, 41, 300]))) for _ in range(60)]
    texts += [texts[-1], "ab" * 200, "a" * 300, "x" * (repeat_removal.TEXTS + 1), ""]
    raw, ends = repeat_removal._bytes_of(pa.array(["before", *texts]).slice(1))
    found, calls = [], 0
    for text, begins, at in repeat_removal._parts(ends, 40):
        begins, calls = begins - begins[0], calls + 1
        a = int(ends[text]) + at
        first, end, keys, weight = repeat_removal.runs_of(raw[a : a + int(begins[-1])], 40, 8, begins)
        of = np.searchsorted(begins, first, side="right") - 1
        found += zip((text + of).tolist(), (first - begins[of] + at).tolist(), (end - begins[of] + at).tolist(), keys.tolist(), weight.tolist())
    want = []
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        keys = repeat_removal.keys_of(data, 40, 8).view(np.int64).tolist() if len(data) >= 40 else []
        h = repeat_removal._gram_hashes(data, 8).view(np.int64).tolist() if len(data) >= 40 else []
        begin = [j for j in range(len(keys)) if not j or keys[j] != keys[j - 1]]
        for a, b in zip(begin, [*begin[1:], len(keys)]):
            # the places of the smallest string in the strings that start in the run
            want.append((i, a, b, keys[a], sum(x == keys[a] for x in h[a : b + 32])))
    assert found == want
    assert calls < 10
