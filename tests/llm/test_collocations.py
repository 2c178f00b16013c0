"""Collocations next to plain counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textguard.llm import collocations as co


def plain(rows, support, longest, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of every piece."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: c for p, c in count.items() if len(p) > 1 and c >= support}
        inside = {(p[i : i + m], c) for p, c in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)}
        found = []
        for p, a in cand.items():
            if (p, a) in inside:
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "c", "é", "Dé", "10%", "x\x1cy", "的", "#"]
    passage = "a frequent passage of more than five words"
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "?!"]) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.4:
            text += passage + rng.choice(["", " ", "."]) + rng.choice(words)
        rows.append((text, rng.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", "fr"), ("only once", "xx"), ("one " * 30_000, "rep")]


@pytest.mark.parametrize(("seed", "support", "longest", "top", "trie"), [(1, 5, 5, 2000, 300_000), (2, 3, 5, 7, 40), (3, 20, 3, 50, 7)])
def test_same_as_plain_counts(spark, monkeypatch, seed, support, longest, top, trie):
    # several blocks, and several parts in ranks
    monkeypatch.setattr(co, "RANKED", 50)
    rows = corpus(seed, 250)
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit("clash")).withColumn("phrase", F.lit(1)).repartition(4)
    got = co.collocations(df, support=support, longest=longest, top=top, trie=trie)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, support, longest, top)


def test_empty_and_products_beyond_64_bits(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(empty).collect() == []
    none = spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], "text string, lang string")
    assert co.collocations(none).collect() == []
    big = spark.sql("SELECT 3000000000000L a, 9000000000000L n, 5000000000000L l, 7000000000000L r")
    big = big.select(*[F.col(c).cast("decimal(18,0)").alias(c) for c in "anlr"]).withColumn("up", F.expr("a * 1000 * n")).withColumn("down", F.expr("l * r"))
    assert big.select(F.expr("up div down")).first()[0] == 1000 * 3 * 9 // 35


def test_trie_holds_all_phrases_and_no_others():
    rng = np.random.default_rng(1)
    # some words are followed by very many
    rows = np.unique(rng.zipf(1.1, (60_000, 3)).clip(1, 9_000), axis=0)
    phrases = [" ".join(map(str, r)) for r in rows]
    half = len(rows) // 2
    mixed = rng.permutation(len(rows))
    trie = co.build_trie(["en"] * half, [phrases[i] for i in mixed[:half]])
    inside = set(trie.phrases)
    for phrase in phrases[::10]:
        ids = np.array([trie.letters["en"].get(w, 0) for w in phrase.split()])
        at, of = co.advance(trie, ids, 3)
        assert [trie.phrases[i] for i in of] == ([phrase] if phrase in inside else [])


def test_a_word_with_very_many_followers_takes_no_others():
    # every number follows either 0 or 1
    side = np.random.default_rng(4).integers(0, 2, 8_000).tolist()
    phrases = [f"{side[i]} {i}" for i in range(2, 8_000)]
    trie = co.build_trie(["en"] * len(phrases), phrases)
    letters = trie.letters["en"]
    for first in (0, 1):
        ids = np.array([x for i in range(2, 8_000) for x in (letters[str(first)], letters[str(i)], 0)])
        at, of = co.advance(trie, ids, 2)
        assert [trie.phrases[i] for i in of] == [f"{first} {i}" for i in range(2, 8_000) if side[i] == first]


def test_candidates_leave_a_task_by_range(spark):
    words = [f"w{i}" for i in range(60)]
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(words) for _ in range(500)), "en") for _ in range(40)]
    docs = spark.createDataFrame(rows, "t string, lang string").repartition(8)
    blocks = co._blocks(docs).select("lang", "words", "codes")
    buckets = co.Buckets(1 << 16, 4)
    step = co._Step(1, None, True, [])
    hot = buckets.full(co._counted(blocks, step, buckets).where("range IS NOT NULL").select("range", "places", "counts"), 1)
    given = co._candidates(blocks, step, buckets, hot)
    assert given.count() <= 8 * 4
    want = {" ".join(p) for text, _ in rows for p in zip(text.split(), text.split()[1:])}
    got = [r["phrase"] for r in co._distinct(given).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # their counts, too, are a row for many phrases
    pairs = next(co._tries(co._distinct(given), 2, 10_000))
    counted = co._counted(blocks, pairs, None)
    assert counted.count() <= 8
    n = Counter(" ".join(p) for text, _ in rows for p in zip(text.split(), text.split()[1:]))
    assert sorted(map(tuple, co._summed(counted, pairs, 3).collect())) == sorted(("en", p, c) for p, c in n.items() if c >= 3)


def test_candidates_beyond_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(co, "GIVEN", 10)
    rows = corpus(7, 80)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    assert sorted(map(tuple, co.collocations(df, support=4).collect())) == plain(rows, 4, 5, 2000)


@pytest.mark.parametrize("trie", [300_000, 40])
def test_more_words_than_are_broadcast_are_counted_by_tries(spark, monkeypatch, trie):
    monkeypatch.setattr(co, "WORDS", 0)
    rows = corpus(8, 150)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(map(tuple, co.collocations(df, support=4, trie=trie).collect())) == plain(rows, 4, 5, 2000)


def test_many_candidates_take_no_more_passes(spark, monkeypatch):
    made = []
    monkeypatch.setattr(co, "stored", lambda df, one=co.stored: made.append(df.columns) or one(df))
    rows = corpus(9, 150)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    passes = []
    for trie in (300_000, 7):
        made.clear()
        co.phrase_counts(df, support=3, trie=trie)
        passes.append(len(made))
    assert passes[0] == passes[1]


def test_phrases_beyond_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(co, "HELD", 100)
    rows = corpus(10, 150)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(map(tuple, co.collocations(df, support=4).collect())) == plain(rows, 4, 5, 2000)


def test_full_buckets_are_only_a_hint(spark, monkeypatch):
    monkeypatch.setattr(co.Buckets, "of", lambda words: co.Buckets(1 << 8, 4))
    rows = corpus(11, 150)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(map(tuple, co.collocations(df, support=4).collect())) == plain(rows, 4, 5, 2000)


def test_words_and_phrases_that_share_a_hash_stay_apart(spark, monkeypatch):
    old = co._keys
    # rare words meet frequent ones, all phrases each other
    monkeypatch.setattr(co, "_keys", lambda lang, words, salt: old(lang, words, salt) % np.uint64(300))
    monkeypatch.setattr(co, "_mixed", lambda number: np.zeros(number.shape, np.uint64))
    vocabulary = co.Vocabulary.make(pa.table({"lang": ["en", "de", "en"], "word": ["a", "a", "b"], "f": [5, 9, 7]}))
    assert vocabulary.numbers("en", pa.array(["a", "b", "c", *map(str, range(500))])).tolist() == [3, 2, 0, *[0] * 500]
    assert vocabulary.numbers("de", pa.array(["a", "b"])).tolist() == [1, 0]
    assert [x.to_pylist() for x in vocabulary.phrases(np.array([[3, 1], [2, 1]]))] == [["en", "de"], ["a b", "a a"]]
    assert vocabulary.numbers("fr", pa.array(["a"])).tolist() == [0]
    sums = co._Sums(2, 3)
    columns = np.array([[1, 2, 1, 2, 1], [1, 1, 2, 1, 1]], np.uint32)
    sums.add(np.zeros(5, np.uint64), columns, np.arange(1, 6))
    h, columns, n = sums.given()
    assert sorted(zip(*columns.tolist(), n.tolist())) == [(1, 1, 6), (1, 2, 3), (2, 1, 6)]
    buckets = co.Buckets(1 << 16, 256)
    of, cells = co._cells(buckets, h, columns, n)
    assert of == [0]
    _, columns, n = co._from_cells(cells[0], 2)
    assert sorted(zip(*columns.tolist(), n.tolist())) == [(1, 1, 6), (1, 2, 3), (2, 1, 6)]
