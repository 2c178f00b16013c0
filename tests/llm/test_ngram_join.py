"""The n-gram join next to all pairs in plain Python."""

import random
import re

import pytest

from textguard.llm.ngram_join import near_duplicates


def sets_of(rows, words):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(words, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute(rows, words, percent):
    sets = sets_of(rows, words)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= max(len(sets[i]), len(sets[j])) * percent:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((doc, len(s), least[top(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        base = list(rng.choice(bases[:2] if rng.random() < 0.5 else bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            base[rng.randrange(len(base))] = rng.choice(words).upper()
        if rng.random() < 0.3:
            base = (passage + base) if rng.random() < 0.5 else passage[: rng.randint(30, 40)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(base)))
    return rows + [(n, ""), (n + 1, None), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "")]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (3, 1, 50)])
def test_same_as_all_pairs(spark, seed, words, percent):
    rows = corpus(seed, 240)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = near_duplicates(df, words=words, percent=percent).collect()
    want = brute(rows, words, percent)
    assert sorted(map(tuple, [r[:3] for r in out])) == want
    # one row of each component stays, and every row without words
    assert sorted(r["doc_id"] for r in out if r["kept"]) == sorted({c for _, n, c in want if n} | {i for i, n, _ in want if not n})


def test_odd_tables(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", _lit("clash"))
    got = sorted([tuple(r[:3]) for r in near_duplicates(df).collect()], key=str)
    assert got == sorted([(None, 1, 7), (7, 1, 7), (7, 1, 7), (3, 0, 3)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_few_queries_for_a_small_table(spark):
    """Every query and exchange takes memory of the driver, whatever the size of the table."""
    df = spark.createDataFrame(corpus(5, 60), "doc_id long, text string").coalesce(2)
    spark.sparkContext.setJobGroup("few", "")
    try:
        near_duplicates(df, words=4, percent=85).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    assert n < 175


def _lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)
