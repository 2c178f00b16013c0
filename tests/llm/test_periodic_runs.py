"""Periodic runs next to a plain search of all periods."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard.llm.periodic_runs import find_periodic, find_runs, runs_of_texts
from textguard.llm.queries import entries


def plain(w, least=0):
    """Every maximal stretch for every period; of equal stretches the smallest period."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed):
    rng = random.Random(seed)
    kind = seed % 6
    n = rng.randint(0, 400)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        # periods within periods
        unit = [rng.randrange(3) for _ in range(rng.randint(1, 4))]
        part = unit * rng.randint(3, 25) + [rng.randrange(3) for _ in range(rng.randint(0, 3))]
        return (part * rng.randint(2, 5) + [9] * rng.randint(0, 40))[: 500]
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < 300:
            a, b = b, b + a
        return b[rng.randint(0, 40) : 300]
    if kind == 3:
        # touching regions of one period, out of phase
        unit = [0] * rng.randint(1, 3) + [1]
        out = []
        for _ in range(rng.randint(2, 8)):
            out += (unit * 60)[rng.randint(0, 3) : rng.randint(4, 100)]
        return out[:500]
    if kind == 4:
        out = [rng.randrange(50) for _ in range(n)]
        for _ in range(4):
            i, p = rng.randint(0, n), rng.randint(1, 90)
            out[i:i] = (out[i : i + p] * 4)[: rng.randint(p, 4 * p)]
        return out[:600]
    unit = [0] * rng.randint(5, 60) + [1]
    return (unit * 12)[rng.randint(0, 30) :][: rng.randint(10, 400)] + [0] * rng.randint(0, 50) + unit * rng.randint(0, 3)


@pytest.mark.parametrize("start", range(0, 600, 100))
def test_same_as_all_periods(start):
    many = [texts(seed) for seed in range(start, start + 100)]
    want = [plain(w) for w in many]
    assert [find_runs(w, len(w)) for w in many] == want
    # several texts at once
    assert runs_of_texts([[b"%d" % x for x in w] for w in many], 0) == want


def test_long_and_repetitive_texts_end_soon():
    t0 = time.time()
    assert find_runs([1] * 300_000, 300_000) == [(0, 300_000, 1)]
    unit = list(range(997))
    assert find_runs(unit * 300, 997 * 300) == [(0, 997 * 300, 997)]
    assert find_runs(list(range(300_000)), 300_000) == []
    assert time.time() - t0 < 20


def test_operator_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 13), (4, "a " * 13), (None, "x y " * 6 + "z"), (5, "a b c " * 50_000), (6, "É é\x1cé " * 9)]
    names = ["runs", "collapsed", "start", "n", "period"]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(n) for n in names]).repartition(3)
    got = find_periodic(df)
    assert got.columns == [*df.columns, "periodic"]
    for r in got.collect():
        words = (r["text"] or "").encode().split()
        runs = [tuple(x) for x in r["periodic"]["runs"]]
        if len(words) < 1000:
            assert runs == plain(words, 12)
        else:
            assert runs == [(0, 150_000, 3)]
        assert r["periodic"]["collapsed"] == collapsed([w.decode() for w in words], runs)
    assert find_periodic(df.limit(0)).collect() == []


def test_query(spark, sf):
    got = {r["doc_id"]: r for r in entries()["op12_periodic_runs"][0](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = (d["text"] or "").encode().split()
        h = zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        codes = np.unique(words, return_inverse=True)[1].tolist() if words else []
        runs = plain(codes, 12) if len(codes) < 3000 else find_runs(codes, len(codes))
        runs = [r for r in runs if r[1] >= 12]
        r = got[d["doc_id"]]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed([w.decode() for w in words], runs).encode()).hexdigest()
    assert planted > 5
