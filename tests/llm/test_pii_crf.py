"""Personal data: base spans next to plain patterns, message passing next to all labellings, repeated mentions."""

import itertools
import random
import re
import time

import numpy as np

from textguard.llm.pii_crf import Potentials, all_spans, base_spans, find_pii, fit, marginals


def plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        check = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and check % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(4)
    parts = ["a", ".", "@", "a.b@c.de", "x@y", "-", "+", "+1 (555) 010-2000", "1", "10.0.0.1", "256.1.1.1", "0001.2.3.4.5.6.7.8", " ", "é", "%",
             "4111111111111111", "4111 1111-1111 1111", "4111111111111112", "\n", "@@", "a@b.c@d.e", "_", "12", "+49 30 123456", "(", "９"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert base_spans(text) == plain(text), text
    long = "b" * 9000 + "@c.de " + "1." * 3000 + "1 " + "7" * 5000
    assert base_spans(long) == plain(long)


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(1)
    for _ in range(20):
        unary = rng.normal(size=(5, 3))
        edges = np.array([(rng.integers(0, i), i) for i in range(1, 5)])
        pair = rng.normal(size=(4, 3, 3))
        want = np.zeros((5, 3))
        for labels in itertools.product(range(3), repeat=5):
            score = sum(unary[i, l] for i, l in enumerate(labels)) + sum(pair[k, labels[a], labels[b]] for k, (a, b) in enumerate(edges))
            for i, l in enumerate(labels):
                want[i, l] += np.exp(score)
        assert np.allclose(marginals(unary, edges, pair), want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_messages_settle_on_small_loops_and_long_chains():
    """Beliefs next to all labellings: near them where loops are weak, exact along chains of any length."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        unary = rng.normal(size=(4, 3))
        edges = np.array([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)])
        pair = rng.normal(size=(5, 3, 3)) * 0.3
        want = np.zeros((4, 3))
        for labels in itertools.product(range(3), repeat=4):
            score = sum(unary[i, l] for i, l in enumerate(labels)) + sum(pair[k, labels[a], labels[b]] for k, (a, b) in enumerate(edges))
            for i, l in enumerate(labels):
                want[i, l] += np.exp(score)
        got = marginals(unary, edges, pair)
        assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=0.03)
    # one certain end tells the other end of a chain of 40
    n = 40
    unary = np.zeros((n, 2))
    unary[0] = (0, 20)
    edges = np.array([(i, i + 1) for i in range(n - 1)])
    got = marginals(unary, edges, np.repeat(np.eye(2)[None] * 6.0, n - 1, axis=0))
    e = np.exp(6.0)
    assert abs(got[-1, 1] - (1 + ((e - 1) / (e + 1)) ** (n - 1)) / 2) < 1e-6


def test_long_runs_end_soon():
    t0 = time.time()
    for text in ("7" * 1_000_000, "1." * 300_000, "a" * 500_000 + " @b " + "a@" * 2000, "1 " * 300_000, "+" + "1" * 300_000, "a" * 4095 + " " + "a" * 4000 + "@ " * 500):
        base_spans(text)
    assert time.time() - t0 < 10


def test_potentials_are_counted_over_all_rows(spark):
    text = "4111 1111 1111 1111"
    df = spark.createDataFrame([(i, text if i else "4111 1111 1111 1112") for i in range(5001)], "doc_id long, text string").repartition(4)
    lead = fit(df).shape["number 16"]
    assert np.allclose(np.exp(lead), [1.5 / 5003.5, 0.5 / 5003.5, 0.5 / 5003.5, 5000.5 / 5003.5, 0.5 / 5003.5])


def added(text):
    return sorted((k, text[a:b]) for k, a, b in all_spans(text, Potentials())[1])


def test_repeated_mentions_are_found():
    assert added("Call +1 (555) 010-2000. Or 555 010 2000 later.") == [("phone", "555 010 2000")]
    assert added("Later 555-010-2000, or +1 (555) 010-2000.") == [("phone", "555-010-2000")]
    assert added("Card 4111 1111 1111 1111, that is 4111/1111/1111/1111.") == [("card", "4111/1111/1111/1111")]
    assert added("Write to anna.42@mail.example.com, user anna.42 there.") == [("email", "anna.42")]
    assert added("bob.7@mail.example.com, i.e. bob.7 (at) mail (dot) example (dot) com") == [("email", "bob.7 (at) mail (dot) example (dot) com")]


def test_whole_forms_beside_other_numbers():
    assert added("+1 (269) 555-3296 4111111111111111 x") == [("card", "4111111111111111"), ("phone", "+1 (269) 555-3296")]


def test_unproven_tokens_stay_out():
    assert added("Order 4111111111111112 and 5550102000, version 1.2.3, user anna.42") == []
    assert added("Mail a@mail.example.com; 5550102000 is a count. a a a") == []


def test_odd_tables(spark):
    rows = [(None, None), (1, ""), (1, "x +1 (555) 010-2000, 5550102000"), (1, "x +1 (555) 010-2000, 5550102000")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS t", "3 AS id")
    got = find_pii(df, fit(df)).collect()
    assert sorted(len(r["spans"]) for r in got) == [0, 0, 2, 2]
    empty = df.limit(0)
    assert find_pii(empty, fit(empty)).collect() == []
