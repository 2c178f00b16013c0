"""The quality discriminant next to a plain one, on odd tables, and on labels it has not seen."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from textguard.llm import quality as q
from textguard.llm.queries import entries


def plain_score(x, label, want, common, diagonal, flatten):
    """Densities by determinants and inverses, without Cholesky factors."""
    x, want = x / q.UNIT, want / q.UNIT
    n = [(label == c).sum() for c in (0, 1)]
    cov = [np.cov(x[label == c].T, bias=True) for c in (0, 1)]
    pooled = (cov[0] * n[0] + cov[1] * n[1]) / len(x)
    logs = []
    for c in (0, 1):
        m = (1 - common) * cov[c] + common * pooled
        m = (1 - diagonal) * m + diagonal * np.diag(np.diag(pooled)) + np.eye(q.DIMS) / q.UNIT
        d = want - x[label == c].mean(axis=0)
        logs.append(np.log(n[c]) - np.linalg.slogdet(m)[1] / 2 - np.einsum("ij,jk,ik->i", d, np.linalg.inv(m), d) / 2)
    return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / flatten, -q.MOST, q.MOST)))


def test_next_to_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.where("quality IS NOT NULL").collect()}
    ids = [i for i in quality if i in text and zlib.crc32(str(i).encode()) % 3 != 1]
    x = np.stack([q.statistics(text[i]) for i in ids])
    label = np.array([quality[i] for i in ids])
    every = np.stack([q.statistics(t) for t in text.values()])
    got = {r["doc_id"]: r["score"] for r in entries()["op11_quality"][0](spark, sf).collect()}
    got = np.array([got[i] for i in text])
    # one of the choices gives these scores
    assert any(np.allclose(got, plain_score(x, label, every, a, b, c), atol=1e-6) for a in q.COMMON for b in q.DIAGONAL for c in q.FLATTEN)


def test_unseen_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = entries()["op11_quality"][0](spark, folder).join(labels, "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    poor = [r["predicted"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(poor) <= 0.1 * len(poor) and len(poor) > 10


def test_odd_tables(spark):
    long = "some words of a long text. " * 50_000
    rows = [(1, None), (2, ""), (2, ""), (3, "Good text, with words."), (3, "###$$$ !!!"), (None, "x"), (4, long), (5, "\n\n"), (6, "É"), (7, "AB!! CD!!")]
    names = ["statistics", "score", "label", "x", "w", "fold", "_id"]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("s").alias(n) for n in names]).repartition(3)
    measured = q.measure(df, into="m")
    got = {(r["doc_id"], r["text"]): r["m"] for r in measured.collect()}
    assert got[1, None] == got[2, ""] == [0] * q.DIMS and got[4, long] == q.statistics(long).tolist()
    labels = spark.createDataFrame([(3, 1), (4, 1), (4, None), (7, 0), (5, 0), (5, 1), (None, 1), (99, 0), (6, 7), (2, 0)], "doc_id long, quality int")
    model = q.fit(measured, labels, into="m")
    x = np.array([got[3, rows[3][1]], got[3, rows[4][1]], got[4, long]])
    low = np.array([got[7, rows[9][1]], got[2, ""], got[2, ""]])
    want = plain_score(np.concatenate([x, low]), np.array([1, 1, 1, 0, 0, 0]), x, 1.0, 0.3, 1.0)
    out = q.score(measured, model, "score", "m")
    assert out.columns == [*[c for c in df.columns if c != "score"], "score"] and out.count() == len(rows)
    # which of the choices was taken depends on the folds, so only that of too few rows is compared
    plain = q.discriminant(q._sums(_rows(spark, x, low)).sum(axis=0), 1.0, 0.3)
    assert np.allclose(plain.score(x), want)
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    # one class alone, and nothing at all
    assert q.fit(measured, labels.where("quality = 1 AND doc_id <> 5"), into="m") is None
    assert {r["score"] for r in q.score(measured, None, statistics="m").collect()} == {0.5}
    assert q.fit(measured.limit(0), labels, into="m") is None and q.score(measured.limit(0), model, statistics="m").collect() == []
    assert q.fit(measured, labels.limit(0), into="m") is None


def _rows(spark, good, poor):
    rows = [([int(v) for v in r], c, i % 4) for i, (r, c) in enumerate([*[(r, 1) for r in good], *[(r, 0) for r in poor]])]
    return spark.createDataFrame(rows, "x array<int>, label int, fold int")
