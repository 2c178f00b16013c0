"""The pipeline's stages, each on what the stage before kept, next to plain versions."""

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from tests.llm.test_ngram_join import brute
from tests.llm.test_operators import _descended, _rates_of


def table(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = {
        "en": [f"th{a}{b}" for a in "aeiou" for b in "ndrst"], "fr": [f"qu{a}{b}" for a in "éèaiu" for b in "xlmç"],
    }
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "fr"
        words = [rng.choice(vocab[lang]) for _ in range(rng.randint(30, 60))]
        if i % 8 == 1:
            words[::6] = ["idiot"] * len(words[::6])
        if i % 8 == 2:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), lang, f"s{i % 3}", 0))
    texts = [r[1] for r in rows]
    rows += [(200 + k, texts[k], "en", "s0", 0) for k in range(5)]
    rows += [(300 + k, texts[k] + " end", "en", "s0", 0) for k in range(5, 10)]
    rows += [(400, None, "en", "s0", 0), (401, "", "fr", "s0", 0), (402, "1234 !!", None, "s0", 0), (403, "чтоэтотакое " * 30, None, "s0", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if i % 8 == 2 else 1, int(i % 8 == 1)) for i in range(160)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    return table(spark, tmp_path_factory)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").cache()
    # other columns may have any name
    docs = docs.selectExpr("*", "1 AS language", "2 AS sha", "3 AS th", "4 AS times", "5 AS _text")
    columns = docs.columns

    one = cp.language(spark, docs, corpus).cache()
    assert one.columns == columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in one.collect()} == {400, 401, 402, 403}

    two = cp.exact_copies(spark, one, corpus).cache()
    by_text = {}
    for r in one.collect():
        by_text[r["text"]] = max(by_text.get(r["text"], -1), r["doc_id"])
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == sorted(by_text.values())

    three = cp.near_copies(spark, two, corpus).cache()
    want = brute([(r["doc_id"], r["text"]) for r in two.collect()], 5, 80)
    assert three.columns == columns and sorted(r["doc_id"] for r in three.collect()) == sorted({c for _, _, c in want})

    four = cp.mixture(spark, three, corpus).cache()
    assert four.columns == columns
    left = [r["doc_id"] for r in four.collect()]
    assert len(left) == len(set(left))
    good = {r["doc_id"] for r in three.collect() if r["doc_id"] % 8 not in (1, 2)}
    assert len(good - set(left)) <= 2
    assert len([i for i in left if i % 8 == 1]) < len([r for r in three.collect() if r["doc_id"] % 8 == 1]) / 2

    five = cp.pieces(spark, four, corpus).collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{cp.TOKENIZERS}/piece_bpe_32k.model")
    texts = {r["doc_id"]: r["text"] for r in four.collect()}
    assert {r["doc_id"]: r["piece_ids"] for r in five} == {i: sp.encode(t) for i, t in texts.items()}


@pytest.fixture(autouse=True)
def nothing_stays_cached(spark):
    """Later plans over the same files would read the cache."""
    yield
    spark.catalog.clearCache()


def test_all_that_are_likely_good_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("domain", cp.label_domain())
    mixed = cp.mix(docs, labels, cp.TARGETS, keep="good", most=1.0).collect()
    good = {r["doc_id"] for r in mixed if r["domain"] == "good"}
    assert any(0.5 < r["posterior"]["good"] < 0.95 for r in mixed)
    assert {r["rate"] for r in mixed if r["domain"] == "good"} == {1.0}
    left = {r["doc_id"] for r in cp.mixture(spark, docs, sf).collect()}
    assert good <= left and len(left) < len(mixed)


def test_rates_next_to_a_plain_version(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.8, 0.4, 0.4], 50)
    n = rng.integers(1, 500, 50)
    names = ["good", "low", "toxic"]
    _, rates = _rates_of(spark, p, n, names, cp.TARGETS, keep="good", most=1.0)
    want = _descended(p, n, names, cp.TARGETS, "good", 1.0)
    kept = p.argmax(axis=1) == 0
    assert (rates[kept] == 1).all() and rates[~kept].min() < 0.5
    assert np.allclose((n * rates) @ p, (n * want) @ p, atol=0.005 * n.sum())


def test_empty(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
        assert docs.collect() == []
