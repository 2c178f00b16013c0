"""Each operator on odd tables and next to a plain version of itself."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard.llm import exact_dedup, fingerprints, language, line_dedup, mixing, sentence_pieces, token_counts
from textguard.llm.common import join_groups, likely_in, measured_groups, stored
from textguard.llm.components import components
from textguard.llm.merge_pairs import PairTokens
from textguard.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"
LONG = "long words of a text " * 60_000

ODD = [
    (1, "same text"), (2, "same text"), (2, "same text"), (3, "same text "), (4, None), (5, ""), (6, LONG), (7, LONG),
    (None, "same text"), (None, None), (8, "\n\n"), (9, "1234"), (10, "é́ 的🙂\x1c"), (11, "x" * 5000),
]


def _placed(module, docs):
    """The rows of ``with_next`` with their ranges."""
    return module.in_ranges(docs.selectExpr("doc_id AS id", "text AS t"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use themselves."""
    names = ["t", "id", "sha", "row", "pos", "names", "bucket", "key", "n", "language", "_words", "posterior", "range", "next", "lang"]
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    df = df.select("*", *[F.lit("x").alias(n) for n in names]).cache()
    yield df
    df.unpersist()


def test_exact_duplicates(spark, odd):
    by_text = defaultdict(list)
    for i, t in ODD:
        by_text[t or ""].append(i)
    want = []
    for i, t in ODD:
        group = by_text[t or ""]
        keep = max((x for x in group if x is not None), default=None)
        want.append((i, keep, len(group), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    # few buckets: most blocks and pairs share one, so their ranks decide
    for bucket, block in ((F.xxhash64, 4096), (lambda *c: F.pmod(F.xxhash64(*c), F.lit(3)), 5_000)):
        got = exact_dedup.exact_duplicates(odd, block=block, bucket=bucket).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((max(x for x in g if x is not None), t) for t, g in by_text.items())
    assert exact_dedup.exact_duplicates(odd.limit(0)).collect() == []


def test_names_tell_texts_apart_whatever_the_hash(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact_dedup.exact_duplicates(df, block=2, bucket=lambda *c: F.lit(7).cast("long")).collect()
    last = {t: i for i, t in enumerate(texts)}
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, last[t], texts.count(t)) for i, t in enumerate(texts)}


def test_line_dedup(spark, odd):
    rng = random.Random(2)
    lines = ["A shared line that is long enough to count, " + str(k) for k in range(6)] + ["short", "", "  \t"]
    rows = [(i, "\n".join(rng.choice(["", " \t"]) + rng.choice([str.upper, str])(rng.choice(lines)) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(41, None), (41, rows[0][1]), (42, "é" * 39 + "\n" + "É" * 40)] + [(50 + k, "é" * 40) for k in range(5)]

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    want = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (len(holders[key(x)]) >= 5 and i != max(holders[key(x)]))]
        want.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, line_dedup.line_dedup(df).collect())) == sorted(want)
    assert line_dedup.line_dedup(odd).count() == len(ODD)
    assert line_dedup.line_dedup(odd.limit(0)).collect() == []


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


PARTS = ["a", "b", "the", " ", "  ", "\n", "'", "'s", "'re", "é", "的", "🙂", "<|endoftext|>", "1", "23", ".", "!!", "\x1c", "\x85", "x", "ing", "\t", "aaaa", "<|endof", "ß", "▁", "   "]


def test_token_counts(spark, odd, tokenizer):
    def count(t):
        return len(tokenizer.encode(t, add_special_tokens=False).ids)

    counter = token_counts.Counter(token_counts.read_spec(VOCABULARY))
    rng = random.Random(3)
    for _ in range(800):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert counter.count([text]) == [count(text)]
        assert counter.prefixes(text) == [count(text[:k]) for k in range(len(text) + 1)]
    got = token_counts.count_tokens(odd, VOCABULARY).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, len((t or "").encode()), count(t or "")) for i, t in ODD), key=str)
    assert token_counts.count_tokens(odd.limit(0), VOCABULARY).collect() == []
    small = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    cut = token_counts.prefix_counts(small, VOCABULARY).select("doc_id", token_counts.fits_budget("counts", 2).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in cut} == {1: len("one two"), 2: 0}


def test_long_runs_are_encoded_in_one_pass(tokenizer):
    import sentencepiece

    encoder = sentence_pieces.Encoder(sentence_pieces.Pieces(sentence_pieces.read_model(MODEL)))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = token_counts.Counter(token_counts.read_spec(VOCABULARY))
    rng = random.Random(5)
    texts = ["".join(rng.choice([" ", "  ", "a", "the", "\n", "$$", "é", "中", ".", "7", "\t"]) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += [" " * k + "b" * (k % 3) for k in range(70)]
    assert [np.frombuffer(p, np.int32).tolist() for p in encoder.encode(texts)] == library.encode(texts)
    for text in texts[:300]:
        assert counter.prefixes(text) == [len(tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    t0 = time.time()
    for char in " \n7":
        assert np.frombuffer(encoder.encode([char * 1_000_000])[0], np.int32).tolist() == library.encode(char * 1_000_000)
        assert counter.prefixes(char * 200_000)[-1] == counter.count([char * 200_000])[0]
    assert time.time() - t0 < 120


def test_sentence_pieces(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = sentence_pieces.Encoder(sentence_pieces.Pieces(sentence_pieces.read_model(MODEL)))
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    assert [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)] == sp.encode(texts)
    ids = sentence_pieces.encode(odd, MODEL)
    assert sorted(((r["doc_id"], r["piece_ids"]) for r in ids.collect()), key=str) == sorted(((i, sp.encode(t or "")) for i, t in ODD), key=str)
    back = sentence_pieces.decode(ids, MODEL)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in ODD), key=str)
    assert sentence_pieces.encode(odd.limit(0), MODEL).collect() == []


def test_best_sums_of_scores():
    rng = random.Random(5)
    scores = {"".join(p): -rng.random() * 5 - len(p) for n in (1, 2, 3) for p in itertools.product("ab", repeat=n) if rng.random() < 0.8}
    model = sentence_pieces.BestSums(scores, -30.0)

    def best(word):
        if not word:
            return 0.0
        return max([best(word[:-1]) - 30.0] + [best(word[:-k]) + scores[word[-k:]] for k in (1, 2, 3) if k <= len(word) and word[-k:] in scores])

    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(200)})
    for word, pieces in model.sweep(words):
        assert "".join(pieces) == word
        assert math.isclose(sum(scores.get(p, -30.0) for p in pieces), best(word))


def test_pairs_that_stay_apart():
    rng = random.Random(6)
    merges = {}
    tokens = list("abc")
    while len(tokens) < 40:
        pair = (rng.choice(tokens), rng.choice(tokens))
        if pair not in merges and len("".join(pair)) < 7:
            merges[pair] = len(merges)
            if "".join(pair) not in tokens:
                tokens.append("".join(pair))
    table = PairTokens(tokens, lambda a, b: merges.get((a, b)))
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    for word, _, count in table.sweep(words):
        assert count == [0] + [len(table.merged(word[:k])) for k in range(1, len(word) + 1)]


def test_language(spark, odd, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    out = language.identify(docs.where(language.held_out()), model)
    right, n, rejected = out.agg(F.avg((F.col("language.lang") == F.col("lang")).cast("int")), F.count(F.lit(1)), F.count_if("language.rejected")).first()
    assert n > 100 and right > 0.97 and rejected <= 0.02 * n
    got = {(r["doc_id"], r["text"]): r["found"] for r in language.identify(odd, model, into="found").collect()}
    for (_, t), x in got.items():
        assert 0 <= x["score"] <= 1
        assert (x["lang"] == "und") == (t is None or not any(c.isalpha() for c in t))
    empty = language.fit(odd.limit(0))
    assert {r["found"]["lang"] for r in language.identify(odd, empty, into="found").collect()} == {"und"}
    assert language.identify(odd.limit(0), model, into="found").collect() == []
    # long texts are counted in windows
    text = "abc déf " * 3000
    whole = language.grams([text])
    assert np.array_equal(whole, language.grams([text, ""])[:1])


def test_foreign_texts_of_any_length_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    assert (model.floor > 0).all()
    foreign = ["русский текст о том как люди живут и работают в большом городе ", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待 "]
    for text in foreign:
        for n in (40, 100, 600, 3000, 40_000, 400_000):
            assert model.predict([(text * (n // len(text) + 1))[:n]])[2][0], (text, n)
    # nothing of the known languages goes for that, short and long ones either
    mine = [r["text"] for r in docs.where(language.held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).collect()]
    rare = [t for t in mine if language.size_class([t])[0] <= 3 or language.size_class([t])[0] > 6]
    assert len(rare) >= 5 and model.predict(rare)[2].mean() <= 0.02
    cuts = [c for t in mine for c in language.excerpts(t)]
    assert {0, 1, 2, 3, 4, 5} <= set(language.size_class(cuts)) and model.predict(cuts)[2].mean() <= 0.02
    long = ["\n".join(t for t in mine if len(t) > 1000)[:n] for n in (20_000, 60_000)]
    assert not model.predict(long)[2].any()


def test_floors_of_small_languages(spark):
    rows = [(i, f"the words of number {'abcdefghij'[i % 10]} and the other ones " * 3, "en") for i in range(60)]
    rows += [(100 + i, f"les mots de la {'abc'[i]} et les autres", "fr") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    floor = language.fit(docs).floor
    assert np.allclose(floor[0], floor[1]) and (floor > 0).all()
    assert not language.fit(docs.where("lang = 'fr'")).floor.any()


def test_windows_of_grams(monkeypatch):
    text = "the quick brown fox é " * 50
    whole = language.grams([text])
    monkeypatch.setattr(language, "WINDOW", 64)
    assert np.array_equal(whole, language.grams([text]))


def test_mixing(spark, odd):
    labelled = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "b"), (5, None), (3, "b")], "doc_id long, domain string")
    out = mixing.mix(odd, labelled, {"a": 0.5, "b": 0.5})
    assert out.count() == len(ODD) and out.where("rate < 0 OR rate IS NULL").count() == 0
    assert mixing.mix(odd.limit(0), labelled, {"a": 1.0}).collect() == []
    none = mixing.mix(odd, labelled.limit(0), {"a": 1.0}).collect()
    assert {r["rate"] for r in none} == {1.0} and all(r["posterior"] == {} for r in none)

    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5, 0.5, 0.3], 60)
    n = rng.integers(0, 500, 60)
    names, want = ["x", "y", "z"], {"x": 0.6, "y": 0.3, "z": 0.1}
    for most in (None, 1.5):
        got, rates = _rates_of(spark, p, n, names, want, most=most)
        plain = _descended(p, n, names, want, None, most)
        assert np.allclose(_squares(p, n, names, want, rates), _squares(p, n, names, want, plain), atol=1e-4 * n.sum())
        assert np.allclose(rates, np.clip(1 - p @ got, 0, most))


def _rates_of(spark, p, n, names, want, keep=None, most=None):
    seen = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))], "i int, n_words long, posterior array<double>")
    got = mixing.fit_rates(seen, names, want, keep, most)
    return np.array(got), np.array([r["rate"] for r in mixing.rated(seen, names, want, keep, most).orderBy("i").collect()])


def _descended(p, n, names, want, keep, most):
    """Plain projected gradient descent, every document on its own."""
    there = n @ p
    least = (p.argmax(axis=1) == names.index(keep)).astype(float) if keep else np.zeros(len(n))
    budget = there[names.index(keep)] / want[keep] if keep else n.sum()
    r = np.ones(len(n))
    for _ in range(20_000):
        off = (n * r) @ p - np.array([want.get(d, 0.0) for d in names]) * budget
        r = np.minimum(np.maximum(r - p @ (off / there), least), np.inf if most is None else most)
    return r


def _squares(p, n, names, want, rates):
    off = (n * rates) @ p - np.array([want.get(d, 0.0) for d in names]) * n.sum()
    return (off**2 / (n @ p)).sum()


def test_rates_converge_or_say_what_is_missing(spark, caplog):
    rng = np.random.default_rng(5)
    # soft posteriors of four domains, which are hard to tell apart
    p = rng.dirichlet([14, 6, 4, 3], 400)
    n = rng.integers(1, 500, 400).astype(float)
    names, want = ["good", "low", "toxic", "other"], {"good": 0.56, "low": 0.22, "toxic": 0.12, "other": 0.10}
    _, rates = _rates_of(spark, p, n, names, want)
    assert not caplog.records and np.allclose((n * rates) @ p / n.sum(), list(want.values()), atol=2e-5)
    # nobody leans that far: the rates end at the least squares, and the rest is reported
    _, rates = _rates_of(spark, p, n, names, {"toxic": 1.0}, most=1.0)
    assert "toxic -0." in caplog.text
    best = _squares(p, n, names, {"toxic": 1.0}, _descended(p, n, names, {"toxic": 1.0}, None, 1.0))
    assert best <= _squares(p, n, names, {"toxic": 1.0}, rates) <= 1.01 * best


def test_draw(spark, odd):
    mixed = odd.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.lit(2.0).alias("rate"))
    assert mixing.draw(odd, mixed).count() == 2 * len(ODD)
    assert mixing.draw(odd, mixed.withColumn("rate", F.lit(0.0))).count() == 0
    assert mixing.draw(odd, mixed).columns == odd.columns


def test_fingerprints(spark, odd):
    pairs = fingerprints.with_next(odd).collect()
    assert len(pairs) == len(ODD)
    ordered = sorted([x for x in ODD if x[0] is not None], key=lambda x: -x[0])
    following = {a[0]: b[0] for a, b in zip(ordered, ordered[1:] + ordered[:1]) if a[0] != 2}
    text_of = dict(ODD)
    for r in pairs:
        if r["doc_id"] in following and following[r["doc_id"]] != 2:
            assert r["next_text"] == (text_of[following[r["doc_id"]]] or "")
    sparse = spark.createDataFrame([(k * 10**15, str(k)) for k in range(-4, 5)], "doc_id long, text string")
    assert {r["text"]: r["next_text"] for r in fingerprints.with_next(sparse).collect()} == {str(k): str(k - 1 if k > -4 else 4) for k in range(-4, 5)}

    a = "One. Two words here.\nsecond paragraph\n\nnext section. end"
    texts = [a, a.replace("second", "changed"), a + " ", "", "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fingerprints.fingerprint(F.col("text")).alias("f"))
    fps = {r["text"]: r["f"] for r in df.collect()}
    assert len(set(fps.values())) == len(texts)
    d = spark.createDataFrame([(fps[a], fps[t]) for t in texts], "a string, b string")
    out = d.select(fingerprints.first_difference(F.col("a"), F.col("b")).alias("at"), fingerprints.likeness(F.col("a"), F.col("b")).alias("n")).collect()
    assert out[0]["at"] is None and out[0]["n"] == 1.0
    assert (out[1]["at"]["section"], out[1]["at"]["paragraph"]) == (0, 1) and 0 < out[1]["n"] < 1
    assert out[2]["at"]["section"] == 1 and out[3]["n"] == 0.0
    assert odd.select(fingerprints.fingerprint(F.col("text"))).count() == len(ODD)
    # an outlying id does not put all others into one range, and what is cut follows the rows, not the ids
    far = spark.range(6000).select(F.when(F.col("id") == 0, F.lit(10**17)).when(F.col("id") < 5, -(10**17) + F.col("id")).otherwise(F.col("id") * 3).alias("doc_id"))
    far = far.withColumn("text", F.col("doc_id").cast("string"))
    ids = sorted(r["doc_id"] for r in far.collect())
    assert {int(r["text"]): int(r["next_text"]) for r in fingerprints.with_next(far).collect()} == dict(zip(ids[1:], ids)) | {ids[0]: ids[-1]}
    sizes = [r["n"] for r in _placed(fingerprints, far).groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= fingerprints.LEAST_RANGE
    assert fingerprints.with_next(odd.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100 + k) for k in range(30)] + [(5, 5)]
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    nodes = {x for ab in links for x in ab if ab[0] != ab[1]}
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: top(x) for x in nodes if top(x) != x}


def test_join_groups(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 0, 0, rng.randrange(3000), None])) for i in range(3000)]
    sizes = Counter(k for _, k in rows if k is not None)
    df = spark.createDataFrame(rows, "i long, k long")
    groups = stored(spark.createDataFrame([(k, n, -k) for k, n in sizes.items() if k % 2 == 0], "k long, n long, v long"))
    got = join_groups(df, groups, ["k"], "n", F.col("i")).collect()
    assert sorted((r["i"], r["v"]) for r in got) == sorted((i, -k if k is not None and k % 2 == 0 else None) for i, k in rows)


def test_few_groups_meet_without_a_shuffle(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(200)] + [(None, -1), (99, -2)], "k long, v long").repartition(3)
    groups, sizes = measured_groups(rows.where("k < 5").groupBy("k").agg(F.count(F.lit(1)).alias("n")), "n")
    met = join_groups(rows, groups, ["k"], "n", F.col("v"), sizes)
    n = Counter(i % 7 for i in range(200))
    assert sorted(map(tuple, met.collect()), key=str) == sorted([(i % 7, i, n[i % 7] if i % 7 < 5 else None) for i in range(200)] + [(None, -1, None), (99, -2, None)], key=str)
    assert sizes == {"total": sum(n[k] for k in range(5)), "most": 29, "count": 5}
    assert "SortMergeJoin" not in met._jdf.queryExecution().executedPlan().toString()
    none, sizes = measured_groups(groups.where("n < 0"), "n")
    assert sizes["count"] == 0 and {r["n"] for r in join_groups(rows, none, ["k"], "n", F.col("v"), sizes).collect()} == {None}


def test_many_even_groups_meet_in_one_shuffle_join(spark):
    rows = spark.range(6000).select((F.col("id") % 2000).alias("k"), F.col("id").alias("v"))
    groups, sizes = measured_groups(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "n")
    met = join_groups(rows, groups, ["k"], "n", F.col("v"), sizes)
    assert "_salt" not in met._jdf.queryExecution().analyzed().toString()
    assert {r["n"] for r in met.collect()} == {3} and met.count() == 6000


def test_rows_that_are_likely_in_another_table(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), F.col("id").cast("string").alias("b"))
    other = rows.where("a IS NULL OR a % 100 = 7").select(F.col("a").alias("x"), F.col("b").alias("y"))
    found = likely_in(rows, other, {"a": "x", "b": "y"})
    assert found.columns == rows.columns
    assert 201 <= found.count() < 300
    assert other.exceptAll(found).count() == 0
    assert likely_in(rows, other.limit(0), {"a": "x", "b": "y"}).count() == 0
