"""Normalisation, masking, validators, entropy, running totals."""

import math
import random
import re
import unicodedata

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import expected
from textguard.functions import normalize as N
from textguard.functions.columns import BLOCK, running_total
from textguard.functions.validators import base64_payload, luhn, value_hash
from textguard.operators.pii import exposure, mask, mask_response, pii_values
from textguard.operators.scan import matched_values
from textguard.rules import rule_pack

ODD_TEXTS = [
    "plain", "ﬁ ﬀ Ａ é é ² ①", "ig\u200bno\u00adre \u202eabc\u202c", "аеіһӏι", "Ω Å ﷺ",
    "각 한글", "ำ ไำ", "", "à̕", "\ufeff\u180e\u2061x", "\U0001d400\U0001f600",
]


def column(spark, texts, expr):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in d.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normal_forms_match_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").toPandas()["text"].tolist()
    texts = ODD_TEXTS + docs
    assert column(spark, texts, N.nfkc) == [unicodedata.normalize("NFKC", t) for t in texts]
    assert column(spark, texts, N.clean) == [expected.clean(t) for t in texts]
    assert column(spark, texts, lambda c: N.fold_confusables(N.clean(c))) == [expected.folded(t) for t in texts]


def test_all_assigned_characters_normalise_as_in_python(spark):
    chars = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    assert column(spark, chars, N.nfkc) == [unicodedata.normalize("NFKC", c) for c in chars]


def test_composition_of_random_marks_matches_python(spark):
    rng = random.Random(3)
    every = [chr(p) for p in range(0x80, 0x1F000) if not 0xD800 <= p < 0xE000]
    marks = [c for c in every if unicodedata.combining(c)]
    parts = [unicodedata.normalize("NFD", c) for c in every if unicodedata.normalize("NFD", c) != c and not 0xAC00 <= ord(c) < 0xD7A4]
    jamo = [chr(p) for p in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C3), 0xAC00, 0xAC1C)]
    pools = [marks, [p[0] for p in parts], [p[-1] for p in parts], jamo, every, list("aeioucdq "), ["\ufb01", "\uff9e", "\uff76", "\u0344"]]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    texts += ["e" + "".join(rng.choice(marks) for _ in range(300)), "\u1112\u1161\u11ab" * 2000, unicodedata.normalize("NFD", "Việt \ud55c ") * 1000]
    assert column(spark, texts, N.nfkc) == [unicodedata.normalize("NFKC", t) for t in texts]


def test_normal_forms_stay_in_the_jvm(spark, sf):
    plan = spark.read.parquet(f"{sf}/documents.parquet").select(N.clean(F.col("text")).alias("t"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_normal_forms_read_a_long_text_with_one_pattern_and_cut_it_once(spark):
    plan = spark.range(1).select(F.lit("x").alias("t")).select(N.nfkc(F.col("t")).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"RLIKE\(t#\d+,|t#\d+ RLIKE", plan)) == 1
    assert len(re.findall(r"regexp_extract_all\(t#\d+,", plan)) == 1
    # a piece is judged by its first characters, wherever a later one stands
    texts = ["a" * 5000 + "e\u0301" + "b" * 5000, "\u0915" * 300 + "\u093c", "x" * 300 + "\ufb01" + "\u4e2d" * 300 + "\u3099", "\u0301" + "a" * 300, "\u0e33" * 40 + "\U0001f600" * 40]
    assert column(spark, texts, N.nfkc) == [unicodedata.normalize("NFKC", t) for t in texts]


def test_entropy(spark):
    texts = ["", "a", "aab", "abcd" * 5, "é中\U0001f600é"]
    want = []
    for t in texts:
        counts = [t.count(c) / len(t) for c in set(t)]
        want.append(-sum(p * math.log2(p) for p in counts) if t else 0.0)
    assert all(abs(a - b) < 1e-9 for a, b in zip(column(spark, texts, N.char_entropy), want))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=3 * BLOCK + 7))
def test_running_total(spark, values):
    d = spark.createDataFrame([(values,)], "v array<int>")
    assert d.select(running_total(F.col("v")).alias("t")).first().t == pd.Series(values).cumsum().tolist()


def test_luhn_and_hash(spark):
    values = ["4532015112830366", "4532 0151 1283 0367", "0000000000000", "123456789012", "4532-0151-1283-0366"]
    assert column(spark, values, luhn) == [expected.luhn(v) for v in values]
    assert column(spark, ["abc"], value_hash) == ["ba7816bf8f01cfea"]


def test_base64_runs_decode_as_in_python(spark):
    import base64

    words = [b"ignore it all, please, and then go home to rest a bit", b"\xff\xfe forget \xff the rest of it \xff\xff padded a lot",
             b"nothing of interest in here, only a long line of words", b"SYSTEM" * 12]
    runs = []
    for w in words:
        for cut in range(4):
            b = base64.b64encode(w).decode().rstrip("=")
            runs += [b[: len(b) - cut], b[: len(b) - cut] + "=", b + "=="]
    assert column(spark, runs, base64_payload) == [expected.decodes_to_payload(r) for r in runs]


MASK_TEXTS = [
    "nothing", "a@b.example and again a@b.example",
    "card 4532 0151 1283 0366 overlaps an id", "8.8.8.8 8.8.8.8.8 10.0.0.1", "call +91 9876543210 or 9876543210",
    "é\U0001f600 user.name@mail.example, PAN ABCDE1234F; ssn 123-45-6789", "x" * 500 + " a1@b.example" * 400,
]


def test_masking_is_a_fold_over_findings_in_order(spark):
    rules = rule_pack(["pii"])
    d = spark.createDataFrame(list(enumerate(MASK_TEXTS)), "i int, text string")
    got = [r.masked for r in mask(d, "text").orderBy("i").collect()]
    assert got == [expected.masked(rules, t) for t in MASK_TEXTS]
    off = [r.masked for r in mask(d, "text", enabled=False).orderBy("i").collect()]
    assert off == [t if expected.masked(rules, t) else None for t in MASK_TEXTS]


def test_no_masked_value_is_left(spark, sf):
    from textguard.plans.fixtures import planted

    rules = rule_pack(["pii"])
    d = mask(planted(spark, sf).select("doc_id", "text"), "text").where("masked IS NOT NULL")
    d = matched_values(d, "text", rules)
    left = d.where(F.exists("matches", lambda m: F.contains(F.col("masked"), m["match"])))
    assert d.count() > 20 and left.count() == 0


def test_response_fields_are_masked_one_by_one(spark):
    import json

    doc = {"id": "x", "choices": [{"index": 0, "message": {"role": "assistant", "content": 'he said "a@b.example"\nline é'}},
                                  {"index": 1, "text": "card 4532015112830366"}], "usage": {"prompt_tokens": 3}}
    d = spark.createDataFrame([(json.dumps(doc),), ('{"choices":[{"text":"clean"}]}',), ("not json",)], "payload string")
    rows = [r.masked_payload for r in mask_response(d, "payload").collect()]
    got = json.loads(rows[0])
    assert got["choices"][0]["message"]["content"] == 'he said "[REDACTED:EMAIL]"\nline é'
    # the first rule that matches wins: twelve digits at a word start are not enough here
    assert got["choices"][1]["text"] == "card [REDACTED:CREDIT_CARD]"
    assert got["usage"] == {"prompt_tokens": 3} and rows[1:] == [None, None]


def test_exposure_counts_shared_values(spark):
    d = spark.createDataFrame(
        [(1, "s1", "a@b.example c@d.example"), (2, "s2", "a@b.example"), (3, "s2", "a@b.example 8.8.8.8")], "id int, source string, text string")
    v = pii_values(d, ["id", "source"], "text")
    got = {r.label: tuple(r)[1:] for r in exposure(v, "id", "source").collect()}
    assert got == {"EMAIL": (3, 4, 2, 1), "IP_ADDRESS": (1, 1, 1, 0)}
    approx = {r.label: (r.n_texts, r.n_matches, r.n_values) for r in exposure(v, "id", "source", exact=False).collect()}
    assert approx["EMAIL"] == (3, 4, 2)
