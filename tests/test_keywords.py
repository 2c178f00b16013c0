"""Long blocklists against the plain loop."""

import re

from textguard.operators import keywords as K
from textguard.operators.keywords import keyword_findings

KEYWORDS = ["Project Heron", "a.b+c", "(secret) plan", "naïve Ünder", "x", "C-3", "ſtop sign", "$cash", "o'neil [1]", "nothing like it",
            "$$$", "µm", "Kelvin", "--"]
TEXTS = [
    "the project  heron, no; PROJECT HERON yes", "a.b+c a.bbc", "a (secret) plan: x", "x", "xx x-x", "NAÏVE ÜNDER water, naïveé",
    "c-3 and C-33", "stop sign", "some$cash here", "O'NEIL [1]a o'neil [1]", "éx x", "", "\U0001f600 x", "a$$$b", "$$$", "a $$$", "5 \u03bcm", "\u212aelvin", "$cash", "a--b -- c", "a (secret) plan(secret) plan",
]


def test_keywords_equal_the_plain_loop(spark):
    want = set()
    for i, t in enumerate(TEXTS):
        for k in KEYWORDS:
            m = re.search(r"\b" + re.escape(k) + r"\b", t, re.IGNORECASE)
            if m:
                want.add((i, k, f"[KEYWORD: {m.group()}]", m.start()))
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    k = spark.createDataFrame([(k,) for k in KEYWORDS * 2], "keyword string")
    assert {tuple(r) for r in keyword_findings(d, "id", "text", k).collect()} == want


def test_only_words_that_may_match_are_joined(spark):
    d = spark.createDataFrame([(i, "the red hen and the sly fox met on the way to the sea " * 50) for i in range(20)], "id int, text string")
    k = spark.createDataFrame([("on the way",), ("the big sea",), *[(f"the n{i} of",) for i in range(300)]], "keyword string")
    places = K._places(d, "id", "text", K._listed(k, "keyword"))
    assert places.count() == 20 * 50
    assert {tuple(r) for r in keyword_findings(d, "id", "text", k).collect()} == {(i, "on the way", "[KEYWORD: on the way]", 32) for i in range(20)}
