"""Mixing a corpus to target weights of domains, with soft membership.

1. *Classifier.* Domains come from a table of labelled documents. Naive Bayes over words and a few traits of
   the text (share of capitals, signs, digits, different words) gives every document a posterior for every domain.
   Everything is counted and scored with SQL functions.
2. *Rates.* Every document gets a rate r >= 0, how often it should be drawn. Projected gradient
   descent on the weighted squares of (expected tokens of a domain - its target), from r = 1 for all. The gradient is the same
   for all documents but for their posteriors, so all steps together are one number a domain, and a rate is the projection of what they
   leave. Each step is one pass of sums over all documents, which also tries several lengths of the step.
"""

from __future__ import annotations

import logging
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.columns import constant
from textguard.llm.common import fresh, join_same, stored, text_of

_log = logging.getLogger(__name__)

#: Labelled documents that the classifier is fitted on, of each domain: a bounded sample, drawn by a hash of the id.
PER_DOMAIN = 1500
#: Words and traits that count for each domain: those that tell most about it.
TERMS = 150
LEAST_DOCS = 4
#: ... in this share more of the domain's documents than of the others, and in so many times their share.
LEAST_LEAD = 0.02
LEAST_LIFT = 2.0
#: Steps end when all domains are so close to their targets (parts of all tokens), or when none takes off more than this part of the squares.
CLOSE = 1e-5
STILL = 1e-4
#: Lengths that a step is tried with, with and without going on in the direction of the last one.
LENGTHS = (0.5, 1.0, 3.0, 10.0, 40.0, 300.0)
ONWARD = (0.0, 0.7)
#: A bound that no step should meet; what error is left is written to the log.
STEPS = 200

#: What the query and the pipeline mix: shares of all tokens.
TARGETS = {"good": 0.8, "low": 0.15, "toxic": 0.05}


def label_domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The domain of a labelled document: toxic, or else good or low; null where a label is missing."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "good").when(F.col(quality) == 0, "low")


def _terms(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_words`` (runs of letters, lower case) and ``_terms`` (the different ones, and traits)."""
    t = F.coalesce(F.col(text), F.lit(""))

    def trait(name, part, whole):
        return F.concat(F.lit(f"%{name} "), F.floor(F.log2(F.lit(1.0) + 1000.0 * part / F.greatest(whole, F.lit(1)))).cast("string"))

    def count(kind):
        return F.length(t) - F.length(F.translate(t, kind, ""))

    words = F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w != "")
    out = docs.withColumn("_words", words).withColumn("_different", F.array_distinct("_words"))
    traits = F.array(
        trait("capitals", count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.length(t)),
        trait("signs", count("!#$%&*|^~<>"), F.length(t)),
        trait("digits", count("0123456789"), F.length(t)),
        F.concat(F.lit("%different "), F.floor(10.0 * F.size("_different") / F.greatest(F.size("_words"), F.lit(1))).cast("string")),
    )
    return out.withColumn("_terms", F.concat("_different", traits)).drop("_different")


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text: str = "text", per_domain: int = PER_DOMAIN) -> dict:
    """Naive Bayes weights: {"domains", "base" by domain, "weights": {term: [by domain]}}; at most ``TERMS`` terms a domain.

    ``labelled`` has the id and ``domain``; rows without either are left out. About ``per_domain`` documents of
    each domain are used, those with the smallest hash of their id, whatever the size of the table.
    """
    known = labelled.where(F.col(id_col).isNotNull() & F.col("domain").isNotNull()).select(id_col, "domain").dropDuplicates([id_col])
    found = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains, size = sorted(found), 1 << 30
    if not domains:
        return {"domains": [], "base": [], "weights": {}}
    rate = F.element_at(F.create_map(*[F.lit(v) for d in domains for v in (d, min(size, size * per_domain // found[d]))]), F.col("domain"))
    # bounded by per_domain, so it may be broadcast
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(size)) < rate)
    sample = _terms(docs.select(id_col, text).join(F.broadcast(drawn), id_col), text)
    sample = stored(sample.select("domain", "_terms"))
    total = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = [d for d in domains if total.get(d)]
    if not domains:
        return {"domains": [], "base": [], "weights": {}}
    everything = sum(total.values())
    per = [F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]
    counts = sample.select("domain", F.explode("_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), *per)
    counts = counts.where(F.col("n") >= LEAST_DOCS)
    chosen = []
    for i, d in enumerate(domains):
        # what seeing the term tells about the domain
        a, b = F.col(f"n{i}") + 0.5, F.col("n") - F.col(f"n{i}") + 0.5
        inside, outside = a / (total[d] + 1.0), b / (everything - total[d] + 1.0)
        gain = F.log(inside / outside) * (inside - outside)
        chosen.append(counts.where((inside - outside >= LEAST_LEAD) & (inside >= LEAST_LIFT * outside)).orderBy(gain.desc(), "term").limit(TERMS))
    rows = reduce(DataFrame.union, chosen).distinct().collect()
    prior = [found[d] / sum(found[x] for x in domains) for d in domains]
    weights = {}
    for r in sorted(rows, key=lambda r: r["term"]):
        weights[r["term"]] = [math.log((r[f"n{i}"] + 0.5) / (total[d] + 1.0)) for i, d in enumerate(domains)]
    base = [math.log(p) for p in prior]
    return {"domains": domains, "base": base, "weights": weights}


def posteriors(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` (long) and ``posterior`` (array<double> in the order of the domains, adding up to 1)."""
    seen = _terms(docs, text).withColumn("n_words", F.size("_words").cast("long"))
    domains, weights = model["domains"], model["weights"]
    if not domains:
        return seen.withColumn("posterior", F.array().cast("array<double>")).drop("_words", "_terms")
    if not weights:
        hits, table = F.array().cast("array<string>"), None
    else:
        hits = F.array_intersect("_terms", F.array(*[F.lit(t) for t in weights]))
        table = F.create_map(*[v for t, w in weights.items() for v in (F.lit(t), F.array(*map(F.lit, w)))])
    seen = seen.withColumn("_hits", F.transform(hits, lambda t: F.try_element_at(table, t)) if table is not None else F.array().cast("array<array<double>>"))

    def score(k, base):
        return F.aggregate("_hits", F.lit(float(base)), lambda total, w: total + w[k])

    scores = F.array(*[score(k, base) for k, base in enumerate(model["base"])])
    seen = seen.withColumn("_scores", scores).withColumn("_top", F.array_max("_scores"))
    seen = seen.withColumn("_scores", F.transform("_scores", lambda s: F.exp(s - F.col("_top"))))
    seen = seen.withColumn("_sum", F.aggregate("_scores", F.lit(0.0), lambda a, s: a + s))
    seen = seen.withColumn("posterior", F.transform("_scores", lambda s: s / F.col("_sum")))
    return seen.drop("_words", "_terms", "_hits", "_scores", "_top", "_sum")


def _rate(p: list[Column], taken: list[Column], least: Column, most: float | None) -> Column:
    """The rate that the steps leave: 1 less the document's part of each domain, not below ``least`` or above ``most``."""
    left = reduce(lambda a, b: a - b, [x * u for x, u in zip(p, taken)], F.lit(1.0))
    left = F.greatest(left, least)
    return left if most is None else F.least(left, F.lit(float(most)))


def _least(domains: list[str], keep: str | None) -> Column:
    """1 for documents whose likeliest domain is the kept one, 0 for others."""
    if keep not in domains:
        return F.lit(0.0)
    at = F.array_position("posterior", F.array_max("posterior"))
    return F.when(at == domains.index(keep) + 1, 1.0).otherwise(0.0)


def fit_rates(
    seen: DataFrame, domains: list[str], targets: dict[str, float], keep: str | None = None, most: float | None = None
) -> list[float]:
    """What projected gradient descent takes off the rates, by domain; ``seen`` has ``n_words`` and ``posterior``.

    ``targets`` are shares by domain of all tokens there are, or of as many as make the target of the domain
    ``keep`` just what it has; documents whose likeliest domain that is keep a rate of 1 or more. Every step sums tokens over all
    rows in the tasks; only sums, one a domain and length, come to the driver.
    """
    p = [F.col(f"p{k}") for k in range(len(domains))]
    rows = seen.select(F.col("n_words").cast("double").alias("n"), *[F.col("posterior")[k].alias(f"p{k}") for k in range(len(domains))], _least(domains, keep).alias("least"))

    def sums(tried: list[np.ndarray]) -> np.ndarray:
        # what is tried is data, so that all steps share one compiled plan
        each = rows.select("*", F.posexplode(constant([t.tolist() for t in tried], "array<array<double>>")).alias("i", "u"))
        rate = _rate(p, [F.col("u")[k] for k in range(len(domains))], F.col("least"), most)
        out = np.zeros((len(tried), len(domains)))
        for r in each.groupBy("i").agg(*[F.sum(F.col("n") * rate * x).alias(f"s{k}") for k, x in enumerate(p)]).collect():
            out[r["i"]] = [r[f"s{k}"] or 0.0 for k in range(len(domains))]
        return out

    there = np.array([v or 0.0 for v in rows.agg(*[F.sum(F.col("n") * x) for x in p]).first()]) if domains else np.zeros(0)
    whole = there.sum()
    taken = before = np.zeros(len(domains))
    if not whole:
        return taken.tolist()
    budget = there[domains.index(keep)] / targets[keep] if keep in domains and targets.get(keep) else whole
    want = np.array([targets.get(d, 0.0) for d in domains]) * budget
    # squares weighted by one over the domain's tokens: a step of length 1 is then never too long
    weight = np.divide(1.0, there, out=np.zeros(len(there)), where=there > 0)
    off = sums([taken])[0] - want
    for _ in range(STEPS):
        if np.abs(off).max() <= CLOSE * whole:
            return taken.tolist()
        tried = [taken + a * off * weight + b * (taken - before) for a in LENGTHS for b in ONWARD]
        offs = sums(tried) - want
        squares = (offs**2 * weight).sum(axis=1)
        best = int(squares.argmin())
        now = (off**2 * weight).sum()
        if squares[best] >= now * (1 - STILL):
            break
        before, taken, off = taken, tried[best], offs[best]
    missed = ", ".join(f"{d} {o / whole:+.5f}" for d, o in zip(domains, off))
    _log.warning("targets not met, off by parts of all tokens: %s", missed)
    return taken.tolist()


def rated(seen: DataFrame, domains: list[str], targets: dict[str, float], keep: str | None = None, most: float | None = None) -> DataFrame:
    """``seen`` with the ``rate`` that ``fit_rates`` leaves."""
    taken = fit_rates(seen, domains, targets, keep, most)
    return seen.withColumn("rate", _rate([F.col("posterior")[k] for k in range(len(domains))], [F.lit(u) for u in taken], _least(domains, keep), most))


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text: str = "text",
    keep: str | None = None, most: float | None = None,
) -> DataFrame:
    """id, ``text_hash``, ``n_words``, ``domain`` (the likeliest), ``posterior`` (map by domain) and ``rate`` of every row of ``docs``.

    Null and empty texts have no words and any rate is right for them; theirs follows from their
    posterior like any other. Without labels there are no domains: the map is empty and all rates are 1. A target
    that cannot be met (no document leans to the domain) is met as closely as squares allow, and what is missing is written to the log. Ids may be
    null or repeat. ``most`` bounds the rates (1: nothing is drawn twice), and ``keep`` names a domain whose
    documents are all wanted: those it is the likeliest for get a rate of 1 or more, the rates of the others are solved against the
    targets, which are then shares of a corpus that has just its tokens. Other columns are not read. An empty table gives an empty result.
    """
    targets = targets or TARGETS
    model = fit_domains(docs, labelled, id_col, text)
    domains = model["domains"]
    own = docs.select(id_col, text, F.xxhash64(text_of(text)).alias("text_hash"))
    seen = stored(posteriors(own, model, text).select(id_col, "text_hash", "n_words", "posterior"))
    seen = rated(seen, domains, targets, keep, most) if domains else seen.withColumn("rate", F.lit(1.0))
    names = F.array(*map(F.lit, domains)).cast("array<string>")
    likeliest = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int")) if domains else F.lit(None).cast("string")
    return seen.select(
        id_col, "text_hash", "n_words", likeliest.alias("domain"), F.map_from_arrays(names, "posterior").alias("posterior"),
        "rate",
    )


def draw(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` at the rates in ``mixed`` (of ``mix`` over the same rows), all columns kept.

    A row comes as often as the whole part of its rate, and once more for what is left, by a hash of its id and text.
    """
    times, th = fresh(docs, "times"), fresh(docs, "th")
    own = docs.withColumn(th, F.xxhash64(text_of(text)))
    rates = mixed.select(id_col, F.col("text_hash").alias(th), "rate").dropDuplicates([id_col, th])
    u = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col).cast("string"), F.col(th)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    n = F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    rates = rates.withColumn(times, n.cast("int")).where(F.col(times) > 0).select(id_col, th, times)
    met = join_same(own, rates, [id_col, th], "inner")
    return met.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*docs.columns)
