"""Language identification by nearest centroids.

A text is a vector of hashed byte n-grams of its lower-case form, weighted by TF-IDF and of length 1.
Every language has several centroids (spherical k-means over labelled texts). A text gets the language of
the centroid with the highest cosine, and is rejected when even that one is farther away than
labelled texts of that language and about that length ever are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import stored

SIZES = (2, 3)
DIMS = 4096
CENTROIDS = 4
#: Labelled texts that a model is fitted on, for each language: a bounded sample, drawn by a hash of the id.
PER_LANGUAGE = 500
#: A text is rejected below this part of the lowest cosine of its language's labelled texts of its size class;
#: where fewer than ``ENOUGH`` of them are, below this part of what all but ``ODD`` of the excerpts of that size reach.
SLACK = 0.6
ENOUGH = 20
ODD = 0.01
CLASSES = 12
UNKNOWN = "und"
#: Bytes worked on at a time, so that memory does not grow with the length of a text.
WINDOW = 1 << 22

_letter = regex.compile(r"\p{L}").search
#: Digits, signs and controls of ASCII become spaces, so that only words count.
_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_MULT = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def grams(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, one row per text. N-grams do not cross texts; whole texts are counted."""
    out = np.zeros((len(texts), DIMS), np.float32)
    i = 0
    raw = [b" " + b" ".join(t.lower().encode("utf-8", "replace").translate(_WORDS).split()) + b" " for t in texts]
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) < WINDOW):
            size += len(raw[j])
            j += 1
        if j == i + 1:
            for at in range(0, max(1, len(raw[i])), WINDOW):
                out[i] += _counts([raw[i][at : at + WINDOW + max(SIZES) - 1]], at + WINDOW < len(raw[i]))[0]
        else:
            out[i:j] = _counts(raw[i:j], False)
        i = j
    return out


def _counts(raw: list[bytes], goes_on: bool) -> np.ndarray:
    """``goes_on``: the last bytes are there for n-grams that begin before them, and begin none themselves."""
    lengths = np.array([len(b) for b in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), lengths)
    left = np.cumsum(lengths)[owner] - np.arange(len(data)) if len(data) else np.zeros(0, int)
    total = np.zeros(len(raw) * DIMS, np.int64)
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * _MULT[k]
        bucket = (h >> np.uint32(15)) % np.uint32(DIMS)
        whole = left[: len(h)] >= (max(SIZES) if goes_on else n)
        total += np.bincount((owner[: len(h)] * DIMS + bucket)[whole], minlength=len(total))
    return total.reshape(len(raw), DIMS).astype(np.float32)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(grams(texts)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    """A fitted model: a few hundred KB for a handful of languages."""

    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine of the best centroid, and whether it is too far away."""
        known = np.array([t is not None and _letter(t) is not None for t in texts], bool)
        names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        rejected = np.ones(len(texts), bool)
        if known.any() and len(self.languages):
            cosine = vectors([t for t, k in zip(texts, known) if k], self.idf) @ self.centres.T
            best = self.owner[cosine.argmax(axis=1)]
            top = np.clip(cosine.max(axis=1), 0, 1)
            names[known] = np.array(self.languages, object)[best]
            score[known] = top
            rejected[known] = top < self.floor[best, size_class([t for t, k in zip(texts, known) if k])]
        return list(names), score, rejected


def size_class(texts: list[str]) -> np.ndarray:
    """Powers of four characters: 0 for 1 to 3, 1 for 4 to 15 and so on."""
    return np.minimum(np.log2(np.maximum([len(t) for t in texts], 1)).astype(int) // 2, CLASSES - 1)


def excerpts(text: str) -> list[str]:
    """One excerpt with a letter for each size class below the text's own, of the least length of the class; from the start of a word if one is near."""
    out = []
    for k in range(size_class([text])[0]):
        n = 4**k
        at = zlib.crc32(b"%d" % k + text[:4096].encode("utf-8", "replace")) % (len(text) - n + 1)
        word = text.find(" ", at, min(len(text) - n, at + 64)) + 1
        at = word or at
        out.append(text[at : at + n])
    return [t for t in out if _letter(t)]


def _k_means(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Centroids:
    """Centroids from the rows of ``labelled`` that have a label and a letter in their text.

    At most about ``per_language`` rows of each language are used, those with the smallest hash of their id;
    the bound does not depend on the size of the table. Their whole texts are counted by the executors.

    Sizes that are rare among them get their floor from excerpts of longer ones, sizes above them that of the
    nearest size below. A language with too few texts gets the lowest floor of the others; nothing is
    rejected only if no language has ``ENOUGH``.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"), F.col(label).alias("l"))
    share = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()
    if not share:
        return Centroids([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros((0, CLASSES)))
    size = 1 << 30
    rates = F.create_map(*[F.lit(v) for r in share for v in (r["l"], min(size, int(size * per_language / r["n"])))])
    drawn = stored(rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(size)) < rates[F.col("l")]).select("t", "l"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[t is not None and _letter(t) is not None for t in batch["t"]]]
            for start in range(0, len(batch), 64):
                part = batch.iloc[start : start + 64]
                texts = list(part["t"])
                yield pd.DataFrame({"l": part["l"], "x": [v.tobytes() for v in grams(texts)], "s": size_class(texts)})

    # a bounded sample: a few thousand vectors
    found = drawn.mapInPandas(count, "l string, x binary, s int").collect()
    languages = sorted({r["l"] for r in found})
    order = sorted(found, key=lambda r: (r["l"], bytes(r["x"])))
    tf = np.sqrt(np.stack([np.frombuffer(r["x"], np.float32) for r in order])) if order else np.zeros((0, DIMS), np.float32)
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    x = tf * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    label_of = np.array([languages.index(r["l"]) for r in order])
    parts = [_k_means(x[label_of == i], CENTROIDS) for i in range(len(languages))]
    sizes = np.array([r["s"] for r in order])
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    model = Centroids(languages, idf, np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32), owner, np.zeros((len(parts), CLASSES)))
    if not languages:
        return model
    cuts = _excerpt_cosines(drawn, model)
    floor = np.full((len(parts), CLASSES), np.nan)
    for i, c in enumerate(parts):
        top = (x[label_of == i] @ c.T).max(axis=1)
        for k in range(CLASSES):
            here, cut = top[sizes[label_of == i] == k], cuts.get((languages[i], k), [])
            if len(here) >= ENOUGH:
                floor[i, k] = SLACK * here.min()
            elif len(here) + len(cut) >= ENOUGH:
                floor[i, k] = SLACK * np.quantile(np.append(here, cut), ODD)
            elif k:
                # longer texts are nearer to their centroids
                floor[i, k] = floor[i, k - 1]
    lowest = np.where(np.isnan(floor), np.inf, floor).min(axis=0)
    model.floor = np.where(np.isnan(floor), np.where(np.isinf(lowest), 0, lowest), floor)
    return model


def _excerpt_cosines(drawn: DataFrame, model: Centroids) -> dict[tuple[str, int], list[float]]:
    """Cosines of the excerpts of the sample with the best centroid of their language, by language and size class."""
    shared = drawn.sparkSession.sparkContext.broadcast(model)

    def cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            for t, l in zip(batch["t"], batch["l"]):
                cuts = excerpts(t) if t is not None and _letter(t) is not None else []
                if cuts:
                    top = (vectors(cuts, m.idf) @ m.centres[m.owner == m.languages.index(l)].T).max(axis=1)
                    yield pd.DataFrame({"l": l, "s": size_class(cuts), "top": top.astype(float)})

    out: dict[tuple[str, int], list[float]] = {}
    # at most CLASSES numbers for each text of the sample
    for r in drawn.mapInPandas(cosines, "l string, s int, top double").collect():
        out.setdefault((r["l"], r["s"]), []).append(r["top"])
    return out


def identify(docs: DataFrame, model: Centroids, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: ``lang``, ``score`` (cosine, 0 to 1) and ``rejected``.

    A null text and one without a letter get ``und``, 0 and rejected; so does any text when nothing was
    learned. Whole texts are read; other columns are neither read nor changed. Narrow: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for start in range(0, len(part), 128):
                texts = [t if isinstance(t, str) else None for t in part.iloc[start : start + 128]]
                lang, score, rejected = shared.value.predict(texts)
                out.append(pd.DataFrame({"lang": lang, "score": score, "rejected": rejected}))
            yield pd.concat(out) if out else pd.DataFrame({"lang": [], "score": [], "rejected": []})

    return docs.withColumn(into, predict(F.col(text)))


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of all ids that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
