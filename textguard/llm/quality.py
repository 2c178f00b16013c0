"""Quality of texts by a regularised quadratic discriminant over document statistics.

A text is a short vector of transformed statistics (logarithms of lengths, arcsines of shares, entropy). Each class is a
normal distribution whose covariance is shrunk towards the common one and towards its diagonal. A score is the difference of the
two log densities, that is of two Mahalanobis distances, taken with Cholesky factors that are worked out once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import fresh, join_groups, stored

NAMES = (
    "log_bytes", "log_words", "log_word_length", "word_length_spread", "upper", "lower", "digit", "blank", "line_feed", "sentence_sign",
    "other_sign", "beyond_ascii", "distinct_words", "commonest_word", "short_words", "entropy", "distinct_lines",
)
DIMS = len(NAMES)
#: Statistics are whole multiples of 1/UNIT, so that sums are exact and do not depend on the order of rows.
UNIT = 1024
#: No statistic exceeds this; sums of products then stay exact for more than 8e9 labelled rows.
LIMIT = 31.0
#: Candidate shares of the common covariance, shares of its diagonal, and divisors of the score; the best on left-out folds are taken.
COMMON = (0.0, 0.1, 0.3, 0.6, 1.0)
DIAGONAL = (0.01, 0.1, 0.3)
FLATTEN = (1.0, 2.0, 4.0, 8.0)
FOLDS = 4
#: Log odds beyond this are cut, so that scores stay below 1 and above 0.
MOST = 30.0

_KIND = np.full(256, 6)  # other signs
_KIND[[32, 9, 11, 12, 13]] = 3
_KIND[10] = 4
_KIND[list(b".,;:!?")] = 5
_KIND[48:58] = 2
_KIND[65:91] = 0
_KIND[97:123] = 1
_KIND[128:] = 7
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _share(part, whole) -> float:
    return float(np.arcsin(np.sqrt(part / whole))) if whole else 0.0


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, in units of 1/``UNIT``; a null text counts as an empty one, whose statistics are all 0."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return np.zeros(DIMS, np.int64)
    data = np.frombuffer(raw, np.uint8)
    seen = np.bincount(data, minlength=256)
    kinds = np.bincount(_KIND, weights=seen, minlength=8)
    words = raw.split()
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8)))
    lengths = edges[1::2] - edges[::2]
    p = seen[seen > 0] / len(data)
    lines = raw.split(b"\n")
    out = [
        np.log1p(len(data)), np.log1p(len(words)),
        np.log1p(lengths.mean()) if len(words) else 0, np.log1p(lengths.std()) if len(words) else 0,
        *[_share(k, len(data)) for k in kinds],
        _share(len(set(words)), len(words)), _share(Counter(words).most_common(1)[0][1] if words else 0, len(words)),
        _share((lengths <= 3).sum(), len(words)), -(p * np.log2(p)).sum(), _share(len(set(lines)), len(lines)),
    ]
    return np.rint(np.clip(out, -LIMIT, LIMIT) * UNIT).astype(np.int64)


def measure(docs: DataFrame, text: str = "text", into: str = "statistics") -> DataFrame:
    """``docs`` with an array of ints: the statistics of the whole text. Narrow; other columns are neither read nor changed."""

    @F.arrow_udf("array<int>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = [statistics(t) for t in part.to_pylist()]
            flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * DIMS), pa.array(flat))

    return docs.withColumn(into, run(F.col(text)))


@dataclass
class Discriminant:
    """A fitted model: two means, two inverted Cholesky factors, and the constant of the log odds."""

    mean: np.ndarray
    whiten: np.ndarray
    constant: float
    flatten: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for rows of statistics."""
        near = [(((x / UNIT - self.mean[c]) @ self.whiten[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return (self.constant + (near[0] - near[1]) / 2) / self.flatten

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -MOST, MOST)))


def discriminant(sums: np.ndarray, common: float, diagonal: float, flatten: float = 1.0) -> Discriminant | None:
    """The model of exact sums (2 classes x (1 + DIMS + DIMS * DIMS)): count, totals, products. None if a class has no row."""
    n = sums[:, 0].astype(float)
    if not n.all():
        return None
    mean = sums[:, 1 : 1 + DIMS] / UNIT / n[:, None]
    products = sums[:, 1 + DIMS :].reshape(2, DIMS, DIMS) / UNIT**2 / n[:, None, None]
    cov = products - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    whiten, log_det = np.zeros_like(cov), np.zeros(2)
    for c in (0, 1):
        mixed = (1 - common) * cov[c] + common * pooled
        # a statistic that never varies still gets a little width
        mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(pooled)) + np.eye(DIMS) / UNIT
        factor = np.linalg.cholesky(mixed)
        whiten[c] = np.linalg.inv(factor)
        log_det[c] = 2 * np.log(np.diag(factor)).sum()
    return Discriminant(mean, whiten, float(np.log(n[1] / n[0]) + (log_det[0] - log_det[1]) / 2), flatten)


def _sums(rows: DataFrame) -> np.ndarray:
    """Exact sums by fold and class; a task gives a small table of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, 2, 1 + DIMS + DIMS * DIMS), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"))
            fold, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "label"))
            for f in range(FOLDS):
                for c in (0, 1):
                    part = x[(fold == f) & (label == c)]
                    total[f, c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "v"])

    out = np.zeros((FOLDS, 2, 1 + DIMS + DIMS * DIMS), np.int64)
    # at most FOLDS * 2 * (1 + DIMS + DIMS * DIMS) rows, whatever the size of the table
    for r in rows.mapInArrow(run, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out.flat[r["cell"]] = r["v"]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS).astype(np.int64)


def _losses(rows: DataFrame, models: dict) -> dict:
    """The summed log loss on left-out rows of every choice (models: by choice and fold)."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value))
        for batch in batches:
            x = _matrix(batch.column("x"))
            fold, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "label"))
            for i, by_fold in enumerate(shared.value.values()):
                for f, model in enumerate(by_fold):
                    if (fold == f).any():
                        odds = np.clip(model.odds(x[fold == f]), -MOST, MOST)
                        total[i] += np.log1p(np.exp(np.where(label[fold == f] == 1, -odds, odds))).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    found = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return {k: next((r["v"] for r in found if r["i"] == i), 0.0) for i, k in enumerate(models)}


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", into: str = "statistics") -> Discriminant | None:
    """The discriminant of all labelled rows of ``measured``: no sample, sums are combined in the tasks.

    Rows with a null id or without a label 0 or 1 teach nothing, and so does an id whose labels contradict each other; an id that
    several rows have teaches with each. None if one of the two classes has no row. How far covariances are shrunk and scores
    flattened is decided by the log loss on left-out quarters of the labelled rows.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    marked = marked.agg(F.min(label).alias("_least"), F.max(label).alias("label")).where("_least = label").drop("_least")
    rows = measured.select(F.col(id_col).alias("_id"), F.col(into).alias("x")).where("_id IS NOT NULL")
    # an id that very many rows have is dealt out over tasks
    often = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("w"))
    marked = stored(marked.join(often, "_id"))
    fold = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold")
    met = join_groups(rows, marked, ["_id"], "w", F.xxhash64("x")).where("label IS NOT NULL")
    rows = stored(met.select("x", F.col("label").cast("int").alias("label"), fold))
    sums = _sums(rows)
    whole = sums.sum(axis=0)
    choices = {}
    for common in COMMON:
        for diagonal in DIAGONAL:
            for flatten in FLATTEN:
                choices[common, diagonal, flatten] = [discriminant(whole - left, common, diagonal, flatten) for left in sums]
    if all(m is not None for models in choices.values() for m in models):
        # rounded, so that the order of sums decides nothing
        loss = {k: round(v, 4) for k, v in _losses(rows, choices).items()}
        best = min(loss, key=lambda k: (loss[k], k))
    else:
        best = (1.0, 0.3, 1.0)
    return discriminant(whole, *best)


def score(measured: DataFrame, model: Discriminant | None, into: str = "score", statistics: str = "statistics") -> DataFrame:
    """``measured`` with a score from 0 to 1 in place of the statistics; 0.5 for every row if nothing was learned. Narrow."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            x = _matrix(part)
            yield pa.array(shared.value.score(x) if shared.value else np.full(len(x), 0.5))

    found = fresh(measured, "found")
    return measured.withColumn(found, run(F.col(statistics))).drop(statistics, into).withColumnRenamed(found, into)


def held_out(id_col: str = "doc_id") -> Column:
    """The third of all ids that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
