"""Text normalisation as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textguard.functions.columns import let
from textguard.functions.nfkc import nfkc
from textguard.rules.jailbreak import CONFUSABLES

# Characters removed before matching.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u00ad\u2060\u180e\ufeff\u2061\u2062\u2063\u2064\u206a\u206b"
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"

# The four letters outside ASCII that case-insensitive matching treats as ASCII ones.
ODD_CASE = {"ſ": "s", "\u212a": "k", "İ": "i", "ı": "i"}


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.char_length(col)


def strip_invisible(col: Column) -> Column:
    return F.translate(col, INVISIBLE, "")


def strip_bidi(col: Column) -> Column:
    return F.translate(col, BIDI, "")


def clean(col: Column) -> Column:
    """Invisible and direction marks removed, then NFKC.  ASCII text is its own result."""
    return F.when(is_ascii(col), col).otherwise(let(F.translate(col, INVISIBLE + BIDI, ""), nfkc))


def fold_confusables(col: Column) -> Column:
    """Look-alike letters as Latin ones."""
    return F.translate(col, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))


def lowered(col: Column) -> Column:
    """Lower case such that a caseless match of an ASCII word always contains it."""
    odd = F.lit(False)
    for c in ODD_CASE:
        odd = odd | F.contains(col, F.lit(c))
    plain = F.translate(col, "".join(ODD_CASE), "".join(ODD_CASE.values()))
    return F.lower(F.when(~is_ascii(col) & odd, plain).otherwise(col))


def _bits(text: str) -> float:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return 0.0
    counts = np.bincount(points) if points.max() < 1 << 16 else np.unique(points, return_counts=True)[1]
    counts = counts[counts > 0].astype(np.float64)
    # added one by one, in the order of the characters
    return float(np.log2(len(points)) - np.add.accumulate(counts * np.log2(counts))[-1] / len(points))


def _entropies(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _bits(t) for t in texts.to_pylist()], pa.float64())


def char_entropy(col: Column) -> Column:
    """Shannon entropy over characters in bits; 0 for empty text."""
    return F.arrow_udf(_entropies, DoubleType())(col)
