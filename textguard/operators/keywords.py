"""Long blocklists: thousands of whole-word keywords against a corpus.

A rule per keyword suits a short list.  For a long one texts and keywords are cut into words and what
lies between them.  A whole-word occurrence of a keyword is then a run of equal parts, and the
longest word of a keyword says where in a text it may lie.  Bitmaps of fixed size, of these words, of all
parts and of whole keywords, tell which runs can be a keyword at all; only these are joined, so the texts themselves never move.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from textguard.functions.dialect import WORD
from textguard.functions.normalize import lowered

_PARTS = f"[{WORD}]+|[^{WORD}]+"
_SPECIAL = r"([\\\[\](){}.*+?^$|#&\-])"
#: A frequent word is dealt out over so many tasks; the keywords are repeated for each.
SALTS = 16
#: Bits of a bitmap.
BITS = 1 << 24
#: Distinct parts of texts that a task remembers at most.
KNOWN = 1 << 20
#: The shape of parts by themselves.
ANY = (0, 0)

_PART = re.compile(r"\w+|\W+")
_BLANK = re.compile(r"[ \t-\r]+")


def _parts(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(_PARTS), F.lit(0))


def _fold(col: Column) -> Column:
    """One form for strings that differ in case only; upper case first, which joins letters such as U+00B5 and U+03BC."""
    upper = F.upper(col)
    return lowered(F.when(F.length(upper) == F.length(col), upper).otherwise(col))


def _listed(keywords: DataFrame, column: str) -> DataFrame:
    """keyword, its folded form, its number of parts, the place of its join part, that part, folded, and whether it has signs at its edges."""
    parts = keywords.where(F.trim(column) != "").select(F.col(column).alias("keyword")).distinct().select("keyword", _parts(F.col("keyword")).alias("p"))
    ranked = F.transform("p", lambda x, i: F.struct(x.rlike(f"^[{WORD}]").alias("word"), F.length(x).alias("n"), (-i).alias("i")))
    best = parts.select("*", (-F.array_max(ranked)["i"]).alias("b"))
    return best.select(
        "keyword", _fold(F.col("keyword")).alias("_f"), F.size("p").alias("_k"), "b", _fold(F.get("p", F.col("b"))).alias("_w"),
        *[(~F.get("p", F.lit(0) if edge == "_first" else F.size("p") - 1).rlike(f"^[{WORD}]")).alias(edge) for edge in ("_first", "_last")],
    )


def _alike(part: str) -> str:
    """One form for parts that ``_fold`` makes equal."""
    return part.lower() if part.isascii() else part.upper().lower()


def _bit(shape: tuple[int, int], part: str) -> int:
    return zlib.crc32(_alike(part).encode("utf-8", "replace"), shape[0] << 16 ^ shape[1]) % BITS


def _on(bits: bytes, at: int) -> int:
    return bits[at >> 3] >> (7 - (at & 7)) & 1


def _bitmaps(listed: DataFrame) -> tuple[list[tuple[int, int]], bytes, bytes, bytes]:
    """The keywords' shapes (parts, place of the join part), the bits of all join parts and of all keywords, each with the shape, and those of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                shape = r["_k"], r["b"]
                rows += [(0, *shape, _bit(shape, r["_w"])), (1, *shape, _bit(shape, r["_f"]))]
                rows += [(2, *shape, _bit(ANY, x)) for x in _PART.findall(r["_f"])]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int32()) for j in range(4)], ["map", "k", "b", "bit"])

    # BITS rows a map and shape at most
    found = listed.select("_k", "b", "_w", "_f").mapInArrow(run, "map int, k int, b int, bit int").distinct().toArrow()
    of, k, b, bit = (c.to_numpy() for c in found.columns)
    hot = np.zeros((3, BITS), bool)
    hot[of, bit] = True
    return sorted(set(zip(k.tolist(), b.tolist()))), *(np.packbits(h).tobytes() for h in hot)


def _places(df: DataFrame, key: str, text: str, listed: DataFrame) -> DataFrame:
    """The runs of parts that may be a keyword: key, _k (parts), b (place of the join part), _part, m (the run), start (its first part), n (parts of the text), position."""
    shared = df.sparkSession.sparkContext.broadcast(_bitmaps(listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, joins, wholes, inside = shared.value

        class Shapes(dict):
            """The shapes of the keywords that a part may join, by part; none for a part that no keyword has."""

            def __missing__(self, part: str) -> list[tuple[int, int]] | None:
                if len(self) > KNOWN:
                    self.clear()
                if part.isascii() and not _on(inside, _bit(ANY, part)):
                    out = None
                else:
                    out = [] if _BLANK.fullmatch(part) else [s for s in shapes if _on(joins, _bit(s, part))]
                self[part] = out
                return out

        known = Shapes()
        for batch in batches:
            found: list[tuple] = []
            for row, t in enumerate(batch.column(1).to_pylist()):
                parts = _PART.findall(t or "")
                n, ends, of = len(parts), None, list(map(known.__getitem__, parts))
                for i, some in enumerate(of):
                    for shape in some or ():
                        start = i - shape[1]
                        if start < 0 or start + shape[0] > n or None in of[start : start + shape[0]]:
                            continue
                        m = "".join(parts[start : start + shape[0]])
                        if _on(wholes, _bit(shape, m)):
                            ends = ends or list(accumulate(map(len, parts)))
                            found.append((row, *shape, parts[i], m, start, n, ends[start] - len(parts[start])))
            rows, *columns = zip(*found) if found else ((),) * 8
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 3]
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(columns, kinds)]], [key, *names])

    names = ["_k", "b", "_part", "m", "start", "n", "position"]
    kinds = [StringType() if c in ("_part", "m") else IntegerType() for c in names]
    return df.select(key, text).mapInArrow(run, StructType([df.schema[key], *map(StructField, names, kinds)]))


def keyword_findings(df: DataFrame, key: str, text: str, keywords: DataFrame, column: str = "keyword") -> DataFrame:
    """The first whole-word occurrence of each keyword in each text, ignoring case.

    A keyword without any word character counts where it is all that lies between two words. Blank keywords are
    left out. Only words that may belong to a keyword are joined, with their neighbours (by broadcast if Spark finds the
    list small), and a word that many texts have is dealt out over tasks.
    """
    listed = _listed(keywords, column)
    words = _places(df, key, text, listed).withColumns({"_w": _fold(F.col("_part")), "_f": _fold(F.col("m"))})
    words = words.withColumn("_salt", F.pmod(F.xxhash64(key, "position"), F.lit(SALTS)).cast("int"))
    salted = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a sign at an edge needs a word beyond it
    whole = (~F.col("_first") | (F.col("start") > 0)) & (~F.col("_last") | (F.col("start") + F.col("_k") < F.col("n")))
    met = words.join(salted, ["_f", "_w", "_k", "b", "_salt"]).where(whole).select(key, "keyword", "m", "position")
    # the fold joins a few letters more than a caseless match does
    pattern = F.concat(F.lit("(?diu)^"), F.regexp_replace("keyword", _SPECIAL, r"\\$1"), F.lit("$"))
    same = met.withColumn("_r", pattern).where(F.expr("m RLIKE _r"))
    first = same.groupBy(key, "keyword").agg(F.min(F.struct("position", "m")).alias("x"))
    return first.select(key, "keyword", F.concat(F.lit("[KEYWORD: "), F.col("x.m"), F.lit("]")).alias("matched_pattern"), F.col("x.position").alias("position"))
