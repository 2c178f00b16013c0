"""Line deduplication: lines that many documents share stay in one of them only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import join_groups, join_same, stored, text_of

MIN_CHARS = 40
MIN_DOCS = 5
#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, with A-Z (and no other letter) in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _hashed(line: Column, min_chars: int) -> Column:
    """128 bits of the key, or null for a line too short to count."""
    return F.when(
        F.length(F.btrim(line, F.lit(BLANKS))) >= min_chars,
        F.struct(F.xxhash64(line_key(line)).alias("h1"), F.xxhash64(F.lit(1), line_key(line)).alias("h2")),
    )


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_lines`` before dropping, ``n_dropped``, ``kept_text``.

    A text is split at line feeds; a null or empty one has one empty line. A line whose key has at
    least ``min_chars`` code points and is found in at least ``min_docs`` documents is dropped except
    in the document with the largest id that holds it (all its occurrences there stay). Rows with the
    same id are one document; a null id is smaller than any other. A text may lose all its lines and is
    then empty. An empty table gives an empty result; other columns of ``docs`` are not read.

    Only 128-bit hashes of long lines are counted, per document first. The text moves once, to meet the
    positions of its dropped lines.
    """
    own = docs.select(F.col(id_col).alias("id"), text_of(text).alias("t")).withColumn("row", F.xxhash64("t"))
    marks = F.transform(F.split("t", "\n", -1), lambda line: _hashed(line, min_chars))
    lines = own.select("id", "row", F.posexplode(marks).alias("pos", "h")).where("h IS NOT NULL").select("id", "row", "pos", "h.*")

    key = ["h1", "h2"]
    per_doc = lines.groupBy(*key, "id").agg(F.count(F.lit(1)).alias("n"))
    shared = per_doc.groupBy(*key).agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keep_id"), F.sum("n").alias("n"))
    shared = stored(shared.where(F.col("n_docs") >= min_docs).select(*key, "keep_id", "n"))

    met = join_groups(lines, shared, key, "n", F.xxhash64("id", "pos"))
    lost = met.where(F.col("n").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep_id")))
    drops = lost.groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("drops"))

    out = join_same(own, drops, ["id", "row"])
    # one flag per line up to the last one dropped: gaps between dropped positions, each followed by one drop
    gaps = F.zip_with(
        "drops", F.concat(F.array(F.lit(-1)), F.slice("drops", F.lit(1), F.size("drops") - 1)),
        lambda at, before: F.concat(F.array_repeat(F.lit(False), at - before - 1), F.array(F.lit(True))),
    )
    kept = F.array_join(
        F.zip_with(F.split("t", "\n", -1), F.flatten(gaps), lambda line, drop: F.when(~F.coalesce(drop, F.lit(False)), line)), "\n"
    )
    return out.select(
        F.col("id").alias(id_col),
        F.size(F.split("t", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("t")).otherwise(kept).alias("kept_text"),
    )
