"""Document fingerprints: Merkle trees over sections, paragraphs and clauses.

A text is cut into sections (at empty lines), these into paragraphs (lines), these into clauses (a
sentence, or eight words of it). The hash of a clause is its SHA-256; that of a paragraph, a section and
the document is the SHA-256 of the hashes below it. So equal roots mean equal texts, and where roots
differ, so do the branches down to the edit.

The fingerprint is ``root:section=clause.clause,clause.../section=...``: the root in full, 16 digits of each
section's hash, 8 digits of each clause's, commas between paragraphs. Its parts can be compared without the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions.columns import constant, let

#: Up to seven words that do not end a sentence and one more, with the blanks around them.
CLAUSE = r"\s*(?:\S*[^\s.!?]\s+){0,7}\S+\s*|\s+"
#: Ranges of ids at most: their first ids are broadcast, at most so many rows of three integers.
RANGES = 1 << 16
LEAST_RANGE = 1024


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; a null text counts as empty. An empty paragraph has no clauses."""

    def clauses(paragraph):
        return F.transform(F.regexp_extract_all(paragraph, F.lit(CLAUSE), F.lit(0)), lambda c: F.sha2(c, 256))

    tree = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda section: F.transform(F.split(section, "\n", -1), clauses)
    )
    sections = F.transform(
        tree,
        lambda ps: F.struct(
            _hash(F.transform(ps, _hash)).alias("hash"),
            F.array_join(F.transform(ps, lambda cs: F.array_join(F.transform(cs, lambda h: F.substring(h, 1, 8)), ".")), ",").alias("codes"),
        ),
    )
    return let(
        sections,
        lambda x: F.concat(
            _hash(F.transform(x, lambda s: s["hash"])),
            F.lit(":"),
            F.array_join(F.transform(x, lambda s: F.concat(F.substring(s["hash"], 1, 16), F.lit("="), s["codes"])), "/"),
        ),
    )


def _codes(fp: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fp, F.lit("[=.,]([0-9a-f]{8})"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: twice the clauses they share over all their different clauses (0 to 1); 1 if neither has any."""
    pair = F.struct(_codes(a).alias("a"), _codes(b).alias("b"))
    return let(
        pair,
        lambda p: F.when(F.size(p["a"]) + F.size(p["b"]) == 0, F.lit(1.0)).otherwise(
            2.0 * F.size(F.array_intersect(p["a"], p["b"])) / (F.size(p["a"]) + F.size(p["b"]))
        ),
    )


def first_difference(a: Column, b: Column) -> Column:
    """Of two fingerprints: section and paragraph (from 0) where they first differ; null if they are equal."""

    def branches(fp):
        return F.split(F.substring_index(fp, ":", -1), "/", -1)

    def position(x, y):
        return F.array_min(F.filter(F.zip_with(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), F.transform(y, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda p, q: F.when(~p["v"].eqNullSafe(q["v"]), F.coalesce(p["i"], q["i"]))), lambda i: i.isNotNull()))

    section = F.struct(branches(a).alias("a"), branches(b).alias("b"))
    return F.when(
        a != b,
        let(
            section,
            lambda s: let(
                position(s["a"], s["b"]),
                lambda i: F.struct(
                    i.alias("section"),
                    position(
                        F.split(F.substring_index(F.coalesce(F.get(s["a"], i), F.lit("")), "=", -1), ",", -1),
                        F.split(F.substring_index(F.coalesce(F.get(s["b"], i), F.lit("")), "=", -1), ",", -1),
                    ).alias("paragraph"),
                ),
            ),
        ),
    )


def _cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` whose ``range`` (a first id) is cut get the part that their id lies in."""
    met = rows.join(F.broadcast(cuts), F.col("range") == F.col("_key"), "left")
    # in decimals, as differences of longs may be too large
    off = F.floor((F.col("id").cast("decimal(20,0)") - F.col("_first")) / F.col("_width")) * F.col("_width")
    part = (F.col("_first") + off).cast("long")
    return met.select(*[c for c in rows.columns if c != "range"], F.coalesce(part, F.col("range")).alias("range"))


def in_ranges(own: DataFrame) -> DataFrame:
    """``own`` (id, ...) with ``range``: consecutive ids, of bounded row count whatever the ids; rows without an id share the first one's."""
    ids = own.where("id IS NOT NULL").select("id")
    n, low, high = ids.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    most = max(LEAST_RANGE, -(-(n or 0) // RANGES))
    # a range that holds too many rows is cut into equal parts of what its ids span, until none does or all its ids are equal
    some, levels = ids.withColumn("range", F.lit(low)), []
    full = [(low, low, high, n)] if n and n > most and low < high else []
    while full:
        cuts = [{"_key": key, "_first": a, "_width": -(-(b - a + 1) // (2 * -(-c // most)))} for key, a, b, c in full]
        cuts = constant(cuts, "array<struct<_key: bigint, _first: bigint, _width: decimal(20,0)>>")
        levels.append(own.sparkSession.range(1).select(F.inline(cuts)))
        some = _cut(some, levels[-1])
        parts = some.groupBy("range").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("c"))
        # fewer than RANGES rows
        full = [tuple(r) for r in parts.where((F.col("c") > most) & (F.col("a") < F.col("b"))).collect()]
    own = own.withColumn("range", F.lit(low or 0).cast("long"))
    for cuts in levels:
        own = _cut(own, cuts)
    return own


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", into: str = "next_text") -> DataFrame:
    """id, text and the text of the document with the next smaller id; after the smallest id comes the largest.

    Ids are integers; rows of one id follow each other by the hash of their texts. Rows without an id
    form rings of their own, by the hash of their texts. The texts move once: to ranges of ids, the first document of
    each range also to the range before it.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    own = in_ranges(own)
    # the few ranges of rows without an id have numbers of their own
    alone = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("t"), F.lit(256)) + 1).otherwise(0)
    own = own.withColumn("alone", alone)
    heads = own.groupBy("range", "alone").agg(F.max("id").alias("head"))
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy("range")
    ring = heads.where("alone = 0").withColumn("to", F.coalesce(F.lead("range").over(rising), F.first("range").over(whole)))
    heads = ring.unionByName(heads.where("alone > 0").withColumn("to", F.col("range")))
    heads = heads.select(F.col("range").alias("r"), F.col("alone").alias("o"), "head", "to")
    met = own.join(F.broadcast(heads), (F.col("range") == F.col("r")) & (F.col("alone") == F.col("o")) & F.col("id").eqNullSafe(F.col("head")), "left")
    copies = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("to").alias("range"), F.lit(1).alias("guest")))
    placed = met.select("id", "t", "alone", F.explode(F.when(F.col("to").isNull(), F.slice(copies, 1, 1)).otherwise(copies)).alias("p")).select("id", "t", "alone", "p.*")
    order = Window.partitionBy("range", "alone").orderBy("guest", F.col("id").desc_nulls_last(), F.xxhash64("t"))
    out = placed.withColumn("next", F.lead("t").over(order)).where("guest = 0")
    return out.select(F.col("id").alias(id_col), F.col("t").alias(text), F.col("next").alias(into))
