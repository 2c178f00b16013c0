"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of characters. Every distinct block gets an integer
name; then adjacent pairs of names get names, level by level, until a document has one. Equal
texts get equal names and different texts different ones, whatever the hash function does: a name is a
bucket (64 bits of hash) and the rank of the block in the sorted list of the bucket's distinct
blocks. The rank is nearly always 0, so it is looked up only in buckets that hold more than one.

Only distinct blocks are shuffled, combined on the map side first; higher levels move pairs of integers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import fresh, join_groups, join_same, stored, text_of

BLOCK = 4096

Bucket = Callable[..., Column]


def _blocks(text: Column, size: int) -> Column:
    """The text in blocks of ``size`` characters; an empty text is one empty block. Linear in the text."""
    return F.when(F.octet_length(text) == 0, F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    )


def _later_ranks(parts: DataFrame, content: list[str]) -> DataFrame | None:
    """Ranks above 0 of the distinct ``content`` within each ``bucket``; None when every bucket holds one."""
    several = stored(
        parts.select("bucket", *content).distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    )
    if several.isEmpty():
        return None
    order = Window.partitionBy("bucket").orderBy(*content)
    ranked = parts.join(several, "bucket", "left_semi").select("bucket", *content).distinct()
    return stored(ranked.withColumn("rank", F.row_number().over(order).cast("long") - 1).where("rank > 0"))


def _ranked(rows: DataFrame, parts: DataFrame, ranks: DataFrame | None, content: list[str]) -> DataFrame:
    """``names`` of ``rows`` with the ranks put in; ``parts`` has them exploded, with ``sha`` and ``pos``."""
    if ranks is None:
        return rows
    found = join_same(parts, ranks, ["bucket", *content], "inner").select("sha", "pos", "rank").distinct()
    by_text = found.groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    put = F.transform(
        "names", lambda x, i: F.struct(x["bucket"].alias("bucket"), F.coalesce(F.try_element_at("ranks", i), x["rank"]).alias("rank"))
    )
    return rows.join(by_text, "sha", "left").withColumn("names", put).drop("ranks")


def name_documents(docs: DataFrame, text: str = "text", block: int = BLOCK, bucket: Bucket = F.xxhash64) -> DataFrame:
    """``docs`` without the text, with ``sha`` (SHA-256, hex) and the collision-free ``name`` of each text."""
    keep = [c for c in docs.columns if c != text]
    own = docs.select(F.struct(*keep).alias("row") if keep else F.struct(F.lit(1).alias("_")).alias("row"), text_of(text).alias("t"))

    def parts_of(rows):
        return rows.select("sha", F.posexplode("names").alias("pos", "x")).select("sha", "pos", "x.*")

    names = F.transform(_blocks(F.col("t"), block), lambda b: F.struct(bucket(b).alias("bucket"), F.lit(0).cast("long").alias("rank")))
    rows = stored(own.select("row", F.sha2("t", 256).alias("sha"), names.alias("names")).withColumn("n_blocks", F.size("names")))
    parts = own.select(F.sha2("t", 256).alias("sha"), F.posexplode(_blocks(F.col("t"), block)).alias("pos", "b")).select(
        "sha", "pos", bucket(F.col("b")).alias("bucket"), "b"
    )
    rows = _ranked(rows, parts, _later_ranks(parts, ["b"]), ["b"])

    # a document with one name is done; the others go up a level at a time, in half as many names
    done, pair = [rows.where("size(names) = 1")], ["a", "a_rank", "b", "b_rank"]
    rows = rows.where("size(names) > 1")
    while not rows.isEmpty():
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.struct(
                F.get("names", 2 * i)["bucket"].alias("a"), F.get("names", 2 * i)["rank"].alias("a_rank"),
                F.get("names", 2 * i + 1)["bucket"].alias("b"), F.get("names", 2 * i + 1)["rank"].alias("b_rank"),
            ),
        )
        two = stored(rows.withColumn("names", pairs))
        parts = two.select("sha", F.posexplode("names").alias("pos", "x")).select("sha", "pos", "x.*").withColumn("bucket", bucket(*pair))
        named = F.transform("names", lambda p: F.struct(bucket(*[p[c] for c in pair]).alias("bucket"), F.lit(0).cast("long").alias("rank")))
        rows = stored(_ranked(two.withColumn("names", named), parts, _later_ranks(parts, pair), pair))
        done.append(rows.where("size(names) = 1"))
        rows = rows.where("size(names) > 1")
    rows = reduce(DataFrame.unionByName, done)
    name = F.struct("n_blocks", F.get("names", F.lit(0))["bucket"].alias("bucket"), F.get("names", F.lit(0))["rank"].alias("rank"))
    return rows.select(*[F.col("row")[c].alias(c) for c in keep], "sha", name.alias("name"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK, bucket: Bucket = F.xxhash64
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical; a null text equals an empty one. Of equal texts the row with the
    largest id stays. Rows with a null id stay only if no other copy has an id. Rows repeated with
    the same id and text count in ``group_size`` and carry the same decision; ``drop_copies`` then
    leaves one of them. An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    named = stored(name_documents(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", block, bucket))
    named = named.select("id", "sha", "name.*")
    key = ["n_blocks", "bucket", "rank"]
    groups = stored(named.groupBy(*key).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    out = join_groups(named, groups, key, "group_size", F.col("id"))
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    sha = fresh(docs, "sha")
    staying = exact_duplicates(docs, id_col, text).where("kept").select(id_col, F.col("text_sha256").alias(sha)).distinct()
    met = join_same(docs.withColumn(sha, F.sha2(text_of(text), 256)), staying, [id_col, sha], "left_semi")
    return met.dropDuplicates([id_col, sha]).drop(sha)
