"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="textguard-llm-")


def shared_path(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps survive the loss of any executor."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> DataFrame:
    """``df`` stored, and the shuffle files that led to it given up.

    Spark removes these files once the driver's JVM has collected the plans that point to them, which a driver with little to do may put off to
    the end. So large steps ask for it.
    """
    spark, out = df.sparkSession, stored(df)
    del df  # it holds the plan, and so does Spark's listener until another query has ended
    out.isEmpty()
    spark.sparkContext._jvm.System.gc()
    return out


def measured(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """``df`` stored, and aggregates of its rows that are taken while it is written: no query of their own."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(k) for k, c in sums.items()]))
    return out, seen.get


def measured_groups(df: DataFrame, weight: str) -> tuple[DataFrame, dict]:
    """``df`` stored, and what ``join_groups`` wants to know about it."""
    return measured(df, **_sizes(weight))


def _sizes(weight: str) -> dict[str, Column]:
    return {"total": F.sum(weight), "most": F.max(weight), "count": F.count(F.lit(1))}


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on ``keys`` in which nulls match; the keys of ``right`` are left out of the result."""
    other = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in keys])


SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, spread: Column, sizes: dict | None = None) -> DataFrame:
    """``rows`` left-joined with ``groups``, which has one row per key and, in ``weight``, the rows that have it.

    A key with more than a thousandth of all rows is one of fewer than a thousand such keys: these go by
    broadcast, and their rows are dealt out by ``spread``. All others meet in a shuffle join, so no
    task gets more than its share from one key. A thousand groups or fewer all go by broadcast; without
    a heavy key there is none. Every exchange costs the driver a thread and its memory for a minute.
    ``groups`` is read up to three times and should be stored; ``measured_groups`` gives ``sizes``, too.
    """
    sizes = sizes or groups.agg(*[c.alias(k) for k, c in _sizes(weight).items()]).first().asDict()
    total, most, count = sizes["total"], sizes["most"], sizes["count"]
    values = [c for c in groups.columns if c not in keys]
    if count <= SHARE or most * SHARE <= total:
        one = groups.select(*keys, F.struct(*values).alias("_found"))
        out = rows.join(F.broadcast(one) if count <= SHARE else one, keys, "left")
        return out.select(*rows.columns, *[F.col("_found")[v].alias(v) for v in values])
    heavy = F.col(weight) * SHARE > F.lit(total)
    hot = groups.where(heavy).select(*keys, F.struct(*values).alias("_hot"))
    cold = groups.where(~heavy).select(*keys, F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    salt = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).otherwise(F.lit(0).cast("long"))
    out = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    found = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[found[v].alias(v) for v in values])


#: Bits that are broadcast at most.
MARKS = 1 << 24


def marks_of(other: DataFrame, columns: list[str]) -> DataFrame:
    """A bit for each hash of ``columns``, in a table of bounded size for ``parted``. Nulls count as equal."""
    return other.select(_place(columns)).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(_bit()).alias("_bits"))


def _place(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(MARKS)).alias("_place")


def _bit() -> Column:
    return F.expr("shiftleft(1L, cast(_place & 63 as int))")


def parted(rows: DataFrame, marks: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Those ``rows`` whose ``columns`` may be among those marked (others may pass, too), and those that surely are not."""
    out = rows.select("*", _place(columns)).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(marks), "_word", "left")
    there = F.coalesce(F.col("_bits").bitwiseAND(_bit()), F.lit(0).cast("long")) != 0
    return out.where(there).select(*rows.columns), out.where(~there).select(*rows.columns)


def likely_in(rows: DataFrame, other: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Those ``rows`` whose ``keys`` (their columns, and those of ``other``) may be in ``other``, so that few others go to a shuffle join."""
    return parted(rows, marks_of(other, list(keys.values())), list(keys))[0]
