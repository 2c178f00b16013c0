"""Scan a corpus with many exact copies: each distinct text once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.scan import FINDING_COLUMNS, scan_rows
from textguard.rules import Rule

SALTS = 16


def scan_distinct(
    df: DataFrame, key: str, text: str, rules: list[Rule] | None = None, context: str = "input", salts: int = SALTS
) -> DataFrame:
    """The rows of ``scan``, but copies of a text share one scan.

    Pays one shuffle of the distinct texts, so it is worth it when copies are common;
    ``scan`` needs no shuffle at all.  Only texts with findings come back, and a text
    copied very often is spread over ``salts`` join keys.
    """
    rows = df.select(key, text, F.sha2(text, 256).alias("_digest"))
    distinct = rows.select("_digest", text).dropDuplicates(["_digest"])
    found = scan_rows(distinct, text, rules, context, "_findings").select(
        "_digest", F.array_compact("_findings").alias("_f"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    flagged = found.where(F.size("_f") > 0)
    copies = rows.select(key, "_digest", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("_salt"))
    joined = copies.join(flagged, ["_digest", "_salt"])
    return joined.select(key, F.inline(F.array_compact("_f"))).select(key, *FINDING_COLUMNS)
