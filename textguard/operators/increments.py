"""Scan a growing corpus run by run: texts that an earlier run has scanned are not scanned again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.scan import FINDING_COLUMNS, scan_rows
from textguard.rules import Rule


def _known(df: DataFrame, store: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_new(df: DataFrame, key: str, text: str, store: str, run: int, rules: list[Rule] | None = None, context: str = "input") -> DataFrame:
    """The rows of ``scan`` for all of ``df``, of which only texts are scanned that ``store`` does not know.

    The store holds the digest of every text that was scanned and what was found in it, in a folder for each run; a run
    that is repeated replaces its folder. A store belongs to one rule pack and context. Null texts are never
    stored and have no findings. The result is read from the store: digests are joined, texts do not move but the new ones.
    """
    rows = df.select(key, text, F.sha2(text, 256).alias("_digest")).where("_digest IS NOT NULL")
    known = _known(df, store)
    if known is not None:
        known = known.where(F.col("run") != run)
    new = rows if known is None else rows.join(known.select("_digest"), "_digest", "left_anti")
    found = scan_rows(new.select("_digest", text).dropDuplicates(["_digest"]), text, rules, context, "_findings")
    found.select("_digest", F.array_compact("_findings").alias("_findings")).write.mode("overwrite").parquet(f"{store}/run={run}")
    flagged = df.sparkSession.read.parquet(store).where(F.size("_findings") > 0)
    return rows.select(key, "_digest").join(flagged, "_digest").select(key, F.inline("_findings")).select(key, *FINDING_COLUMNS)
