"""Detection quality on labelled texts, and differences between rule packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.scan import scan
from textguard.rules import Rule


def accuracy(verdicts: DataFrame) -> DataFrame:
    """Hit rate on attacks and false alarms on benign texts, per detector.

    ``verdicts``: detector, kind (attack or benign), blocked, finding_count.
    For personal data an attack counts as caught when anything was found.
    """
    caught = F.when(F.col("detector") == "pii", F.col("finding_count") > 0).otherwise(F.col("blocked"))
    attack, benign = F.col("kind") == "attack", F.col("kind") == "benign"
    d = verdicts.groupBy("detector").agg(
        F.count_if(attack).alias("attacks"),
        F.count_if(attack & caught).alias("true_positives"),
        F.count_if(benign).alias("benign"),
        F.count_if(benign & F.col("blocked")).alias("false_positives"),
    )
    return d.select(
        "*",
        F.when(F.col("attacks") > 0, F.round(F.col("true_positives") * 100.0 / F.col("attacks"), 1)).cast("double").alias("tp_rate_pct"),
        F.when(F.col("benign") > 0, F.round(F.col("false_positives") * 100.0 / F.col("benign"), 1)).cast("double").alias("fp_rate_pct"),
    )


def confusion(verdicts: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Counts by true label and verdict over the labelled texts."""
    return (
        verdicts.join(labels.select(key, label), key)
        .groupBy(label, "blocked")
        .agg(F.count(F.lit(1)).alias("n_texts"))
    )


def findings_diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Findings that only one of two rule packs reports, with their number ``n``.

    Each side is computed once; equal findings cancel out in one aggregation.
    """
    both = old.select(*columns, F.lit(-1).alias("_d")).unionByName(new.select(*columns, F.lit(1).alias("_d")))
    d = both.groupBy(*columns).agg(F.sum("_d").alias("_d")).where(F.col("_d") != 0)
    change = F.when(F.col("_d") > 0, "added").otherwise("removed")
    return d.select(change.alias("change"), *columns, F.abs("_d").alias("n"))


def pack_changes(df: DataFrame, keys: list[str], text: str, old: list[Rule], new: list[Rule]) -> DataFrame:
    """Findings of ``text`` that only one of two packs reports: change, keys, rule_id, occurrence, position, ``n``.

    A rule in both packs is told by its id and must be the same, so its findings cancel out. The texts are scanned once, with the rules of
    one pack only and those that may end their detector's scan. Packs whose rules end a detector's scan differently are scanned one by one.
    """
    columns = [*keys, "rule_id", "occurrence", "position"]

    def ending(pack):
        return {r.rule_id for r in pack if r.detector == "toxic" and r.shape == "hidden"}

    if ending(old) != ending(new):
        return findings_diff(scan(df, keys, text, old), scan(df, keys, text, new), columns)
    before, after = {r.rule_id for r in old}, {r.rule_id for r in new}
    both = [*old, *[r for r in new if r.rule_id not in before]]
    added, removed = sorted(after - before), sorted(before - after)
    changed = {*added, *removed}
    toxic = any(r.detector == "toxic" for r in both if r.rule_id in changed)
    needed = [r for r in both if r.rule_id in changed or (toxic and r.rule_id in ending(both))]
    found = scan(df, keys, text, needed or both).where(F.col("rule_id").isin(*added, *removed))
    return found.groupBy(F.when(F.col("rule_id").isin(*added), "added").otherwise("removed").alias("change"), *columns).agg(F.count(F.lit(1)).alias("n"))
