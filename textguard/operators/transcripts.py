"""Conversations as transcripts, and many-shot checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions.normalize import clean, fold_confusables
from textguard.operators.scan import harmful_words, pair_count
from textguard.rules.jailbreak import MANY_SHOT_PAIRS

BLOCK = 1024


def transcripts(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One ``Role: text`` transcript per conversation, of all its messages in the order of the turns.

    Two steps: blocks of consecutive turns become strings first, then the strings of a conversation are
    joined, so no task collects the messages of a long conversation. The transcript itself is one
    string by definition.
    """
    line = F.concat(F.initcap(role), F.lit(": "), F.col(text)).alias("line")
    blocks = messages.groupBy(conv, F.floor(F.col(turn) / BLOCK).alias("_block")).agg(
        F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), line))).alias("_m")
    )
    strings = blocks.select(conv, "_n", F.struct("_block", F.array_join(F.transform("_m", lambda x: x["line"]), "\n").alias("s")).alias("_b"))
    joined = strings.groupBy(conv).agg(F.sum("_n").alias("message_count"), F.array_sort(F.collect_list("_b")).alias("_b"))
    return joined.select(conv, "message_count", F.array_join(F.transform("_b", lambda b: b["s"]), "\n").alias("transcript"))


def many_shot(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Compliant pairs and harmful words of each text, and whether both are too many."""
    d = df.select(*keys, clean(F.col(text)).alias("_c")).select(*keys, fold_confusables(F.col("_c")).alias("_t"))
    d = d.select(*keys, F.expr(pair_count("_t")).alias("pairs"), F.expr(harmful_words("lower(_t)")).alias("harmful_words"))
    return d.select("*", ((F.col("pairs") >= MANY_SHOT_PAIRS) & (F.col("harmful_words") >= 1)).alias("many_shot"))
