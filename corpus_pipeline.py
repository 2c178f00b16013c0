"""A corpus from raw documents to pieces: language, exact copies, near copies, mixture, encoding.

Each stage is one operator of ``textguard.llm`` over all that the stage before kept; its decisions take effect. All stages
but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm.common import fresh, stored
from textguard.llm.exact_dedup import drop_copies
from textguard.llm.language import fit, identify
from textguard.llm.mixing import draw, label_domain, mix
from textguard.llm.ngram_join import drop_near_copies
from textguard.llm.queries import TOKENIZERS
from textguard.llm.sentence_pieces import encode

#: Shares of the mixture's tokens. All documents that are most likely good stay; others are thinned, nothing is repeated.
TARGETS = {"good": 0.94, "low": 0.04, "toxic": 0.02}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too far from every known language for their length, go."""
    found = fresh(docs, "language")
    return identify(docs, fit(docs), into=found).where(~F.col(found)["rejected"]).drop(found)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the smallest id stays."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the expected tokens of each domain near its target; all whose likeliest domain is good stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("domain", label_domain())
    return draw(docs, mix(docs, labels, TARGETS, keep="good", most=1.0))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every whole text in place of the text, and their number."""
    out = encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model", into="piece_ids")
    return out.withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [
    ("language identification", language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing to target weights", mixture),
    ("SentencePiece encoding", pieces),
]

#: No SQL for centroids, near copies, fitted rates and pieces; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
