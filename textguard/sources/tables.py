"""Readers for tables of texts and helpers around their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_texts(
    spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None, multi_line: bool = False, **options
) -> DataFrame:
    """A table of texts from parquet, orc, json, csv or text files (by ending, or ``fmt``).

    ``multi_line`` reads CSV fields with line breaks; such a file cannot be split, so it is off by default.
    """
    fmt = fmt or next((f for f in ("parquet", "orc", "json", "csv") if path.rstrip("/").endswith(f)), "parquet")
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=multi_line, escape='"')
    return (reader.schema(schema) if schema else reader).load(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Cut a small table into enough tasks for a CPU-bound scan.

    A table that already gives every core two or more splits is left alone, so the
    texts of a large table are never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores, key)
