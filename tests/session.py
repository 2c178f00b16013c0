"""The Spark session of tests and benchmarks."""

import os
import sys

from pyspark.sql import SparkSession


def session(cores: str | None = None, memory: str = "12g") -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    cores = cores or "8"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textguard")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
