"""Readers, task sizing, the shared folder."""

import pytest

from textguard.sources.shared import shared_folder
from textguard.sources.tables import read_texts, spread

ROWS = [(1, 'plain, "quoted"\nsecond line'), (2, "é \U0001f600")]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats_give_the_same_table(spark, tmp_path, fmt):
    d = spark.createDataFrame(ROWS, "id bigint, text string")
    path = str(tmp_path / f"t.{fmt}")
    options = {"header": True, "escape": '"'} if fmt == "csv" else {}
    d.coalesce(1).write.format(fmt).options(**options).save(path)
    back = read_texts(spark, path, schema="id bigint, text string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == ROWS


def test_text_lines(spark, tmp_path):
    (tmp_path / "lines").write_text("one\ntwo\n")
    assert [r.value for r in read_texts(spark, str(tmp_path / "lines"), fmt="text").collect()] == ["one", "two"]


def test_small_tables_are_cut_and_large_ones_left_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    small = spark.range(0, 100, 1, 1)
    assert spread(small, "id").rdd.getNumPartitions() == 2 * cores
    large = spark.range(0, 100, 1, 2 * cores)
    assert spread(large, "id") is large


def test_each_shared_folder_is_new(spark):
    assert shared_folder(spark) != shared_folder(spark)
