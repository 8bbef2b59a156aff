"""CSV files cut into splits inside quotes."""

from __future__ import annotations

import random

import pytest

from impactspark.registry import ENTRIES
from impactspark.sources import sinks
from impactspark.sources.folders import fresh_dir
from impactspark.sources.scan import read_csv
from impactspark.sources.split_csv import csv_records, read_csv_split

SCHEMA = "id long, text string, number double, note string"


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_splits_inside_quotes(spark, small_splits):
    rng = random.Random(3)
    bits = ["\n", '"', ",", "a", " ", "\r\n", "\n\n", '""', "é", "\\", "\n\"\n", "word", "\n,\n"]
    rows = [(i, "".join(rng.choices(bits, k=rng.choice((0, 1, 5, 40)))), rng.choice((None, 1.5, -2.0)), rng.choice((None, "", "x", " y "))) for i in range(400)]
    rows += [(1000, "long\n" * 2000, None, '"'), (1001, "\n" * 3000, 0.0, None), (None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    path = sinks.write_csv(frame.coalesce(2), f"{fresh_dir(spark, 'csv')}/t.csv")
    found = read_csv_split(spark, path, SCHEMA)
    assert found.schema == frame.schema
    assert csv_records(spark, path).select("file").distinct().count() <= 2
    lines = spark.read.text(path)
    assert lines.rdd.getNumPartitions() > 20  # several tasks a file
    key = lambda r: str(tuple(r))
    assert sorted(found.collect(), key=key) == sorted(read_csv(spark, path, frame.schema).collect(), key=key)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)


def test_small_files(spark, small_splits):
    folder = fresh_dir(spark, "csv")
    for rows in ([], [(1, "a", 1.0, "b")]):
        path = sinks.write_csv(spark.createDataFrame(rows, SCHEMA), f"{folder}/{len(rows)}.csv")
        assert [tuple(r) for r in read_csv_split(spark, path, SCHEMA).collect()] == rows


def test_query_writes_by_all_tasks(spark, small_splits):
    """The query's files are written by the tasks that read the documents, not by one."""
    folder = fresh_dir(spark, "docs")
    docs = spark.createDataFrame([(i, f"line\n{i} " * 50, 400) for i in range(1, 201)], "doc_id long, text string, n_chars long")
    docs.repartition(4, "doc_id").write.parquet(f"{folder}/documents.parquet")
    found = ENTRIES["csv_split"].run(spark, folder)
    assert found.count() == 200
    assert len([f for f in found.inputFiles() if "names.csv" in f]) > 1
