"""Helpers the operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Hashable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.sources.folders import fresh_dir
from impactspark.sources.scan import read_table

#: a word is a run of anything but ASCII white space, as bytes.split() sees it
WORD = "[^\\x20\\x09-\\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package's code, wherever the driver imported it
    from: Spark serves the archive to every executor, later ones too."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent.parent
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: later steps neither
    recompute it nor depend on the executors that made it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


class Memo(dict):
    """A bounded cache in two generations: when the young one is full it becomes
    the old one, and what is asked for again moves back. Values are a pure
    function of the key, so the bound has no effect on results."""

    def __init__(self, make: Callable[[Hashable], Any], limit: int = 100_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: Hashable) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
