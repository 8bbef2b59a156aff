"""CSV files with line breaks inside quotes, read by as many tasks as they have splits.

Spark cuts a file into splits at any line, and a line may lie inside quotes.
Quotes are doubled in the dialect, so a place is inside quotes if an odd number
of them stands before it. Every split counts its own; a sum over the splits
before tells each where it begins, and records are cut from that. The text is
shuffled once, to the windows of its splits; only a record that crosses a
split's end is put together across them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impactspark.functions.columns import nan_to_null
from impactspark.sources.folders import fresh_dir

QUOTE = '"'


def read_csv_split(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """The rows `read_csv` gives, from UTF-8 files in the same dialect.

    Every file has a header, which is passed over: columns are those of
    `schema`, by position. Quotes stand around fields and doubled in them, as
    the dialect writes them; a lone quote inside a bare field is not understood.
    Order is not kept.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    records = csv_records(spark, path).filter("NOT first").select("record")
    fields = ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(kind.fields))
    options = {"quote": QUOTE, "escape": QUOTE, "nullValue": "\0", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    parsed = records.select(F.from_csv("record", fields, options).alias("r"))
    return nan_to_null(parsed.select(*[F.col("r")[f"c{i}"].alias(f.name) for i, f in enumerate(kind.fields)]))


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record, first): the text of each record, and whether it is its
    file's first. Empty lines between records are none."""
    # a line keeps its carriage return: it may belong to a field
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        "value",
        F.regexp_count("value", F.lit(QUOTE)).alias("quotes"),
    )
    # a row per split
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).alias("inside"))
    folder = fresh_dir(spark, "splits")
    splits.write.parquet(folder)
    splits = spark.read.schema(splits.schema).parquet(folder)
    # a window holds the lines of one split; the quotes before a line in it
    before = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.join(splits, ["file", "split"]).withColumn("open", (F.col("inside") + F.coalesce(F.sum("quotes").over(before), F.lit(0))) % 2 == 1)
    # an empty line outside quotes begins no record
    begins = ~F.col("open") & ~F.col("value").isin("", "\r")
    placed = placed.filter(begins | F.col("open")).withColumn("number", F.sum(begins.cast("int")).over(upto))
    parts = placed.groupBy("file", "split", "number").agg(
        F.sort_array(F.collect_list(F.struct("at", "value"))).alias("lines"), F.max("inside").alias("inside"), F.sum("quotes").alias("quotes")
    )
    parts = parts.withColumn("record", F.array_join("lines.value", "\n"))
    # number 0 goes on with a record of an earlier split; a part with an odd number of quotes goes on in a later one
    crosses = (F.col("number") == 0) | (F.col("quotes") % 2 == 1)
    return _named(parts.filter(~crosses).select("file", "split", "number", "record").unionByName(_across(parts.filter(crosses))))


def _across(parts: DataFrame) -> DataFrame:
    """Records that cross a split's end: at most two parts a split."""
    order = Window.partitionBy("file").orderBy("split", "number")
    chained = parts.withColumn("chain", F.sum((F.col("number") > 0).cast("int")).over(order))
    whole = chained.groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("split", "number", "record"))).alias("p"))
    return whole.select("file", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["number"].alias("number"), F.array_join("p.record", "\n").alias("record"))


def _named(records: DataFrame) -> DataFrame:
    first = (F.col("split") == 0) & (F.col("number") == 1)
    return records.select("file", F.regexp_replace("record", "\r$", "").alias("record"), first.alias("first"))
