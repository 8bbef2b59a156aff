"""Reading institution tables and scenario files."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impactspark import fixed
from impactspark.functions.columns import has_any, nan_to_null

log = logging.getLogger(__name__)


def find_key(columns: Sequence[str], configured: str | None = None) -> str | None:
    """The column that holds the institution id, or None."""
    if configured and configured in columns:
        return configured
    if "institution_id" in columns:
        return "institution_id"
    by_lower = {c.lower(): c for c in columns}
    for name in fixed.KEY_SYNONYMS:
        if name in columns:
            return name
        if name in by_lower:
            return by_lower[name]
    for column in columns:
        low = column.lower()
        if has_any(low, fixed.KEY_FRAGMENTS) and has_any(low, fixed.KEY_FRAGMENT_SUFFIXES):
            return column
    return None


def with_key(df: DataFrame, configured: str | None = None) -> DataFrame:
    key = find_key(df.columns, configured)
    if key is None or key == "institution_id":
        return df
    return df.withColumnRenamed(key, "institution_id")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: the customary dialect: quotes are doubled, line breaks may stand inside quotes, spaces count;
#: a NULL is an empty field, an empty text a quoted one
DIALECT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def csv_reader(spark: SparkSession, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrameReader:
    """A reader of the dialect. A file with line breaks inside quotes is read by
    one task; `multi_line=False` lets Spark split files known to have none."""
    # an unquoted empty field reads as NULL; the mark for NULL is one no file holds,
    # since a quoted empty field would be taken for it
    reader = spark.read.options(**DIALECT, nullValue="\0", emptyValue="", multiLine=multi_line)
    return reader.schema(schema) if schema is not None else reader.option("inferSchema", True)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """Scan a CSV with header. Give the schema to avoid a pass for inference."""
    return nan_to_null(csv_reader(spark, schema, multi_line).csv(path))


def read_sources(
    spark: SparkSession,
    paths: Mapping[str, str],
    keys: Mapping[str, str] | None = None,
    schemas: Mapping[str, T.StructType] | None = None,
    folder: str = "",
) -> dict[str, DataFrame]:
    """Scan every data set that exists and name its key `institution_id`."""
    found = {}
    for name, path in paths.items():
        full = f"{folder}/{path}" if folder else path
        try:
            df = read_csv(spark, full, (schemas or {}).get(name))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            log.warning("%s: nothing at %s, left out", name, full)
            continue
        found[name] = with_key(df, (keys or {}).get(name))
    if not found:
        raise ValueError("none of the data sets could be read")
    return found


def read_scenarios(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None
) -> DataFrame:
    """Many prediction files at once, each row with its `scenario`.

    The scenario is the file (or output folder) name without prefix and suffix.
    """
    reader = csv_reader(spark, schema)
    pattern = r"([^/]+?)(?:\.csv)?(?:/part-[^/]*)?$"
    stem = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    df = reader.csv(list(paths))
    return df.select("*", F.replace(stem, F.lit(fixed.EXPORT_PREFIX), F.lit("")).alias("scenario"))
