"""Repeated institution ids: true duplicates or different records?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _variants(df: DataFrame, key: str) -> DataFrame:
    """Distinct rows with their number of copies. A hot id is spread over its
    variants, and copies are combined before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies")).filter(F.col(key).isNotNull())


def classify_ids(df: DataFrame, key: str) -> DataFrame:
    """Per id with several rows: row count, kind, and the columns that differ.

    NULL equals NULL. A column differs inside an id when its smallest and
    largest value differ or only some of its values are missing.
    """
    others = [c for c in df.columns if c != key]
    differing = [
        F.when(
            (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))), F.lit(c)
        )
        for c in others
    ]
    kind = F.when(F.size("different_columns") == 0, "true_duplicate").otherwise("different_records")
    return (
        _variants(df, key)
        .groupBy(key)
        .agg(
            F.sum("_copies").alias("row_count"),
            F.array_compact(F.array(*differing)).alias("different_columns"),
        )
        .filter("row_count > 1")
        .select(
            key,
            "row_count",
            kind.alias("kind"),
            F.size("different_columns").alias("different_count"),
            "different_columns",
        )
    )


def classify_summary(df: DataFrame, key: str) -> DataFrame:
    """One row: repeated ids by kind, and what to do about them."""
    same, other = F.col("true_duplicates"), F.col("different_records")
    return (
        _variants(df, key)
        .groupBy(key)
        .agg(F.sum("_copies").alias("rows"), F.count(F.lit(1)).alias("kinds"))
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_with_key"),
            F.count(F.lit(1)).alias("unique_keys"),
            F.count_if(F.col("rows") > 1).alias("duplicated_keys"),
            F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows"))), F.lit(0)).alias("duplicated_rows"),
            F.count_if((F.col("rows") > 1) & (F.col("kinds") == 1)).alias("true_duplicates"),
            F.count_if((F.col("rows") > 1) & (F.col("kinds") > 1)).alias("different_records"),
        )
        .withColumn(
            "recommendation",
            F.when(same > other, "remove_duplicates")
            .when(other > same, "add_distinguishing_column")
            .otherwise("review_source"),
        )
    )


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """How many ids occur twice, three times, and so on."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows_per_key"))
        .filter("rows_per_key > 1")
        .groupBy("rows_per_key")
        .agg(F.count(F.lit(1)).alias("key_count"))
    )


def duplicate_report(df: DataFrame, key: str = "institution_id") -> dict[str, DataFrame]:
    return {
        "ids": classify_ids(df, key),
        "summary": classify_summary(df, key),
        "distribution": multiplicity(df, key),
    }
