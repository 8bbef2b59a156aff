"""Statistics over numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import batched, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark.functions.columns import (
    numeric_columns,
    rows_per_column,
    safe_corr,
    total,
    with_totals,
)
from impactspark.functions.quantiles import column_quantiles

PAIRS_PER_PASS = 400  # keeps one aggregate inside the code-generation limits


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max and median of each numeric column.

    The quartiles are worked out first; the rest is one pass.
    """
    columns = list(columns or numeric_columns(df))
    quart = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = []
    for c in columns:
        v = F.col(c).cast("double")
        q25, q50, q75 = [F.lit(q).cast("double") for q in quart[c]]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                q25.alias("q25"),
                q50.alias("q50"),
                q75.alias("q75"),
                F.max(v).alias("max"),
                q50.alias("median"),
            )
        )
    return rows_per_column(df, rows)


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix in long form (column_a, column_b, correlation), over the
    pairs of rows where both are known."""
    columns = list(columns or numeric_columns(df))
    out = None
    for chunk in batched(combinations_with_replacement(columns, 2), PAIRS_PER_PASS):
        rows = [
            F.struct(
                F.lit(a).alias("column_a"),
                F.lit(b).alias("column_b"),
                safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("correlation"),
            )
            for a, b in chunk
        ]
        part = rows_per_column(df, rows)
        out = part if out is None else out.unionByName(part)
    value = F.col("correlation").alias("correlation")
    pair = F.struct(F.col("column_a").alias("column_a"), F.col("column_b").alias("column_b"), value)
    turned = F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), value)
    own = F.col("column_a") == F.col("column_b")
    return out.select(F.inline(F.when(own, F.array(pair)).otherwise(F.array(pair, turned))))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The same as a square table."""
    columns = list(columns or numeric_columns(df))
    long = correlations(df, columns)
    return long.groupBy(F.col("column_a").alias("column")).pivot("column_b", columns).agg(
        F.first("correlation")
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins with counts; the last bin includes the maximum. A
    constant column has one bin."""
    ends = with_totals(
        df,
        **{f"low_{i}": F.min(F.col(c).cast("double")) for i, c in enumerate(columns)},
        **{f"high_{i}": F.max(F.col(c).cast("double")) for i, c in enumerate(columns)},
    )
    cells = ends.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(c).cast("double").alias("v"),
                        total(f"low_{i}").alias("low"),
                        total(f"high_{i}").alias("high"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    ).filter(F.col("v").isNotNull())
    wide = F.col("high") > F.col("low")
    at = F.floor((F.col("v") - F.col("low")) / F.when(wide, F.col("high") - F.col("low")) * bins)
    numbered = cells.withColumn("bin", F.when(wide, F.least(at, F.lit(bins - 1)) + 1).otherwise(F.lit(1)))
    width = (F.col("high") - F.col("low")) / bins
    return (
        numbered.groupBy("column", "low", "high", "bin")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            "column",
            F.col("bin").cast("int").alias("bin"),
            (F.col("low") + width * (F.col("bin") - 1)).alias("bin_low"),
            (F.col("low") + width * F.col("bin")).alias("bin_high"),
            "row_count",
        )
    )


def boxplot_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (furthest values inside 1.5 IQR) and outlier count."""
    quart = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = []
    for c in columns:
        v, (q1, q2, q3) = F.col(c).cast("double"), quart[c]
        if q1 is None:
            inside = F.lit(True)
        else:
            inside = (v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                *[F.lit(q).cast("double").alias(n) for n, q in (("q25", q1), ("median", q2), ("q75", q3))],
                F.min(F.when(inside, v)).alias("whisker_low"),
                F.max(F.when(inside, v)).alias("whisker_high"),
                F.count_if(~inside).alias("outlier_count"),
            )
        )
    return rows_per_column(df, rows)


def score_summary(df: DataFrame, column: str = "affordability_impact_score") -> DataFrame:
    """Mean, median and maximum of a score."""
    middle = column_quantiles(df, [column], [0.5])[column][0]
    return df.agg(
        F.avg(column).alias("mean"),
        F.lit(middle).cast("double").alias("median"),
        F.max(column).alias("max"),
    )
