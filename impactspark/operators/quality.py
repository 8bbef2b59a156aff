"""Data-quality profile of a table. Each check is one aggregate pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactspark import fixed
from impactspark.functions.columns import (
    has_any,
    numeric_columns,
    rows_per_column,
    string_columns,
    to_number,
    total,
    with_totals,
)
from impactspark.functions.quantiles import column_quantiles


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column: missing count, percentage (2 places) and non-missing count."""
    total = F.count(F.lit(1))
    rows = []
    for c in df.columns:
        gone = total - F.count(F.col(c))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                gone.alias("missing_count"),
                _percent(gone, total).alias("missing_percentage"),
                F.count(F.col(c)).alias("non_missing_count"),
            )
        )
    return rows_per_column(df, rows)


def most_missing(df: DataFrame, k: int | None = None) -> DataFrame:
    """The columns with gaps, worst first; the first `k` if given."""
    worst = missing_profile(df).filter("missing_count > 0").orderBy(F.desc("missing_count"), "column")
    return worst if k is None else worst.limit(k)


def empty_columns(df: DataFrame) -> DataFrame:
    return missing_profile(df).filter("non_missing_count = 0").select("column")


def sparse_numeric(df: DataFrame, k: int | None = None) -> DataFrame:
    """Numeric columns more than half missing, worst first; the first `k` if given."""
    sparse = missing_profile(df.select(*numeric_columns(df))).filter("missing_count > non_missing_count")
    worst = sparse.orderBy(F.desc("missing_count"), "column")
    return worst if k is None else worst.limit(k)


def outliers(df: DataFrame, method: str = "iqr") -> DataFrame:
    """Columns with outliers, by quartile fences or by z-score above 3.

    The quartiles are worked out first (a few numbers per column); the returned
    table counts against them in one pass.
    """
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown method {method!r}")
    columns = numeric_columns(df)
    quart = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = df
    if method == "zscore":
        rows = with_totals(
            df,
            **{f"mean_{i}": F.avg(c) for i, c in enumerate(columns)},
            **{f"std_{i}": F.stddev_samp(c) for i, c in enumerate(columns)},
        )
    found = []
    for i, c in enumerate(columns):
        value, (q1, q2, q3) = F.col(c).cast("double"), quart[c]
        low = high = None
        if q1 is None:
            odd = F.lit(False)
        elif method == "iqr":
            low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            odd = (value < low) | (value > high)
        else:
            odd = F.abs(F.try_divide(value - total(f"mean_{i}"), total(f"std_{i}"))) > 3
        count = F.count_if(odd)
        found.append(
            F.struct(
                F.lit(c).alias("column"),
                count.alias("outlier_count"),
                _percent(count, F.count(F.lit(1))).alias("outlier_percentage"),
                F.lit(low).cast("double").alias("lower_bound"),
                F.lit(high).cast("double").alias("upper_bound"),
                F.min(value).alias("min_value"),
                F.max(value).alias("max_value"),
                F.avg(value).alias("mean"),
                F.lit(q2).cast("double").alias("median"),
            )
        )
    return rows_per_column(rows, found).filter("outlier_count > 0")


def range_checks(df: DataFrame) -> DataFrame:
    """Per numeric column: out-of-range percentages and negative amounts."""
    rows = []
    for c in numeric_columns(df):
        value, none = F.col(c).cast("double"), F.lit(0).cast("long")
        outside = (
            F.count_if((value < 0) | (value > 100)) if has_any(c, fixed.PERCENT_WORDS) else none
        )
        amount = "enrollment" in c or has_any(c, fixed.PRICE_WORDS)
        negative = F.count_if(value < 0) if amount else none
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                outside.alias("outside_percent_range"),
                negative.alias("negative_rows"),
                F.min(value).alias("min_value"),
                F.max(value).alias("max_value"),
                F.when((outside > 0) | (negative > 0), "issues_found")
                .otherwise("valid")
                .alias("status"),
            )
        )
    return rows_per_column(df, rows)


def type_mismatches(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Columns whose Spark type does not contain the expected type name."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(c, t, types[c]) for c, t in expected.items() if c in types and t not in types[c]]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string")


def consistency(df: DataFrame) -> DataFrame:
    """Checks across columns, one row per check that found something."""
    checks = []
    if "enrollment" in df.columns:
        checks.append(("enrollment_positive", F.col("enrollment") < 0, "high"))
    for c in df.columns:
        if "grad_rate" in c or "graduation_rate" in c:
            checks.append((f"{c}_range", (F.col(c) < 0) | (F.col(c) > 100), "medium"))
    if "tuition" in df.columns and "total_cost" in df.columns:
        checks.append(("tuition_vs_total_cost", F.col("tuition") > F.col("total_cost"), "medium"))
    if not checks:
        checks = [("none", F.lit(False), "low")]
    rows = [
        F.struct(
            F.lit(name).alias("check"),
            F.count_if(bad).alias("rows_found"),
            F.lit(severity).alias("severity"),
        )
        for name, bad, severity in checks
    ]
    return rows_per_column(df, rows).filter("rows_found > 0")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one, and their share.

    Rows are told apart by two 64-bit hashes of their values and of where they
    have none, so that long texts stay out of the shuffle.
    """
    content = [*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`").isNull() for c in df.columns]]
    hashes = df.select(F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b"))
    kinds = hashes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"))
    extra = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    total = F.sum("copies")
    return kinds.agg(
        extra.alias("duplicate_rows"), _percent(extra, total).alias("duplicate_percentage")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key column: repeats (NULL counts as a value) and distinct values."""
    total = df.agg(F.count(F.lit(1))).scalar()
    parts = None
    for key in [k for k in keys if k in df.columns]:
        kinds = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("copies"))
        part = kinds.agg(
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count"),
            F.count("k").alias("unique_count"),
        ).select(
            F.lit(key).alias("column"),
            "duplicate_count",
            _percent(F.col("duplicate_count"), total).alias("duplicate_percentage"),
            "unique_count",
        )
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError(f"none of {list(keys)} is a column")
    return parts


def _penalty(found: Column, rule: str) -> Column:
    each, most = fixed.PENALTIES[rule]
    return F.least(found * each, F.lit(most))


def quality_score(df: DataFrame) -> DataFrame:
    """One row: what the checks found and the score out of 100."""
    spark = df.sparkSession
    found = spark.range(1).select(
        missing_profile(df).filter("missing_count > 0").agg(F.count(F.lit(1))).scalar().alias("missing_columns"),
        outliers(df).agg(F.count(F.lit(1))).scalar().alias("outlier_columns"),
        duplicate_rows(df).select("duplicate_rows").scalar().alias("duplicate_rows"),
        consistency(df).agg(F.count(F.lit(1))).scalar().alias("consistency_issues"),
    )
    lost = sum((_penalty(F.col(rule), rule) for rule in fixed.PENALTIES), F.lit(0))
    return found.select(
        "*",
        (F.col("consistency_issues") + fixed.ALWAYS_COUNTED_CHECKS).alias("checks_performed"),
        F.greatest(F.lit(100) - lost, F.lit(0)).alias("overall_quality_score"),
    )


def quality_report(df: DataFrame) -> dict[str, DataFrame]:
    """Every check as a table."""
    report = {
        "missing_values": missing_profile(df),
        "outliers": outliers(df),
        "duplicates": duplicate_rows(df),
        "data_types": range_checks(df),
        "consistency": consistency(df),
        "score": quality_score(df),
    }
    if "institution_id" in df.columns:
        report["key_duplicates"] = duplicate_keys(df, ["institution_id"])
    return report


def completeness(df: DataFrame) -> DataFrame:
    """Share of filled cells over the whole table, with its rating."""
    width = len(df.columns)
    filled = sum((F.count(F.col(c)) for c in df.columns), F.lit(0).cast("long"))
    cells = F.count(F.lit(1)) * width
    table = df.agg(filled.alias("filled"), cells.alias("total_cells"))
    pct = F.try_divide(F.col("filled") * 100.0, F.col("total_cells"))
    rating = F.lit(fixed.COMPLETENESS_LOWEST)
    for least, name in reversed(fixed.COMPLETENESS_RATINGS):
        rating = F.when(pct >= least, name).otherwise(rating)
    return table.select(
        "total_cells",
        (F.col("total_cells") - F.col("filled")).alias("missing_cells"),
        pct.alias("completeness"),
        rating.alias("quality_rating"),
    )


def numeric_like_strings(df: DataFrame) -> DataFrame:
    """Text columns of which more than half the rows read as numbers."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(to_number(F.col(c))).alias("numeric_values"),
            F.count(F.lit(1)).alias("total_rows"),
        )
        for c in string_columns(df)
    ]
    if not rows:
        schema = "column string, numeric_values bigint, total_rows bigint"
        return df.sparkSession.createDataFrame([], schema)
    return rows_per_column(df, rows).filter("numeric_values > total_rows * 0.5")


def key_nulls(df: DataFrame, keys: Sequence[str] = fixed.KEY_CHECK_COLUMNS) -> DataFrame:
    """Missing values in the columns that identify a row."""
    return missing_profile(df.select(*[k for k in keys if k in df.columns])).select(
        "column", "missing_count"
    )


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns and the number of columns of each type."""
    types: dict[str, int] = {}
    for f in df.schema.fields:
        types[f.dataType.simpleString()] = types.get(f.dataType.simpleString(), 0) + 1
    rows = [
        F.struct(
            F.count(F.lit(1)).alias("row_count"),
            F.lit(len(df.columns)).alias("column_count"),
            F.lit(name).alias("type"),
            F.lit(n).alias("columns_of_type"),
        )
        for name, n in types.items()
    ]
    return rows_per_column(df, rows)
