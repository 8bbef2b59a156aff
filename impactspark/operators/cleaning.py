"""Cleaning a merged institution table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark import fixed
from impactspark.functions.columns import (
    has_any,
    numeric_columns,
    string_columns,
    to_number,
    total,
    with_totals,
)
from impactspark.functions.quantiles import column_quantiles

ID_COLUMNS = ("institution_id",)


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Identical rows once. Copies are combined before the shuffle."""
    return df.dropDuplicates()


def fill_numeric(df: DataFrame, id_columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Percent-like columns to 0, other numbers to the column median (else 0).

    One pass counts the gaps, so medians are only worked out where needed. An
    id is not a quantity and keeps its NULLs.
    """
    numbers = [c for c in numeric_columns(df) if c not in id_columns]
    if not numbers:
        return df
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numbers]).first().asDict()
    zero = [c for c in numbers if gaps[c] and has_any(c, fixed.PERCENT_WORDS)]
    median = [c for c in numbers if gaps[c] and c not in zero]
    fill = {c: F.lit(0) for c in zero}
    if median:
        middle = column_quantiles(df, median, [0.5])
        # a whole-number column that receives a median becomes a double column
        fill |= {c: F.lit(middle[c][0] or 0.0) for c in median}
    return df.select(
        *[F.coalesce(F.col(c), fill[c]).alias(c) if c in fill else F.col(c) for c in df.columns]
    )


def fill_strings(df: DataFrame) -> DataFrame:
    texts = string_columns(df)
    return df.fillna("Unknown", subset=texts) if texts else df


def coerce_ids(df: DataFrame, id_columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Ids to whole numbers; what is not a number becomes NULL."""
    texts = string_columns(df)
    for c in id_columns:
        if c in df.columns:
            number = to_number(F.col(c)) if c in texts else F.col(c)
            df = df.withColumn(c, number.try_cast("bigint"))
    return df


def rescale_percent(df: DataFrame) -> DataFrame:
    """Percent columns that lie wholly inside 0..1 are brought to 0..100."""
    percent = [c for c in numeric_columns(df) if has_any(c, fixed.PERCENT_WORDS)]
    if not percent:
        return df
    ends = with_totals(
        df,
        **{f"low_{i}": F.min(c) for i, c in enumerate(percent)},
        **{f"high_{i}": F.max(c) for i, c in enumerate(percent)},
    )
    scaled = {
        c: F.when((total(f"high_{i}") <= 1) & (total(f"low_{i}") >= 0), F.col(c) * 100.0)
        .otherwise(F.col(c))
        .alias(c)
        for i, c in enumerate(percent)
    }
    return ends.select(*[scaled.get(c, F.col(c)) for c in df.columns])


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Columns named like quantities become numbers; bad text becomes NULL."""
    texts = string_columns(df)
    return df.select(
        *[
            to_number(F.col(c)).alias(c)
            if c in texts and has_any(c, fixed.NUMERIC_WORDS)
            else F.col(c)
            for c in df.columns
        ]
    )


def prepare(df: DataFrame) -> DataFrame:
    """Names and duplicates: the part of cleaning that needs one pass."""
    return df.transform(normalise_names).transform(drop_duplicate_rows)


def repair(df: DataFrame, id_columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Gaps and types. The order matters: text gaps are filled before text is
    read as numbers, so those gaps end as NULL again. Reads its input several
    times; give it a stored table when that input is costly."""
    return (
        df.transform(fill_numeric, id_columns)
        .transform(fill_strings)
        .transform(coerce_ids, id_columns)
        .transform(rescale_percent)
        .transform(coerce_numeric)
    )


def clean(df: DataFrame, id_columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """All cleaning steps."""
    return repair(prepare(df), id_columns)
