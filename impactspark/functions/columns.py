"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def has_any(name: str, words: Iterable[str]) -> bool:
    return any(w in name for w in words)


def first_with(names: Sequence[str], *words: str, every: bool = False) -> str | None:
    """First column whose lower-cased name contains one (or every) word."""
    test = all if every else any
    return next((n for n in names if test(w in n.lower() for w in words)), None)


def first_present(names: Sequence[str], wanted: Iterable[str]) -> str | None:
    return next((w for w in wanted if w in names), None)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floats become NULL, so that comparisons and max ignore them."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(
        *[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def to_number(col: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    return F.when(col.rlike(NUMBER_TEXT), F.trim(col).try_cast("double"))


def flag(cond: Column) -> Column:
    """0/1 where an undecided comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(col: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (least/greatest alone would drop it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high))))


def mean_of(parts: Sequence[Column]) -> Column:
    """Row mean over the parts that are not NULL; NULL when none is."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return total / F.when(known > 0, known)


def with_totals(df: DataFrame, source: DataFrame | None = None, **exprs: Column) -> DataFrame:
    """`df` with `_top`, a struct of aggregates over the whole of `source`.

    The aggregate is a single row, so it reaches the tasks as a literal scalar
    subquery and needs neither a join nor an unpartitioned window. Drop `_top`
    after use.
    """
    row = (df if source is None else source).agg(
        F.struct(*[e.alias(n) for n, e in exprs.items()]).alias("s")
    )
    return df.withColumn("_top", row.scalar())


def total(name: str) -> Column:
    return F.col("_top")[name]


def share_of_max(value: Column, top: Column, otherwise: float) -> Column:
    """100 * value / top, or a constant for every row when top is not positive."""
    return F.when(top > 0, value / F.when(top > 0, top) * 100).otherwise(F.lit(float(otherwise)))


def rest_of_max(value: Column, top: Column, otherwise: float) -> Column:
    """100 * (1 - value / top), or a constant when top is not positive."""
    rest = (1 - value / F.when(top > 0, top)) * 100
    return F.when(top > 0, rest).otherwise(F.lit(float(otherwise)))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant side."""
    x = F.when(b.isNotNull(), a)
    y = F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def rows_per_column(df: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """Turn a list of struct aggregates over `df` into one row per struct."""
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
