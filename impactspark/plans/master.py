"""Building and profiling the master table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from impactspark.operators import quality
from impactspark.operators.cleaning import prepare, repair
from impactspark.operators.duplicates import duplicate_report
from impactspark.operators.merging import outer_merge
from impactspark.operators.scores import enhance
from impactspark.operators.stats import describe
from impactspark.sources.folders import cut_lineage
from impactspark.sources.sinks import write_csv


@dataclass
class Master:
    table: DataFrame
    cleaned: DataFrame

    def quality(self) -> dict[str, DataFrame]:
        return quality.quality_report(self.cleaned)


def build_master(tables: Mapping[str, DataFrame], out: str | None = None) -> Master:
    """Merge, clean, check, score.

    The merged and the cleaned table are stored (under `out`, else as
    checkpoints), because the steps after them read them several times.
    Quality is measured after cleaning and before scoring. Rows without an id
    are kept, each as a row of its own: met all with all, they would multiply.
    """

    def stored(df: DataFrame, name: str) -> DataFrame:
        if not out:
            return cut_lineage(df)
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return df.sparkSession.read.parquet(f"{out}/{name}")

    cleaned = stored(repair(stored(prepare(outer_merge(tables, null_keys="apart")), "merged")), "cleaned")
    scored = enhance(cleaned)
    if out:
        write_csv(scored, f"{out}/master.csv")
    return Master(scored, cleaned)


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """A raw table described as tables."""
    out = {
        "overview": quality.overview(df),
        "missing": quality.most_missing(df),
        "empty_columns": quality.empty_columns(df),
        "sparse_numeric": quality.sparse_numeric(df),
        "numeric_like_strings": quality.numeric_like_strings(df),
        "duplicates": quality.duplicate_rows(df),
        "completeness": quality.completeness(df),
        "statistics": describe(df),
    }
    key = next((k for k in ("institution_id", "unit_id") if k in df.columns), None)
    if key:
        out["key_duplicates"] = quality.duplicate_keys(df, [key])
        out |= {f"duplicate_{k}": v for k, v in duplicate_report(df, key).items()}
    if any(k in df.columns for k in quality.fixed.KEY_CHECK_COLUMNS):
        out["key_nulls"] = quality.key_nulls(df)
    return out
