"""Grouped statistics, group totals on every row, and ranks of groups."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactspark import fixed
from impactspark.functions.columns import has_any, numeric_columns
from impactspark.functions.exact import exact_mean, exact_sum, merged_sum, partial_sums
from impactspark.functions.quantiles import few_groups, group_quantiles, with_rank

log = logging.getLogger(__name__)
DEFAULT_STATS = ("mean", "median", "std", "min", "max", "count")
# "median" is not here: it is exact and takes its own passes
STATS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
}


def group_stats(
    df: DataFrame,
    by: Sequence[str] = ("state", "institution_type"),
    spec: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Statistics per group, named `<column>_<statistic>`.

    Without `spec`: all six default statistics of every numeric column. Keys
    that do not exist are ignored; with no key left the input is returned.
    """
    by = [c for c in by if c in df.columns]
    if not by:
        log.warning("no grouping column exists; returning the input")
        return df
    if spec is None:
        spec = {c: DEFAULT_STATS for c in numeric_columns(df) if c not in by}
    unknown = {s for stats in spec.values() for s in stats} - {*STATS, "median"}
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    keyed = df.dropna(subset=by)
    plain = [STATS[s](c).alias(f"{c}_{s}") for c, stats in spec.items() for s in stats if s != "median"]
    grouped = keyed.groupBy(*by)
    out = grouped.agg(*plain) if plain else keyed.select(*by).distinct()
    medians = [c for c, stats in spec.items() if "median" in stats]
    if medians:
        small = few_groups(keyed, by)
        middle = group_quantiles(keyed, medians, 0.5, by, small)
        middle = middle.select(*by, *[F.col(c).alias(f"{c}_median") for c in medians])
        out = out.join(F.broadcast(middle) if small else middle, by, "left")
    return out.select(*by, *[f"{c}_{s}" for c, stats in spec.items() for s in stats])


def group_means(
    df: DataFrame, by: Sequence[str], spec: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Mean and count of every numeric column, or the given spec."""
    if spec is None:
        numbers = [c for c in numeric_columns(df) if c not in by]
        spec = {c: ("mean", "count") for c in numbers}
    return group_stats(df, by, spec)


def state_rollup(df: DataFrame) -> DataFrame:
    """Per state: head counts summed, everything else averaged."""
    numbers = [c for c in numeric_columns(df) if c not in ("institution_id", "state")]

    def measure(c: str) -> Column:
        if has_any(c.lower(), fixed.HEAD_COUNT_WORDS):
            return F.coalesce(F.sum(c), F.lit(0)).alias(c)
        return F.avg(c).alias(c)

    return (
        df.filter(F.col("state").isNotNull())
        .groupBy("state")
        .agg(*[measure(c) for c in numbers], F.count(F.lit(1)).alias("institution_count"))
    )


def lod(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Group totals attached to every row.

    A window over the group would bring a whole group into one task; totals
    are aggregated first and joined back. Adaptive execution knows their size:
    few are broadcast, otherwise the join's hot keys may be split.
    """
    totals = df.groupBy(*by).agg(*[e.alias(a) for a, e in aggs.items()])
    return df.join(totals, list(by), "left")


def state_lod(df: DataFrame) -> DataFrame:
    return lod(
        df,
        ["state"],
        {
            "state_students_affected": exact_sum("students_affected"),
            "state_avg_tuition_change": exact_mean("tuition_change_dollars"),
        },
    )


def rank_groups(df: DataFrame, by: str, measure: str) -> DataFrame:
    """Groups ranked by a summed measure, equal sums sharing a rank: to 15
    digits, as many as a double keeps of a decimal number."""
    totals = df.groupBy(by).agg(exact_sum(measure).alias("total"))
    total = F.col("total")
    told = F.when(total.isNotNull(), F.format_string("%.14e", total)).cast("double")
    return with_rank(totals, told, "impact_rank")


def compare_scenarios(df: DataFrame, scenario_col: str = "scenario") -> DataFrame:
    """One row per scenario; a measure whose column is missing counts as 0."""
    names, zero = df.columns, F.lit(0.0)
    has = {c: c in names for c in ("tuition_change_dollars", "students_affected", "equity_risk_class")}
    return df.groupBy(F.col(scenario_col).alias("scenario")).agg(
        F.count(F.lit(1)).alias("colleges_count"),
        (exact_mean("tuition_change_dollars") if has["tuition_change_dollars"] else F.max(zero)).alias(
            "avg_tuition_change"
        ),
        (
            F.coalesce(exact_sum("students_affected"), zero) if has["students_affected"] else F.max(zero)
        ).alias("total_students_affected"),
        F.count_if(
            F.col("equity_risk_class") == "High" if has["equity_risk_class"] else F.lit(False)
        ).alias("high_risk_colleges"),
    )


def equity_gap(df: DataFrame) -> DataFrame:
    """Mean dollars of institutions above and up to 50 % of a group, for
    minority and low-income shares; a group with an empty side has no row."""
    if "tuition_change_dollars" not in df.columns:
        raise ValueError("tuition_change_dollars is missing")
    dollars = F.col("tuition_change_dollars")
    rows = []
    for name, column, cut in (
        ("minority_gap", "pct_minority", fixed.MINORITY_CUT),
        ("income_gap", "pct_low_income", fixed.LOW_INCOME_CUT),
    ):
        if column not in df.columns:
            continue
        over, under = F.col(column) > cut, F.col(column) <= cut
        serving, other = exact_mean(F.when(over, dollars)), exact_mean(F.when(under, dollars))
        rows.append(
            F.struct(
                F.lit(name).alias("dimension"),
                serving.alias("serving_avg_impact"),
                other.alias("other_avg_impact"),
                (serving - other).alias("gap"),
                ((F.count_if(over) > 0) & (F.count_if(under) > 0)).alias("both"),
            )
        )
    if not rows:
        raise ValueError("neither pct_minority nor pct_low_income is a column")
    table = df.agg(F.array(*rows).alias("e")).select(F.inline("e"))
    return table.filter("both").drop("both")


def kpis(df: DataFrame) -> DataFrame:
    """The headline numbers. States are counted over one row per state."""
    per_state = df.groupBy("state").agg(
        F.count("institution_id").alias("n"),
        *partial_sums("students_affected", "students"),
        *partial_sums("tuition_change_dollars", "dollars"),
        F.count("tuition_change_dollars").alias("priced"),
        *[F.count_if(F.col("equity_risk_class") == c).alias(c) for c in fixed.CLASS_NAMES],
    )
    return per_state.agg(
        F.sum("n").alias("total_colleges"),
        F.coalesce(merged_sum("students"), F.lit(0.0)).alias("total_students"),
        F.try_divide(merged_sum("dollars"), F.sum("priced")).alias("avg_tuition_change"),
        F.count("state").alias("states"),
        *[F.sum(c).alias(f"{c.lower()}_risk_colleges") for c in fixed.CLASS_NAMES],
    )


def band_impact(df: DataFrame, share: str = "pct_low_income") -> DataFrame:
    """Mean dollars per 25-point band of a percentage column."""
    band = F.lit(fixed.BAND_NAMES[-1])
    for edge, name in reversed(list(zip(fixed.BAND_EDGES, fixed.BAND_NAMES[:-1], strict=True))):
        band = F.when(F.col(share) < edge, name).otherwise(band)
    return (
        df.filter(F.col(share).isNotNull())
        .groupBy(band.alias("band"))
        .agg(
            exact_mean("tuition_change_dollars").alias("avg_tuition_change"),
            F.count(F.lit(1)).alias("college_count"),
        )
    )


def join_equity(predictions: DataFrame, equity: DataFrame, how: str = "left") -> DataFrame:
    """Predictions with the totals of their risk class. The class table is
    broadcast when its length, normally three, has been checked."""
    side = F.broadcast(equity) if few_groups(equity, ["equity_risk_class"]) else equity
    return predictions.join(side, "equity_risk_class", how)


def with_coords(df: DataFrame, coords: DataFrame) -> DataFrame:
    """State coordinates on every row; an unknown state sits at (0, 0)."""
    side = F.broadcast(coords) if few_groups(coords, ["state"]) else coords
    return (
        df.join(side.select("state", "state_lat", "state_lon"), "state", "left")
        .fillna(0.0, subset=["state_lat", "state_lon"])
    )
