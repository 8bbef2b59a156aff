"""What-if outcomes: from institution and policy columns to predicted change."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactspark import fixed
from impactspark.functions.columns import clip, first_present, rows_per_column
from impactspark.operators.scores import risk_class
from impactspark.sources.folders import cut_lineage


def _known(df: DataFrame, names: Sequence[str], default: float, positive: bool = False) -> Column:
    """First non-NULL of the columns that exist, else the default."""
    cols = [F.col(n).cast("double") for n in names if n in df.columns]
    value = F.coalesce(*cols, F.lit(default))
    return F.when(value > 0, value).otherwise(F.lit(default)) if positive else value


def baselines(df: DataFrame) -> DataFrame:
    """Row values the outcome model needs, with defaults for missing ones."""
    default = fixed.FEATURE_DEFAULTS
    first_price = first_present(df.columns, ["baseline_tuition", "net_price", "tuition"])
    return df.withColumns(
        {
            "baseline_tuition": _known(
                df, [first_price] if first_price else [], default["baseline_tuition"], positive=True
            ),
            "baseline_grad_rate": _known(
                df, ["baseline_grad_rate", "grad_rate", "graduation_rate"], default["baseline_grad_rate"]
            ),
            "_enrollment": _known(df, fixed.ENROLLMENT_SYNONYMS, default["enrollment"], positive=True),
            "_low_income": _known(df, ["pct_low_income", "pell_pct"], default["pct_low_income"]),
            "_minority": _known(df, ["pct_minority"], default["pct_minority"]),
        }
    )


def _dependency(df: DataFrame, detailed_types: bool) -> Column:
    if "institution_type" not in df.columns:
        return F.lit(fixed.DEPENDENCY_PUBLIC)
    kind = F.lower(F.coalesce(F.col("institution_type"), F.lit("public")))
    public = ["public", "community"]
    if detailed_types:
        public += [t.lower() for k in ("public", "community") for t in fixed.TYPE_EXPANSION[k]]
    return F.when(kind.isin(sorted(set(public))), fixed.DEPENDENCY_PUBLIC).otherwise(
        F.lit(fixed.DEPENDENCY_OTHER)
    )


def outcomes(
    df: DataFrame,
    noise: dict[str, Column] | None = None,
    detailed_types: bool = False,
    elasticity: Column | None = None,
    stress_slope: Column | None = None,
) -> DataFrame:
    """Tuition, enrollment and graduation change, risk score and class.

    Needs the four policy columns. Only a type written exactly `public` or
    `community` counts as publicly funded unless `detailed_types` is set.
    """
    e = F.lit(fixed.ELASTICITY) if elasticity is None else elasticity
    s = F.lit(fixed.STRESS_SLOPE) if stress_slope is None else stress_slope
    noise = noise or {}

    def policy(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    def gain(amount: Column, each: float) -> Column:
        return F.greatest(amount, F.lit(0.0)) * each

    df = baselines(df)
    funded = policy("funding_change_pct") * _dependency(df, detailed_types)
    cap, wage = policy("tuition_cap_pct"), policy("min_wage_change")
    childcare = policy("childcare_subsidy") / 1000
    tuition = F.when((cap != 0) & (funded > cap), cap).otherwise(funded)
    df = df.withColumn("tuition_change_pct", tuition + noise.get("tuition", F.lit(0.0)))
    dollars = F.col("baseline_tuition") * F.col("tuition_change_pct") / 100
    df = df.withColumn("_dollars", dollars)
    size = F.abs("_dollars")
    score = (
        F.col("_low_income") / 100 * fixed.LOW_INCOME_WEIGHT
        + F.col("_minority") / 100 * fixed.MINORITY_WEIGHT
        + F.least(size / fixed.STRESS_FULL_DOLLARS, F.lit(1.0)) * fixed.STRESS_WEIGHT
    )
    return (
        df.withColumns(
            {
                "enrollment_change_pct": -(F.col("_dollars") / 1000) * e * 100
                + gain(wage, fixed.WAGE_ENROLLMENT)
                + gain(childcare, fixed.CHILDCARE_ENROLLMENT)
                + noise.get("enrollment", F.lit(0.0)),
                "grad_rate_change": -(size / F.col("baseline_tuition")) * s
                + gain(wage, fixed.WAGE_GRADUATION)
                + gain(childcare, fixed.CHILDCARE_GRADUATION)
                + noise.get("graduation", F.lit(0.0)),
                "equity_risk_score": clip(score, 0, 100),
            }
        )
        .withColumn("equity_risk_class", risk_class(F.col("equity_risk_score")))
        .drop("_dollars", "_enrollment", "_low_income", "_minority")
    )


def numbered(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows with a gap-free index `_row`, in the order of `by` if given.

    A range partitioning orders the rows without a single task that holds all.
    The rows are checkpointed, so that the generated ids stay the same however
    often a task is repeated. Partition sizes are one small row per partition.
    """
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    stable = cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = stable.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stable.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(*df.columns, (F.col("_start") + inside).alias("_row"))
    )


def drawn(seed: int, name: str, key: str = "draw_id") -> Column:
    """A number in [0, 1) fixed by seed, name and draw alone: 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def drawn_normal(seed: int, name: str, key: str = "draw_id") -> Column:
    """A standard normal number from two such uniforms."""
    radius = F.sqrt(-2 * F.log(1 - drawn(seed, f"{name}_radius", key)))
    return radius * F.cos(2 * math.pi * drawn(seed, f"{name}_angle", key))


def sample_scenarios(df: DataFrame, n: int, seed: int = fixed.SEED) -> DataFrame:
    """`n` draws of (institution with replacement, random policy), with noisy
    outcomes. Every number is a digest of seed, quantity and draw, and an
    institution's index its place by id, so a draw does not depend on how the
    rows are dealt out. The indexes are uniform, so the join has no hot key."""
    spark = df.sparkSession
    rows = numbered(df, ["institution_id"])
    total = rows.agg(F.count(F.lit(1))).scalar()
    draws = spark.range(n).withColumnRenamed("id", "draw_id")
    draws = draws.select(
        "draw_id",
        F.floor(drawn(seed, "institution") * total).cast("long").alias("_row"),
        *[(drawn(seed, name) * (high - low) + low).alias(name) for name, (low, high) in fixed.DRAW_RANGES.items()],
        *[(drawn_normal(seed, name) * sigma).alias(f"_noise_{name}") for name, sigma in fixed.NOISE_SIGMA.items()],
    )
    joined = draws.join(rows, "_row")
    noise = {name: F.col(f"_noise_{name}") for name in fixed.NOISE_SIGMA}
    result = outcomes(
        joined, noise, elasticity=F.col("elasticity"), stress_slope=F.col("stress_slope")
    )
    result = result.withColumns(
        {
            "enrollment": _known(
                result, fixed.ENROLLMENT_SYNONYMS, fixed.FEATURE_DEFAULTS["enrollment"], positive=True
            ),
            "pct_low_income": _known(
                result, ["pct_low_income", "pell_pct"], fixed.FEATURE_DEFAULTS["pct_low_income"]
            ),
            "pct_minority": _known(result, ["pct_minority"], fixed.FEATURE_DEFAULTS["pct_minority"]),
        }
    )
    keep = [
        "draw_id", *fixed.POLICY_NUMBERS, "state", "institution_type", "enrollment",
        "pct_low_income", "pct_minority", "baseline_tuition", "baseline_grad_rate",
        "tuition_change_pct", "enrollment_change_pct", "grad_rate_change",
        "equity_risk_score", "equity_risk_class",
    ]
    return result.select(*[c for c in keep if c in result.columns])


def target_summary(df: DataFrame) -> dict[str, DataFrame]:
    """Mean and spread of the numeric targets, and the label distribution."""
    targets = ("tuition_change_pct", "enrollment_change_pct", "grad_rate_change")
    spread = rows_per_column(
        df,
        [
            F.struct(F.lit(t).alias("target"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"))
            for t in targets
        ],
    )
    labels = df.groupBy("equity_risk_class").agg(F.count(F.lit(1)).alias("row_count"))
    return {"targets": spread, "labels": labels}
