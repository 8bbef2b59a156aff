"""Composite scores of institutions and of predicted impacts.

Scores normalised by a table-wide maximum read it from a one-row scalar
subquery: two column-pruned scans, no shuffle of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactspark import fixed
from impactspark.functions.columns import (
    clip,
    first_present,
    first_with,
    flag,
    mean_of,
    rest_of_max,
    share_of_max,
    total,
    with_totals,
)
from impactspark.functions.exact import exact_mean, exact_sum


def risk_class(score: Column) -> Column:
    """Low up to 33, Medium up to 66, High above, with no tolerance."""
    low, medium = fixed.CLASS_CUTS
    s = score
    return (
        F.when(s <= low, fixed.CLASS_NAMES[0])
        .when(s <= medium, fixed.CLASS_NAMES[1])
        .when(s.isNotNull(), fixed.CLASS_NAMES[2])
    )


def _type_score() -> Column:
    out = F.lit(fixed.RESILIENCE_OTHER)
    for kind, points in fixed.RESILIENCE_BY_TYPE.items():
        out = F.when(F.col("institution_type") == kind, points).otherwise(out)
    return out


def stress_score(df: DataFrame) -> DataFrame:
    """Affordability stress: gap, hours and wage against cost, 0 to 100."""
    gap = first_with(df.columns, "gap")
    hours = first_with(df.columns, "hours", "cover", every=True)
    wage = first_with(df.columns, "wage")
    cost = first_with(df.columns, "net_price", "cost")
    tops = {}
    if gap:
        tops["gap"] = F.col(gap)
    if hours:
        tops["hours"] = F.col(hours)
    if wage and cost:
        tops["ratio"] = F.try_divide(F.col(wage), F.col(cost) + 1)
    if not tops:
        return df.withColumn("affordability_stress_score", F.lit(0.0))
    scored = with_totals(df, **{name: F.max(value) for name, value in tops.items()})
    parts = [
        rest_of_max(value, total(name), 50)
        if name == "ratio"
        else share_of_max(value, total(name), 0)
        for name, value in tops.items()
    ]
    return scored.withColumn("affordability_stress_score", clip(mean_of(parts), 0, 100)).drop("_top")


def equity_indicators(df: DataFrame) -> DataFrame:
    """Four 0/1 indicators, 25 points each, and the risk class."""
    low_income = first_with(df.columns, "low_income", "pell")
    minority = first_with(df.columns, "minority")
    grad = first_with(df.columns, "grad_rate", "graduation_rate")
    stress = first_present(df.columns, ["affordability_stress_score"])
    indicators = {
        "high_low_income": (low_income, lambda c: c > fixed.LOW_INCOME_CUT),
        "high_minority": (minority, lambda c: c > fixed.MINORITY_CUT),
        "low_grad_rate": (grad, lambda c: c < fixed.GRAD_RATE_CUT),
        "high_stress": (stress, lambda c: c > fixed.STRESS_CUT),
    }
    df = df.withColumns(
        {n: flag(test(F.col(c))) if c else F.lit(0) for n, (c, test) in indicators.items()}
    )
    points = sum((F.col(n) for n in indicators), F.lit(0)) * fixed.POINTS_PER_INDICATOR
    return df.withColumn("equity_risk_score", points).withColumn(
        "equity_risk_class", risk_class(F.col("equity_risk_score").cast("double"))
    )


def resilience_score(df: DataFrame) -> DataFrame:
    """Resilience of an institution: size, type and funding dependency."""
    enrollment = first_with(df.columns, "enrollment")
    funding = first_with(df.columns, "funding", "dependency", every=True)
    sized = {n: c for n, c in (("enrollment", enrollment), ("funding", funding)) if c}
    scored = with_totals(df, **{n: F.max(c) for n, c in sized.items()}) if sized else df
    parts = []
    if enrollment:
        parts.append(share_of_max(F.col(enrollment), total("enrollment"), 50))
    if "institution_type" in df.columns:
        parts.append(_type_score())
    if funding:
        parts.append(rest_of_max(F.col(funding), total("funding"), 50))
    score = clip(mean_of(parts), 0, 100) if parts else F.lit(50.0)
    return scored.withColumn("resilience_score", score).drop("_top")


def enhance(df: DataFrame) -> DataFrame:
    """Stress, then equity (which reads stress), then resilience."""
    return df.transform(stress_score).transform(equity_indicators).transform(resilience_score)


def impact_score(df: DataFrame, signed: bool = False) -> DataFrame:
    """Affordability impact of a predicted change.

    The enrollment part is minus an absolute value, so its maximum is never
    positive and it counts as 0; `signed` makes a drop count instead.
    """
    values = {}
    if "tuition_change_dollars" in df.columns:
        values["dollars"] = F.abs("tuition_change_dollars")
    if "hours_to_cover_gap" in df.columns:
        values["hours"] = F.col("hours_to_cover_gap")
    if "enrollment_change_pct" in df.columns:
        change = F.col("enrollment_change_pct")
        values["enrollment"] = -change if signed else -F.abs(change)
    if not values:
        return df.withColumn("affordability_impact_score", F.lit(0.0))
    scored = with_totals(df, **{n: F.max(v) for n, v in values.items()})
    parts = [share_of_max(v, total(n), 0) for n, v in values.items()]
    return scored.withColumn("affordability_impact_score", mean_of(parts)).drop("_top")


def impact_resilience(df: DataFrame, k: int = 20) -> DataFrame:
    """The `k` institutions best able to absorb a predicted change, ranked.

    The top `k` are found per task and merged; only they are numbered.
    """
    enrollment = first_present(df.columns, fixed.ENROLLMENT_SYNONYMS)
    values = {}
    if enrollment:
        values["enrollment"] = F.col(enrollment)
    if "tuition_change_dollars" in df.columns:
        values["dollars"] = F.abs("tuition_change_dollars")
    topped = with_totals(df, **{n: F.max(v) for n, v in values.items()}) if values else df
    parts = []
    if enrollment:
        parts.append(share_of_max(values["enrollment"], total("enrollment"), 50))
    if "dollars" in values:
        parts.append(rest_of_max(values["dollars"], total("dollars"), 100))
    if "institution_type" in df.columns:
        parts.append(_type_score())
    order = [F.desc_nulls_last("resilience_score"), F.asc("institution_id"), F.asc("name")]
    scored = topped.withColumn("resilience_score", mean_of(parts) if parts else F.lit(50.0))
    best = scored.select("institution_id", "name", "resilience_score").orderBy(*order).limit(k)
    return best.withColumn("resilience_rank", F.row_number().over(Window.orderBy(*order)))


def state_vulnerability(df: DataFrame) -> DataFrame:
    """States by how hard they are hit. Ranks run over one row per state."""
    states = (
        df.filter(F.col("state").isNotNull())
        .groupBy("state")
        .agg(
            exact_mean("tuition_change_dollars").alias("avg_tuition_impact"),
            F.coalesce(exact_sum("students_affected"), F.lit(0.0)).alias("total_students_affected"),
            F.count("institution_id").alias("college_count"),
        )
    )
    topped = with_totals(
        states, impact=F.max("avg_tuition_impact"), students=F.max("total_students_affected")
    )
    score = F.try_divide(F.col("avg_tuition_impact"), total("impact")) * 50 + (
        F.try_divide(F.col("total_students_affected"), total("students")) * 50
    )
    scored = topped.withColumn(
        "vulnerability_score", F.when(total("impact") > 0, score).otherwise(F.lit(0.0))
    ).drop("_top")
    order = Window.orderBy(F.desc_nulls_last("vulnerability_score"), F.asc("state"))
    return scored.withColumn("rank", F.row_number().over(order))
