"""Calculated fields for dashboards. All are row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactspark import fixed


def _dollars() -> Column:
    return F.col("tuition_change_dollars")


def severity(df: DataFrame) -> DataFrame:
    """Both published severity scales: by thresholds, and by closed bins."""
    field = F.lit(fixed.SEVERITY_FIELD_ELSE)
    for cut, name in reversed(fixed.SEVERITY_FIELD):
        field = F.when(_dollars() > cut, name).otherwise(field)
    binned = F.lit(fixed.SEVERITY_BINS_LAST)
    for edge, name in reversed(fixed.SEVERITY_BINS):
        binned = F.when(_dollars() <= edge, name).otherwise(binned)
    return df.withColumns(
        {
            "impact_severity": field,
            "impact_severity_bin": F.when(_dollars().isNotNull(), binned),
        }
    )


def impact_category(df: DataFrame) -> DataFrame:
    crisis = (_dollars() > fixed.CRISIS_DOLLARS) & (F.col("pct_low_income") > fixed.LOW_INCOME_CUT)
    return df.withColumn(
        "impact_category",
        F.when(crisis, "Crisis")
        .when(_dollars() > fixed.HIGH_IMPACT_DOLLARS, "High Impact")
        .otherwise("Manageable"),
    )


def risk_fields(df: DataFrame) -> DataFrame:
    """Risk label (anything else is low) and colour (unknown has none)."""
    label = F.lit(fixed.RISK_LABEL_ELSE)
    colour = F.lit(None).cast("string")
    for name, text in fixed.RISK_LABELS.items():
        label = F.when(F.col("equity_risk_class") == name, text).otherwise(label)
    for name, code in fixed.RISK_COLOURS.items():
        colour = F.when(F.col("equity_risk_class") == name, code).otherwise(colour)
    return df.withColumns({"risk_label": label, "risk_color": colour})


def formatted(df: DataFrame) -> DataFrame:
    """Money text, percent text and whole students."""
    return df.withColumns(
        {
            "formatted_tuition_change": F.concat(F.lit("$"), F.format_number(_dollars(), 0)),
            "formatted_tuition_pct": F.concat(F.col("tuition_change_pct").cast("string"), F.lit("%")),
            "formatted_students": F.round("students_affected", 0),
        }
    )


def before_after(df: DataFrame) -> DataFrame:
    """Baseline and predicted value of price and graduation rate, one row per
    institution and measure."""

    def entry(measure: str, after: str, change: str) -> Column:
        return F.struct(
            F.lit(measure).alias("measure"),
            (F.col(after) - F.col(change)).alias("baseline"),
            F.col(after).alias("predicted"),
        )

    both = F.array(
        entry("net_price", "net_price", "tuition_change_dollars"),
        entry("grad_rate", "grad_rate", "grad_rate_change"),
    )
    return df.select("institution_id", "name", F.inline(both))


def institution_detail(df: DataFrame, name: str) -> DataFrame:
    """The card of one institution, its name passed as a parameter."""
    return df.sparkSession.sql(
        "SELECT institution_id, name, tuition_change_dollars, students_affected, "
        "hours_to_cover_gap, enrollment_change_pct, equity_risk_class "
        "FROM {rows} WHERE name = :name",
        args={"name": name},
        rows=df,
    )


def quadrants(df: DataFrame) -> DataFrame:
    """Position against the reference lines; unknown sides have none."""
    poor = F.col("pct_low_income") > fixed.LOW_INCOME_CUT
    hard = _dollars() > fixed.CRISIS_DOLLARS
    return df.withColumn(
        "quadrant",
        F.when(poor & hard, "vulnerable_high_impact")
        .when(poor & ~hard, "vulnerable_low_impact")
        .when(~poor & hard, "secure_high_impact")
        .when(~poor & ~hard, "secure_low_impact"),
    )


def dashboard_fields(df: DataFrame) -> DataFrame:
    return (
        df.transform(severity)
        .transform(impact_category)
        .transform(risk_fields)
        .transform(formatted)
        .transform(quadrants)
    )
