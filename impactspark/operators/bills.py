"""From a table of bill texts to a table of policy parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark import fixed
from impactspark.functions import text as tx

NUMBERS = ("funding_change_pct", "min_wage_change", "childcare_subsidy", "tuition_cap_pct")


def clean_bills(bills: DataFrame, repair_hyphens: bool = False) -> DataFrame:
    return bills.withColumn("text", tx.clean_text(F.col("text"), repair_hyphens))


def extract(bills: DataFrame, mode: str = "compat", near: bool = False) -> DataFrame:
    """Parameters, types and confidence of cleaned texts. Row-wise: the whole
    text of a bill is read where it lies, nothing is shuffled."""
    text, low, odd = F.col("text"), F.col("_low"), F.col("_odd")
    params = {
        "funding_change_pct": tx.funding_change(text, low, odd),
        "min_wage_change": tx.first_amount(
            text, fixed.WAGE_CONTEXT, fixed.WAGE_WORDS, mode, low, odd, lead=len("minimum ")
        ),
        "childcare_subsidy": tx.first_amount(
            text, fixed.CHILDCARE_CONTEXT, fixed.CHILDCARE_WORDS, mode, low, odd
        ),
        "tuition_cap_pct": tx.tuition_cap(text, near, low, odd),
        "affected_types": tx.institution_types(text, low),
    }
    found = (
        bills.withColumns({"_low": F.lower("text"), "_odd": tx.turkish(text)})  # once, for all the searches
        .withColumn("_record", F.struct(*[e.alias(n) for n, e in params.items()]))
        # one generated row per bill: a later filter on a parameter stays above
        # it instead of running the searches a second time inside the filter
        .select(*bills.columns, F.inline(F.array("_record")))
    )
    points = F.lit(float(fixed.CONFIDENCE_POINTS["affected_types"]))
    for name in NUMBERS:
        points = points + F.when(F.col(name).isNotNull(), float(fixed.CONFIDENCE_POINTS[name])).otherwise(0.0)
    return found.withColumn("confidence_score", F.least(points, F.lit(100.0)))


def apply_overrides(
    params: DataFrame, overrides: DataFrame, key: str = "bill_id", threshold: float | None = None
) -> DataFrame:
    """External parameters win where they say something; a bill that gets any
    has confidence 85 and method `override`. With a threshold, only bills
    whose own confidence lies below it are open to them."""
    fields = [*NUMBERS, "affected_types"]
    side = overrides.select(
        key, F.lit(True).alias("_given"), *[F.col(c).alias(f"_{c}") for c in fields if c in overrides.columns]
    )
    joined = params.join(side, key, "left")
    given = F.col("_given")
    if threshold is not None:
        given = given & (F.col("confidence_score") < threshold)
    out = {}
    for c in fields:
        if f"_{c}" in joined.columns:
            theirs = F.col(f"_{c}")
            if c == "affected_types":
                theirs = F.when(F.size(theirs) > 0, theirs)
            out[c] = F.coalesce(F.when(given, theirs), F.col(c))
    out["confidence_score"] = F.when(given, fixed.CONFIDENCE_AFTER_OVERRIDE).otherwise(F.col("confidence_score"))
    out["extraction_method"] = F.when(given, "override").otherwise(F.col("extraction_method"))
    return joined.withColumns(out).select(*params.columns)


def process_bills(
    bills: DataFrame,
    overrides: DataFrame | None = None,
    threshold: float = fixed.REVIEW_THRESHOLD,
    mode: str = "compat",
    sample_chars: int = fixed.SAMPLE_CHARS,
) -> DataFrame:
    """Full parameter record per bill. An empty text gives an empty record.
    Parameters are read from the whole text; `bill_text_sample` shows its first
    `sample_chars` characters.

    Overrides apply to bills whose own confidence is below the threshold.
    """
    cleaned = clean_bills(bills).withColumn("text", F.nullif(F.col("text"), F.lit("")))
    params = extract(cleaned, mode)
    known = F.col("text").isNotNull()
    params = params.withColumns(
        {
            "affected_types": F.when(known, F.col("affected_types")),
            "confidence_score": F.when(known, F.col("confidence_score")),
            "bill_text_sample": F.substring("text", 1, sample_chars),
            "extraction_method": F.when(known, "rule_based"),
        }
    ).drop("text")
    return params if overrides is None else apply_overrides(params, overrides, threshold=threshold)


def needs_review(params: DataFrame, threshold: float = fixed.REVIEW_THRESHOLD) -> DataFrame:
    return params.filter(F.coalesce("confidence_score", F.lit(0.0)) < threshold)
