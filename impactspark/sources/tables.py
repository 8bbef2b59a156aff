"""Institution, policy-text and catalogue views derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark import fixed
from impactspark.sources.scan import read_table

TYPE_BY_SEGMENT = {
    "BUILDING": "Public Four-Year",
    "MACHINERY": "Public Two-Year",
    "FURNITURE": "Community College",
    "HOUSEHOLD": "Private Not-For-Profit Four-Year",
}
# sentences of our own; `{}` receives a number that varies with the document
SENTENCES = (
    "State funding for colleges shall be {}.5 percent below last year and the cut applies to every public university.",
    "The general appropriation rises by {}% as an increase for each community college.",
    "The minimum wage of ${}.25 is set to apply to student workers of a private college.",
    "A childcare program pays ${},000 as assistance to student parents.",
    "There is a tuition cap of {} percentage points at any state university.",
    "Budget lines drop {} percent after the cut. Wage floors move from ${}.50 to a higher level. "
    "Child care funds of ${} million give support. The tuition limit is {}.75 percent. "
    "It covers each private institution and all community colleges. Page 3 of 12 House Bill 77",
    "Nothing in this act changes any amount.",
    "An allocation of ${} Million was planned; the budget is reduced by {}% under the decrease rule.",
)


def institutions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer, dressed as an institution."""
    orders = read_table(spark, folder, "orders")
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation")

    def share(cond):
        return (F.sum(F.when(cond, 1.0).otherwise(0.0)) / F.count(F.lit(1)) * 100)

    per_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        share(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("low"),
        share(F.col("o_orderstatus") == "F").alias("min"),
        share(F.col("o_orderstatus") == "O").alias("grad"),
    )
    kind = F.lit("Private For-Profit")
    for segment, label in TYPE_BY_SEGMENT.items():
        kind = F.when(F.col("c_mktsegment") == segment, label).otherwise(kind)

    def blank_every(step, col):
        return F.when(F.col("c_custkey") % step == 0, None).otherwise(col)

    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per_customer, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("institution_id"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("state"),
            kind.alias("institution_type"),
            (F.col("c_acctbal") * 4).alias("net_price"),
            (F.col("c_acctbal") / 2).alias("affordability_gap"),
            (F.lit(7.25) + F.col("n_nationkey") % 9).alias("min_wage"),
            blank_every(17, F.coalesce("n_orders", F.lit(0)) * 500.0).alias("enrollment"),
            blank_every(19, F.col("low")).alias("pct_low_income"),
            blank_every(23, F.col("min")).alias("pct_minority"),
            blank_every(29, F.col("grad")).alias("grad_rate"),
        )
    )


def bill_text() -> Column:
    """A document's whole text followed by one policy sentence."""
    number = (F.col("doc_id") % 19 + 1).cast("string")
    sentence = F.lit("")
    for i, text in enumerate(SENTENCES):
        filled = F.replace(F.lit(text), F.lit("{}"), number)
        sentence = F.when(F.col("doc_id") % len(SENTENCES) == i, filled).otherwise(sentence)
    return F.concat_ws(" ", "text", sentence)


def bills(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a bill."""
    return read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("bill_id"), bill_text().alias("text")
    )


def catalogue(spark: SparkSession) -> DataFrame:
    """The named what-if scenarios."""
    return spark.createDataFrame(
        [tuple(s) for s in fixed.SCENARIOS],
        "scenario string, funding_change_pct double, min_wage_change double, "
        "childcare_subsidy double, tuition_cap_pct double, affected_types array<string>",
    )
