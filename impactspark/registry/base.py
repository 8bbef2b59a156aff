"""Registration of queries and the SQL views their checks share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.functions.exact import exact_mean_sql, exact_sum_sql
from impactspark.operators.impact import derived_metrics, policy_columns
from impactspark.operators.outcomes import outcomes
from impactspark.sources import tables

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(
    name: str, sql: str | None = None, rounded: Sequence[str] = (), digits: int = 6
) -> Callable[[Run], Run]:
    """Register a query. Doubles named in `rounded` are rounded alike on both
    sides, where sums of doubles depend on the order of adding (not those of
    `functions.exact`). A nudge far
    below the last digit keeps values that end in an exact 5 on one side."""
    columns = list(rounded)
    nudge = 10.0 ** -(digits + 2)

    def wrap(run: Run) -> Run:
        def rounded_run(spark: SparkSession, folder: str) -> DataFrame:
            df = run(spark, folder)
            return df.withColumns({c: F.round(F.col(c) + nudge, digits) for c in columns}) if columns else df

        text = sql
        if text is not None and columns:
            # adding zero turns a rounded -0.0 into 0.0
            swaps = ", ".join(f"round({c} + {nudge!r}, {digits}) + 0e0 AS {c}" for c in columns)
            text = f"SELECT * REPLACE ({swaps}) FROM ({text})"
        ENTRIES[name] = Entry(rounded_run, text)
        return run

    return wrap


CUT = dict(funding_change_pct=-10.0, min_wage_change=0.0, childcare_subsidy=0.0, tuition_cap_pct=0.0)
MIXED = dict(funding_change_pct=6.0, min_wage_change=2.0, childcare_subsidy=1500.0, tuition_cap_pct=3.0)


def impact_view(spark: SparkSession, folder: str, policy: dict[str, float]) -> DataFrame:
    """All institutions under one policy."""
    rows = tables.institutions(spark, folder).withColumns(policy_columns(**policy))
    return derived_metrics(outcomes(rows, detailed_types=True))


INSTITUTIONS = """
SELECT c.c_custkey AS institution_id, c.c_name AS name, n.n_name AS state,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Public Four-Year'
    WHEN 'MACHINERY' THEN 'Public Two-Year' WHEN 'FURNITURE' THEN 'Community College'
    WHEN 'HOUSEHOLD' THEN 'Private Not-For-Profit Four-Year' ELSE 'Private For-Profit' END AS institution_type,
  c.c_acctbal * 4 AS net_price, c.c_acctbal / 2 AS affordability_gap,
  CAST(7.25 AS DOUBLE) + n.n_nationkey % 9 AS min_wage,
  CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE CAST(count(o.o_orderkey) * 500 AS DOUBLE) END AS enrollment,
  CASE WHEN c.c_custkey % 19 = 0 THEN NULL ELSE 100 * avg(CASE WHEN o.o_orderkey IS NULL THEN NULL
    WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) END AS pct_low_income,
  CASE WHEN c.c_custkey % 23 = 0 THEN NULL ELSE 100 * avg(CASE WHEN o.o_orderkey IS NULL THEN NULL
    WHEN o.o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) END AS pct_minority,
  CASE WHEN c.c_custkey % 29 = 0 THEN NULL ELSE 100 * avg(CASE WHEN o.o_orderkey IS NULL THEN NULL
    WHEN o.o_orderstatus = 'O' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) END AS grad_rate
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_name, n.n_name, n.n_nationkey, c.c_mktsegment, c.c_acctbal
"""

SCENARIOS = """
SELECT * FROM (VALUES
 ('10pct_funding_cut', -10e0, 0e0, 0e0, 0e0, ['Public Two-Year','Public Four-Year','Public','Community College','Community']),
 ('childcare_subsidy_3000', 0e0, 0e0, 3000e0, 0e0, NULL),
 ('min_wage_15', 0e0, 15e0, 0e0, 0e0, NULL),
 ('performance_based_funding', -5e0, 0e0, 0e0, 0e0, ['Public Two-Year','Public Four-Year','Public']),
 ('free_community_college', 20e0, 0e0, 0e0, -100e0, ['Public Two-Year','Community College','Community'])
) v(scenario, funding_change_pct, min_wage_change, childcare_subsidy, tuition_cap_pct, labels)
"""


def outcome_sql(source: str) -> str:
    """Outcome core over any relation with institution and policy columns."""
    return f"""
SELECT * EXCLUDE (li, mi, dep, dollars) , dollars AS tuition_change_dollars,
  enrollment * abs(enrollment_change_pct) / 100 AS students_affected,
  (affordability_gap + dollars) / greatest(coalesce(nullif(min_wage_change, 0e0), 15e0), 1e0) AS hours_to_cover_gap,
  CASE WHEN equity_risk_score <= 33 THEN 'Low' WHEN equity_risk_score <= 66 THEN 'Medium'
    ELSE 'High' END AS equity_risk_class
FROM (SELECT *,
    -(dollars / 1000) * 0.035e0 * 100 + greatest(min_wage_change, 0) * 0.5e0
      + greatest(childcare_subsidy, 0) / 1000 * 0.3e0 AS enrollment_change_pct,
    -(abs(dollars) / baseline_tuition) * 2 + greatest(min_wage_change, 0) * 0.1e0
      + greatest(childcare_subsidy, 0) / 1000 * 0.05e0 AS grad_rate_change,
    least(greatest(li / 100 * 40 + mi / 100 * 30 + least(abs(dollars) / 2000, 1e0) * 30, 0e0), 100e0) AS equity_risk_score
  FROM (SELECT *, baseline_tuition * tuition_change_pct / 100 AS dollars
    FROM (SELECT *, CASE WHEN tuition_cap_pct <> 0 AND funding_change_pct * dep > tuition_cap_pct
        THEN tuition_cap_pct ELSE funding_change_pct * dep END AS tuition_change_pct
      FROM (SELECT *, CASE WHEN net_price > 0 THEN net_price ELSE 10000e0 END AS baseline_tuition,
          coalesce(grad_rate, 60e0) AS baseline_grad_rate, coalesce(pct_low_income, 30e0) AS li,
          coalesce(pct_minority, 25e0) AS mi,
          CASE WHEN institution_type IN ('Public Four-Year', 'Public Two-Year', 'Community College')
            THEN 0.6e0 ELSE 0.2e0 END AS dep
        FROM ({source})))))
"""


def impact_sql(policy: dict[str, float]) -> str:
    values = ", ".join(f"{v!r}::DOUBLE AS {k}" for k, v in policy.items())
    return outcome_sql(f"SELECT *, {values} FROM ({INSTITUTIONS})")


def grid_sql() -> str:
    return outcome_sql(
        f"SELECT i.*, s.* EXCLUDE (labels) FROM ({INSTITUTIONS}) i JOIN ({SCENARIOS}) s "
        "ON s.labels IS NULL OR list_contains(s.labels, i.institution_type)"
    )


EQUITY_SELECT = f"""
  count(institution_id) AS college_count, {exact_mean_sql("tuition_change_dollars")} AS avg_tuition_change,
  coalesce({exact_sum_sql("tuition_change_dollars")}, 0) AS total_tuition_impact,
  coalesce({exact_sum_sql("students_affected")}, 0) AS total_students_affected,
  {exact_mean_sql("enrollment_change_pct")} AS avg_enrollment_change, {exact_mean_sql("grad_rate_change")} AS avg_grad_rate_change
"""
EQUITY_DOUBLES = (
    "avg_tuition_change", "total_tuition_impact", "total_students_affected",
    "avg_enrollment_change", "avg_grad_rate_change",
)
