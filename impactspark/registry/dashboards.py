"""Dashboard queries: totals, bands, joins and calculated fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactspark.functions.exact import exact_mean_sql, exact_sum_sql
from impactspark.operators import dashboard, groups, impact
from impactspark.registry.base import (
    CUT,
    EQUITY_SELECT,
    MIXED,
    impact_sql,
    impact_view,
    query,
)
from impactspark.sources.sinks import impact_export

IMPACT = impact_sql(MIXED)


def mixed(spark, folder):
    return impact_view(spark, folder, MIXED)


@query(
    "kpis",
    f"""SELECT count(institution_id) AS total_colleges, coalesce({exact_sum_sql("students_affected")}, 0) AS total_students,
      {exact_mean_sql("tuition_change_dollars")} AS avg_tuition_change, count(DISTINCT state) AS states,
      count(*) FILTER (equity_risk_class = 'Low') AS low_risk_colleges,
      count(*) FILTER (equity_risk_class = 'Medium') AS medium_risk_colleges,
      count(*) FILTER (equity_risk_class = 'High') AS high_risk_colleges FROM ({IMPACT})""",
)
def kpis(spark, folder):
    return groups.kpis(mixed(spark, folder))


def _band_sql(share):
    return f"""SELECT CASE WHEN {share} < 25 THEN '0-25%' WHEN {share} < 50 THEN '25-50%'
      WHEN {share} < 75 THEN '50-75%' ELSE '75-100%' END AS band, {exact_mean_sql("tuition_change_dollars")} AS avg_tuition_change,
      count(*) AS college_count FROM ({IMPACT}) WHERE {share} IS NOT NULL GROUP BY 1"""


@query("band_impact_income", _band_sql("pct_low_income"))
def band_impact_income(spark, folder):
    return groups.band_impact(mixed(spark, folder), "pct_low_income")


@query("band_impact_minority", _band_sql("pct_minority"))
def band_impact_minority(spark, folder):
    return groups.band_impact(mixed(spark, folder), "pct_minority")


@query(
    "lod_state",
    f"""SELECT institution_id, state, {exact_sum_sql("students_affected", over="PARTITION BY state")} AS state_students_affected,
      {exact_mean_sql("tuition_change_dollars", over="PARTITION BY state")} AS state_avg_tuition_change FROM ({IMPACT})""",
)
def lod_state(spark, folder):
    rows = groups.state_lod(mixed(spark, folder))
    return rows.select("institution_id", "state", "state_students_affected", "state_avg_tuition_change")


@query(
    "rank_state",
    f"""SELECT state, total, rank() OVER (ORDER BY total DESC NULLS LAST) AS impact_rank
      FROM (SELECT state, {exact_sum_sql("tuition_change_dollars")} AS total FROM ({IMPACT}) GROUP BY state)""",
)
def rank_state(spark, folder):
    return groups.rank_groups(mixed(spark, folder), "state", "tuition_change_dollars")


def _joined_sql(how):
    return f"""WITH imp AS ({IMPACT}), eq AS (SELECT equity_risk_class, {EQUITY_SELECT} FROM imp
        WHERE institution_type LIKE 'Public%' GROUP BY 1)
      SELECT imp.institution_id, imp.equity_risk_class, eq.college_count, eq.avg_tuition_change
      FROM imp {how} JOIN eq ON imp.equity_risk_class = eq.equity_risk_class"""


def _joined(spark, folder, how):
    rows = mixed(spark, folder)
    equity = impact.equity_table(rows.filter(F.col("institution_type").startswith("Public")))
    return groups.join_equity(rows, equity, how).select(
        "institution_id", "equity_risk_class", "college_count", "avg_tuition_change"
    )


@query("join_equity", _joined_sql("LEFT"))
def join_equity(spark, folder):
    return _joined(spark, folder, "left")


@query("join_equity_inner", _joined_sql("INNER"))
def join_equity_inner(spark, folder):
    return _joined(spark, folder, "inner")


@query(
    "state_coords",
    f"""SELECT institution_id, state, coalesce(state_lat, 0) AS state_lat, coalesce(state_lon, 0) AS state_lon
      FROM ({IMPACT}) LEFT JOIN (SELECT n_name, n_nationkey + 25.5e0 AS state_lat, n_regionkey * -20.25e0 AS state_lon
        FROM nation WHERE n_regionkey <> 2) ON state = n_name""",
    ("state_lat", "state_lon"),
)
def state_coords(spark, folder):
    # one region has no coordinates
    nation = spark.read.parquet(f"{folder}/nation.parquet").filter("n_regionkey <> 2")
    coords = nation.select(
        F.col("n_name").alias("state"),
        (F.col("n_nationkey") + 25.5).alias("state_lat"),
        (F.col("n_regionkey") * -20.25).alias("state_lon"),
    )
    rows = groups.with_coords(mixed(spark, folder), coords)
    return rows.select("institution_id", "state", "state_lat", "state_lon")


@query(
    "severity",
    f"""SELECT institution_id, CASE WHEN tuition_change_dollars > 2000 THEN 'Severe'
        WHEN tuition_change_dollars > 1000 THEN 'High' WHEN tuition_change_dollars > 0 THEN 'Moderate'
        ELSE 'Positive' END AS impact_severity,
      CASE WHEN tuition_change_dollars <= -1000 THEN 'Severe Negative' WHEN tuition_change_dollars <= 0
        THEN 'Moderate Negative' WHEN tuition_change_dollars <= 1000 THEN 'Positive' ELSE 'Severe Positive' END
        AS impact_severity_bin FROM ({impact_sql(CUT)} UNION ALL BY NAME {IMPACT})""",
)
def severity(spark, folder):
    both = impact_view(spark, folder, CUT).unionByName(mixed(spark, folder))
    return dashboard.severity(both).select("institution_id", "impact_severity", "impact_severity_bin")


@query(
    "impact_category",
    f"""SELECT institution_id, CASE WHEN tuition_change_dollars > 1000 AND pct_low_income > 50 THEN 'Crisis'
      WHEN tuition_change_dollars > 500 THEN 'High Impact' ELSE 'Manageable' END AS impact_category FROM ({IMPACT})""",
)
def impact_category(spark, folder):
    return dashboard.impact_category(mixed(spark, folder)).select("institution_id", "impact_category")


@query(
    "risk_fields",
    f"""SELECT institution_id, CASE equity_risk_class WHEN 'High' THEN 'High Risk' WHEN 'Medium' THEN 'Medium Risk'
      ELSE 'Low Risk' END AS risk_label, CASE equity_risk_class WHEN 'High' THEN '#FF0000' WHEN 'Medium' THEN '#FFA500'
      WHEN 'Low' THEN '#00FF00' END AS risk_color FROM ({IMPACT})""",
)
def risk_fields(spark, folder):
    return dashboard.risk_fields(mixed(spark, folder)).select("institution_id", "risk_label", "risk_color")


@query(
    "formatted",
    f"""SELECT institution_id,
      '$' || CASE WHEN d < 0 AND round_even(d, 0) = 0 THEN '-0' ELSE format('{{:,}}', CAST(round_even(d, 0) AS BIGINT)) END
        AS formatted_tuition_change,
      CAST(tuition_change_pct AS VARCHAR) || '%' AS formatted_tuition_pct, round(students_affected, 0) AS formatted_students
      FROM (SELECT *, tuition_change_dollars AS d FROM ({impact_sql(CUT)}))""",
    ("formatted_students",),
    0,
)
def formatted(spark, folder):
    rows = dashboard.formatted(impact_view(spark, folder, CUT))
    return rows.select(
        "institution_id", "formatted_tuition_change", "formatted_tuition_pct", "formatted_students"
    )


@query(
    "before_after",
    f"""SELECT institution_id, name, 'net_price' AS measure, net_price - tuition_change_dollars AS baseline,
        net_price AS predicted FROM ({IMPACT})
      UNION ALL SELECT institution_id, name, 'grad_rate', grad_rate - grad_rate_change, grad_rate FROM ({IMPACT})""",
    ("baseline", "predicted"),
)
def before_after(spark, folder):
    return dashboard.before_after(mixed(spark, folder))


@query(
    "institution_detail",
    f"""SELECT institution_id, name, tuition_change_dollars, students_affected, hours_to_cover_gap,
      enrollment_change_pct, equity_risk_class FROM ({IMPACT}) WHERE name = 'Customer#000000042'""",
    ("tuition_change_dollars", "students_affected", "hours_to_cover_gap", "enrollment_change_pct"),
)
def institution_detail(spark, folder):
    return dashboard.institution_detail(mixed(spark, folder), "Customer#000000042")


@query(
    "quadrants",
    f"""SELECT quadrant, count(*) AS college_count FROM (SELECT CASE
        WHEN pct_low_income > 50 AND tuition_change_dollars > 1000 THEN 'vulnerable_high_impact'
        WHEN pct_low_income > 50 AND tuition_change_dollars <= 1000 THEN 'vulnerable_low_impact'
        WHEN pct_low_income <= 50 AND tuition_change_dollars > 1000 THEN 'secure_high_impact'
        WHEN pct_low_income <= 50 AND tuition_change_dollars <= 1000 THEN 'secure_low_impact' END AS quadrant
      FROM ({IMPACT})) GROUP BY 1""",
)
def quadrants(spark, folder):
    rows = dashboard.quadrants(mixed(spark, folder))
    return rows.groupBy("quadrant").agg(F.count(F.lit(1)).alias("college_count"))


EXPORT_TEXT = ("name", "state", "institution_type", "equity_risk_class")
EXPORT_NUMBERS = (
    "institution_id", "tuition_change_pct", "tuition_change_dollars", "enrollment_change_pct", "students_affected",
    "grad_rate_change", "hours_to_cover_gap", "pct_low_income", "pct_minority", "net_price", "grad_rate", "enrollment",
)


@query(
    "impact_export",
    "SELECT "
    + ", ".join(
        [f"coalesce({c}, 'Unknown') AS {c}" for c in EXPORT_TEXT]
        + [f"coalesce({c}, 0) AS {c}" for c in EXPORT_NUMBERS]
    )
    + f" FROM ({IMPACT})",
    EXPORT_NUMBERS[1:],
)
def export(spark, folder):
    return impact_export(mixed(spark, folder))
