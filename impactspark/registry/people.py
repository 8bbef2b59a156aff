"""Scores and grouped results over institutions and their predicted impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactspark.functions.exact import exact_mean_sql, exact_sum_sql
from impactspark.operators import groups, impact, outcomes, scores, stats
from impactspark.plans import scenario
from impactspark.registry.base import (
    CUT,
    EQUITY_SELECT,
    INSTITUTIONS,
    MIXED,
    grid_sql,
    impact_sql,
    impact_view,
    query,
)
from impactspark.sources import tables

PUBLIC = "('Public Two-Year', 'Public Four-Year', 'Public', 'Community College', 'Community')"


@query(
    "equity_impact",
    f"SELECT equity_risk_class, {EQUITY_SELECT} FROM ({impact_sql(CUT)}) "
    f"WHERE institution_type IN {PUBLIC} GROUP BY 1",
)
def equity_impact(spark, folder):
    policies = tables.catalogue(spark).filter("scenario = '10pct_funding_cut'")
    rows = scenario.scenario_impact(tables.institutions(spark, folder), policies)
    return impact.equity_table(rows)


@query(
    "affected_filter",
    f"SELECT institution_id, state, institution_type FROM ({INSTITUTIONS}) WHERE institution_type IN "
    "('Private Not-For-Profit Four-Year', 'Private For-Profit', 'Private For-Profit Four-Year', 'Private', "
    "'Public Two-Year', 'Community College', 'Community') AND state IN ('NATION_0', 'NATION_3', 'NATION_7', 'NATION_20')",
)
def affected_filter(spark, folder):
    rows = impact.filter_affected(
        tables.institutions(spark, folder),
        ["private", "community"],
        ["NATION_0", "NATION_3", "NATION_7", "NATION_20"],
    )
    return rows.select("institution_id", "state", "institution_type")


OUTCOME_COLUMNS = (
    "tuition_change_pct", "enrollment_change_pct", "grad_rate_change", "equity_risk_score",
    "tuition_change_dollars", "students_affected", "hours_to_cover_gap",
)
OUTCOME_LIST = "institution_id, " + ", ".join(OUTCOME_COLUMNS) + ", equity_risk_class"


@query("outcome_core", f"SELECT {OUTCOME_LIST} FROM ({impact_sql(MIXED)})", OUTCOME_COLUMNS)
def outcome_core(spark, folder):
    return impact_view(spark, folder, MIXED).select("institution_id", *OUTCOME_COLUMNS, "equity_risk_class")


@query(
    "baseline_values",
    f"""SELECT institution_id, CASE WHEN net_price > 0 THEN net_price ELSE 10000e0 END AS baseline_tuition,
      coalesce(grad_rate, 60e0) AS baseline_grad_rate FROM ({INSTITUTIONS})""",
    ("baseline_tuition", "baseline_grad_rate"),
)
def baseline_values(spark, folder):
    rows = outcomes.baselines(tables.institutions(spark, folder))
    return rows.select("institution_id", "baseline_tuition", "baseline_grad_rate")


@query(
    "feature_synonyms",
    f"""SELECT institution_id, enrollment, pct_low_income, 25e0 AS pct_minority,
      net_price AS baseline_tuition, grad_rate AS baseline_grad_rate FROM ({INSTITUTIONS})""",
    ("pct_low_income", "baseline_grad_rate"),
)
def feature_synonyms(spark, folder):
    # synonyms under other names, and one meaning without any column
    rows = (
        tables.institutions(spark, folder)
        .withColumnsRenamed({"enrollment": "total_enrollment", "pct_low_income": "pell_pct", "grad_rate": "graduation_rate"})
        .drop("pct_minority")
    )
    wanted = ["enrollment", "pct_low_income", "pct_minority", "baseline_tuition", "baseline_grad_rate"]
    return impact.with_feature_columns(rows).select("institution_id", *wanted)


STRESS = f"""
SELECT *, greatest(least((
    CASE WHEN mg > 0 THEN coalesce(affordability_gap / mg * 100, 0) ELSE 0 END
    + CASE WHEN mr > 0 THEN coalesce((1 - ratio / mr) * 100, 0) ELSE 50 END)
  / ((mg <= 0 OR affordability_gap IS NOT NULL)::INT + (mr <= 0 OR ratio IS NOT NULL)::INT), 100e0), 0e0)
  AS affordability_stress_score
FROM (SELECT *, max(affordability_gap) OVER () AS mg, max(ratio) OVER () AS mr
  FROM (SELECT *, min_wage / (net_price + 1) AS ratio FROM ({INSTITUTIONS})))
"""


@query(
    "stress_score",
    f"SELECT institution_id, affordability_stress_score FROM ({STRESS})",
    ("affordability_stress_score",),
)
def stress_score(spark, folder):
    rows = scores.stress_score(tables.institutions(spark, folder))
    return rows.select("institution_id", "affordability_stress_score")


INDICATORS = f"""
SELECT *, CASE WHEN equity_risk_score <= 33 THEN 'Low' WHEN equity_risk_score <= 66 THEN 'Medium' ELSE 'High' END
  AS equity_risk_class
FROM (SELECT *, 25 * (high_low_income + high_minority + low_grad_rate + high_stress) AS equity_risk_score
  FROM (SELECT *, coalesce(pct_low_income > 50, false)::INT AS high_low_income,
      coalesce(pct_minority > 50, false)::INT AS high_minority,
      coalesce(grad_rate < 50, false)::INT AS low_grad_rate,
      coalesce(affordability_stress_score > 70, false)::INT AS high_stress FROM ({STRESS})))
"""
INDICATOR_LIST = (
    "institution_id, high_low_income, high_minority, low_grad_rate, high_stress, equity_risk_score, equity_risk_class"
)


@query("equity_indicators", f"SELECT {INDICATOR_LIST} FROM ({INDICATORS})")
def equity_indicators(spark, folder):
    rows = tables.institutions(spark, folder).transform(scores.stress_score)
    return rows.transform(scores.equity_indicators).select(*INDICATOR_LIST.split(", "))


RESILIENCE = """
greatest(least((CASE WHEN me > 0 THEN coalesce(enrollment / me * 100, 0) ELSE 50 END
   + CASE institution_type WHEN 'private' THEN 80 WHEN 'public' THEN 60 WHEN 'community' THEN 40 ELSE 50 END)
  / ((me <= 0 OR enrollment IS NOT NULL)::INT + 1), 100e0), 0e0) AS resilience_score
"""
# simple type names, as in hand-kept tables
SIMPLE_TYPES = """CASE WHEN institution_type IN ('Public Four-Year', 'Public Two-Year') THEN 'public'
  WHEN institution_type = 'Community College' THEN 'community' WHEN institution_type LIKE 'Private Not%' THEN 'private'
  ELSE institution_type END"""


@query(
    "resilience_score",
    f"""SELECT institution_id, institution_type, {RESILIENCE} FROM (
      SELECT * REPLACE ({SIMPLE_TYPES} AS institution_type), max(enrollment) OVER () AS me FROM ({INSTITUTIONS}))""",
    ("resilience_score",),
)
def resilience_score(spark, folder):
    rows = tables.institutions(spark, folder).withColumn("institution_type", F.expr(SIMPLE_TYPES))
    return scores.resilience_score(rows).select("institution_id", "institution_type", "resilience_score")


@query(
    "enhanced_master",
    f"SELECT institution_id, affordability_stress_score, equity_risk_class, {RESILIENCE} "
    f"FROM (SELECT *, max(enrollment) OVER () AS me FROM ({INDICATORS}))",
    ("affordability_stress_score", "resilience_score"),
)
def enhanced_master(spark, folder):
    rows = scores.enhance(tables.institutions(spark, folder))
    return rows.select("institution_id", "affordability_stress_score", "equity_risk_class", "resilience_score")


IMPACT_SCORE = f"""
SELECT institution_id, (coalesce(CASE WHEN md > 0 THEN abs(tuition_change_dollars) / md * 100 ELSE 0 END, 0)
    + coalesce(CASE WHEN mh > 0 THEN hours_to_cover_gap / mh * 100 ELSE 0 END, 0)) / 3 AS affordability_impact_score
FROM (SELECT *, max(abs(tuition_change_dollars)) OVER () AS md, max(hours_to_cover_gap) OVER () AS mh
  FROM ({impact_sql(CUT)}))
"""


@query("impact_score", IMPACT_SCORE, ("affordability_impact_score",))
def impact_score(spark, folder):
    rows = scores.impact_score(impact_view(spark, folder, CUT))
    return rows.select("institution_id", "affordability_impact_score")


@query(
    "score_summary",
    "SELECT avg(affordability_impact_score) AS mean, quantile_cont(affordability_impact_score, 0.5) AS median, "
    f"max(affordability_impact_score) AS max FROM ({IMPACT_SCORE})",
    ("mean", "median", "max"),
)
def score_summary(spark, folder):
    return stats.score_summary(scores.impact_score(impact_view(spark, folder, CUT)))


@query(
    "impact_resilience_top20",
    f"""SELECT *, row_number() OVER (ORDER BY resilience_score DESC NULLS LAST, institution_id, name) AS resilience_rank
    FROM (SELECT institution_id, name,
      (CASE WHEN me > 0 THEN coalesce(enrollment / me * 100, 0) ELSE 50 END
       + CASE WHEN md > 0 THEN coalesce((1 - abs(tuition_change_dollars) / md) * 100, 0) ELSE 100 END + 50)
      / ((me <= 0 OR enrollment IS NOT NULL)::INT + (md <= 0 OR tuition_change_dollars IS NOT NULL)::INT + 1) AS resilience_score
      FROM (SELECT *, max(enrollment) OVER () AS me, max(abs(tuition_change_dollars)) OVER () AS md
        FROM ({impact_sql(CUT)})))
    ORDER BY resilience_rank LIMIT 20""",
    ("resilience_score",),
)
def impact_resilience_top20(spark, folder):
    return scores.impact_resilience(impact_view(spark, folder, CUT))


def _vulnerability_sql(policy):
    return f"""SELECT *, row_number() OVER (ORDER BY vulnerability_score DESC, state) AS rank
    FROM (SELECT *, CASE WHEN ma > 0 THEN avg_tuition_impact / ma * 50 + total_students_affected / ms * 50 ELSE 0 END
        AS vulnerability_score FROM (SELECT *, max(avg_tuition_impact) OVER () AS ma,
          max(total_students_affected) OVER () AS ms FROM (SELECT state, {exact_mean_sql("tuition_change_dollars")} AS avg_tuition_impact,
            coalesce({exact_sum_sql("students_affected")}, 0) AS total_students_affected, count(institution_id) AS college_count
          FROM ({impact_sql(policy)}) GROUP BY state)))"""


VULNERABILITY_LIST = "state, avg_tuition_impact, total_students_affected, college_count, vulnerability_score, rank"
VULNERABILITY_DOUBLES = ("avg_tuition_impact", "total_students_affected", "vulnerability_score")


@query(
    "state_vulnerability",
    f"SELECT {VULNERABILITY_LIST} FROM ({_vulnerability_sql(MIXED)})",
    VULNERABILITY_DOUBLES,
)
def state_vulnerability(spark, folder):
    return scores.state_vulnerability(impact_view(spark, folder, MIXED))


@query(
    "state_vulnerability_cut",
    f"SELECT {VULNERABILITY_LIST} FROM ({_vulnerability_sql(CUT)})",
    VULNERABILITY_DOUBLES,
)
def state_vulnerability_cut(spark, folder):
    return scores.state_vulnerability(impact_view(spark, folder, CUT))


def _gap_sql(name, column, source):
    over, under = f"FILTER ({column} > 50)", f"FILTER ({column} <= 50)"
    serving, other = (exact_mean_sql("tuition_change_dollars", where=f"{column} {sign} 50") for sign in (">", "<="))
    return f"""SELECT '{name}' AS dimension, {serving} AS serving_avg_impact, {other} AS other_avg_impact, {serving} - {other} AS gap
      FROM ({source}) HAVING count(*) {over} > 0 AND count(*) {under} > 0"""


@query(
    "equity_gap",
    _gap_sql("minority_gap", "pct_minority", impact_sql(CUT))
    + " UNION ALL "
    + _gap_sql("income_gap", "pct_low_income", impact_sql(CUT)),
)
def equity_gap(spark, folder):
    return groups.equity_gap(impact_view(spark, folder, CUT))


MEASURES = ("net_price", "enrollment", "pct_low_income", "grad_rate")
_STAT_SQL = {
    "mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "std": "stddev_samp({c})",
    "min": "min({c})", "max": "max({c})", "count": "count({c})",
}


@query(
    "group_stats",
    "SELECT state, institution_type, "
    + ", ".join(f"{t.format(c=c)} AS {c}_{s}" for c in MEASURES for s, t in _STAT_SQL.items())
    + f" FROM ({INSTITUTIONS}) GROUP BY ALL",
    [f"{c}_{s}" for c in MEASURES for s in _STAT_SQL if s != "count"],
)
def group_stats(spark, folder):
    rows = tables.institutions(spark, folder).select("state", "institution_type", *MEASURES)
    return groups.group_stats(rows)


@query(
    "lineitem_group_stats",
    """SELECT l_returnflag, l_linestatus, avg(l_quantity) AS l_quantity_mean,
      quantile_cont(l_quantity, 0.5) AS l_quantity_median, quantile_cont(l_extendedprice, 0.5) AS l_extendedprice_median,
      stddev_samp(l_extendedprice) AS l_extendedprice_std, sum(l_extendedprice) AS l_extendedprice_sum,
      max(l_tax) AS l_tax_max FROM lineitem GROUP BY ALL""",
    ("l_quantity_mean", "l_extendedprice_median", "l_extendedprice_std", "l_extendedprice_sum"),
    4,
)
def lineitem_group_stats(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    spec = {
        "l_quantity": ["mean", "median"],
        "l_extendedprice": ["median", "std", "sum"],
        "l_tax": ["max"],
    }
    return groups.group_stats(rows, ["l_returnflag", "l_linestatus"], spec)


@query(
    "group_means",
    "SELECT institution_type, "
    + ", ".join(f"avg({c}) AS {c}_mean, count({c}) AS {c}_count" for c in MEASURES)
    + f" FROM ({INSTITUTIONS}) GROUP BY 1",
    [f"{c}_mean" for c in MEASURES],
)
def group_means(spark, folder):
    rows = tables.institutions(spark, folder).select("institution_type", *MEASURES)
    return groups.group_means(rows, ["institution_type"])


@query(
    "state_rollup",
    f"""SELECT state, avg(net_price) AS net_price, coalesce(sum(enrollment), 0) AS enrollment,
      avg(pct_low_income) AS pct_low_income, coalesce(sum(students_affected), 0) AS students_affected,
      count(*) AS institution_count FROM ({impact_sql(CUT)}) GROUP BY state""",
    ("net_price", "enrollment", "pct_low_income", "students_affected"),
)
def state_rollup(spark, folder):
    rows = impact_view(spark, folder, CUT)
    return groups.state_rollup(
        rows.select("state", "institution_id", "net_price", "enrollment", "pct_low_income", "students_affected")
    )


@query(
    "scenario_grid",
    f"SELECT scenario, {OUTCOME_LIST} FROM ({grid_sql()})",
    OUTCOME_COLUMNS,
)
def scenario_grid(spark, folder):
    rows = scenario.scenario_impact(tables.institutions(spark, folder), tables.catalogue(spark))
    return rows.select("scenario", "institution_id", *OUTCOME_COLUMNS, "equity_risk_class")


@query(
    "scenario_compare",
    f"""SELECT scenario, count(*) AS colleges_count, {exact_mean_sql("tuition_change_dollars")} AS avg_tuition_change,
      coalesce({exact_sum_sql("students_affected")}, 0) AS total_students_affected,
      count(*) FILTER (equity_risk_class = 'High') AS high_risk_colleges FROM ({grid_sql()}) GROUP BY scenario""",
)
def scenario_compare(spark, folder):
    rows = scenario.scenario_impact(tables.institutions(spark, folder), tables.catalogue(spark))
    return groups.compare_scenarios(rows)


def summary_sql(source: str, by: str = "") -> str:
    key, group = (f"{by},", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT *, 'This bill affects ' || total_colleges_affected || ' colleges and '
      || format('{{:,}}', total_students_impacted) || ' students.' AS plain_language_summary FROM (
    SELECT {key} count(*) AS total_colleges_affected,
      CAST(trunc(coalesce({exact_sum_sql("students_affected")}, 0)) AS BIGINT) AS total_students_impacted,
      {exact_mean_sql("tuition_change_pct")} AS average_tuition_change_pct, {exact_mean_sql("tuition_change_dollars")} AS average_tuition_change_dollars,
      {exact_mean_sql("enrollment_change_pct")} AS average_enrollment_change_pct, {exact_mean_sql("grad_rate_change")} AS average_grad_rate_change,
      count(*) FILTER (equity_risk_class = 'High') AS high_risk_colleges,
      count(*) FILTER (pct_minority > 50) AS minority_serving_institutions_affected,
      count(*) FILTER (pct_low_income > 50) AS low_income_serving_institutions_affected,
      count(*) FILTER (equity_risk_class = 'Low') AS low_class,
      count(*) FILTER (equity_risk_class = 'Medium') AS medium_class,
      array_to_string((list(institution_id ORDER BY tuition_change_dollars DESC, institution_id, name)
        FILTER (tuition_change_dollars IS NOT NULL))[1:10], ',') AS top_ids FROM ({source}) {group})"""


def flat_summary(df):
    """The class counts and the ids of the most affected as columns."""
    counts = {
        f"{c.lower()}_class": F.coalesce(F.col("equity_risk_breakdown")[c], F.lit(0).cast("long"))
        for c in ("Low", "Medium")
    }
    counts["top_ids"] = F.array_join(F.transform("top_most_affected", lambda x: x["institution_id"].cast("string")), ",")
    return df.withColumns(counts).drop("equity_risk_breakdown", "top_most_affected")


@query("impact_summary", summary_sql(impact_sql(CUT)))
def impact_summary(spark, folder):
    return flat_summary(impact.plain_sentence(impact.impact_summary(impact_view(spark, folder, CUT))))


@query(
    "scenario_top10",
    f"""SELECT scenario, institution_id, name, tuition_change_dollars, affected_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY tuition_change_dollars DESC, institution_id, name)
        AS affected_rank FROM ({grid_sql()})) WHERE affected_rank <= 10""",
    ("tuition_change_dollars",),
)
def scenario_top10(spark, folder):
    rows = scenario.scenario_impact(tables.institutions(spark, folder), tables.catalogue(spark))
    summary = impact.impact_summary(rows, ["scenario"])
    return summary.select("scenario", F.inline("top_most_affected")).select(
        "scenario", "institution_id", "name", "tuition_change_dollars", "affected_rank"
    )


TOP_LIST = "institution_id, name, state, tuition_change_dollars, students_affected, equity_risk_class"


@query(
    "top10_affected",
    f"SELECT {TOP_LIST} FROM ({impact_sql(CUT)}) ORDER BY tuition_change_dollars DESC, institution_id, name LIMIT 10",
    ("tuition_change_dollars", "students_affected"),
)
def top10_affected(spark, folder):
    return impact.top_affected(impact_view(spark, folder, CUT)).select(*TOP_LIST.split(", "))


@query(
    "top10_by_size",
    f"SELECT {TOP_LIST} FROM ({impact_sql(CUT)}) ORDER BY abs(tuition_change_dollars) DESC, institution_id, name LIMIT 10",
    ("tuition_change_dollars", "students_affected"),
)
def top10_by_size(spark, folder):
    return impact.top_affected(impact_view(spark, folder, CUT), by="abs").select(*TOP_LIST.split(", "))


STAT_COLUMNS = (
    "net_price", "affordability_gap", "min_wage", "enrollment", "pct_low_income", "pct_minority", "grad_rate",
)


def _describe_sql(source, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
        quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75,
        max({c}) AS max, quantile_cont({c}, 0.5) AS median FROM ({source})"""
        for c in columns
    )


DESCRIBE_DOUBLES = ("mean", "std", "min", "q25", "q50", "q75", "max", "median")


@query("describe", _describe_sql(INSTITUTIONS, STAT_COLUMNS), DESCRIBE_DOUBLES)
def describe(spark, folder):
    return stats.describe(tables.institutions(spark, folder), STAT_COLUMNS)


EVENT_AND_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("describe_lineitem", _describe_sql("SELECT * FROM lineitem", EVENT_AND_LINE), DESCRIBE_DOUBLES)
def describe_lineitem(spark, folder):
    return stats.describe(spark.read.parquet(f"{folder}/lineitem.parquet"), EVENT_AND_LINE)


@query(
    "correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS correlation FROM inst"
        for a in STAT_COLUMNS
        for b in STAT_COLUMNS
    ).replace("SELECT", f"WITH inst AS ({INSTITUTIONS}) SELECT", 1),
    ("correlation",),
)
def correlations(spark, folder):
    return stats.correlations(tables.institutions(spark, folder), STAT_COLUMNS)


def _histogram_sql(source, columns, bins=30):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", bin, low + (high - low) / {bins} * (bin - 1) AS bin_low,
        low + (high - low) / {bins} * bin AS bin_high, count(*) AS row_count FROM (
          SELECT low, high, CASE WHEN high > low THEN
            CAST(least(floor((v - low) / (high - low) * {bins}), {bins - 1}) AS INT) + 1 ELSE 1 END AS bin
          FROM (SELECT {c} AS v, min({c}) OVER () AS low, max({c}) OVER () AS high FROM ({source})) WHERE v IS NOT NULL)
        GROUP BY low, high, bin"""
        for c in columns
    )


@query(
    "histogram30",
    _histogram_sql(INSTITUTIONS, ("net_price", "enrollment", "grad_rate")),
    ("bin_low", "bin_high"),
)
def histogram30(spark, folder):
    return stats.histogram(tables.institutions(spark, folder), ["net_price", "enrollment", "grad_rate"])


@query(
    "histogram_events",
    _histogram_sql("SELECT value FROM events", ("value",)),
    ("bin_low", "bin_high"),
)
def histogram_events(spark, folder):
    return stats.histogram(spark.read.parquet(f"{folder}/events.parquet"), ["value"])


def _box_sql(source, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", any_value(q25) AS q25, any_value(m) AS median, any_value(q75) AS q75,
        min({c}) FILTER ({c} BETWEEN q25 - 1.5e0 * (q75 - q25) AND q75 + 1.5e0 * (q75 - q25)) AS whisker_low,
        max({c}) FILTER ({c} BETWEEN q25 - 1.5e0 * (q75 - q25) AND q75 + 1.5e0 * (q75 - q25)) AS whisker_high,
        count(*) FILTER ({c} NOT BETWEEN q25 - 1.5e0 * (q75 - q25) AND q75 + 1.5e0 * (q75 - q25)) AS outlier_count
        FROM ({source}) s, (SELECT quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS m,
          quantile_cont({c}, 0.75) AS q75 FROM ({source})) q"""
        for c in columns
    )


@query(
    "boxplot_stats",
    _box_sql(INSTITUTIONS, ("net_price", "enrollment", "pct_minority")),
    ("q25", "median", "q75", "whisker_low", "whisker_high"),
)
def boxplot_stats(spark, folder):
    return stats.boxplot_stats(tables.institutions(spark, folder), ["net_price", "enrollment", "pct_minority"])
