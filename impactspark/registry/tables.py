"""Scanning, merging and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactspark.functions.exact import exact_mean_sql, exact_sum_sql
from impactspark.operators import cleaning, groups, merging, quality
from impactspark.plans.master import build_master
from impactspark.plans.scenario import rule_predictor, run_scenario
from impactspark.registry.base import (
    CUT,
    EQUITY_DOUBLES,
    EQUITY_SELECT,
    INSTITUTIONS,
    MIXED,
    grid_sql,
    impact_sql,
    impact_view,
    query,
)
from impactspark.sources import scan, sinks, split_csv, tables
from impactspark.sources.folders import fresh_dir


def _table(spark, folder, name):
    return scan.read_table(spark, folder, name)


@query("csv_scan", "SELECT c_custkey AS institution_id, c_name AS \"Name\", c_acctbal AS \"Net-Price\" FROM customer")
def csv_scan(spark, folder):
    """Written as CSV under other names, then scanned back with the key found."""
    base = fresh_dir(spark, "csv")
    rows = _table(spark, folder, "customer").select(
        F.col("c_custkey").alias("UnitID"), F.col("c_name").alias("Name"), F.col("c_acctbal").alias("Net-Price")
    )
    sinks.write_csv(rows, f"{base}/customers.csv")
    found = scan.read_sources(
        spark,
        {"customers": "customers.csv", "absent": "nowhere.csv"},
        schemas={"customers": rows.schema},
        folder=base,
    )
    return found["customers"]


NAMES = """CASE doc_id % 5 WHEN 0 THEN ' lead, ' || text || ' ' WHEN 1 THEN 'say "hi", ok' || chr(13) || chr(10) || text
  WHEN 2 THEN '' WHEN 3 THEN NULL ELSE text || chr(10) || '"' END"""


@query("csv_quotes", f"SELECT doc_id AS institution_id, {NAMES} AS name, n_chars AS enrollment FROM documents")
def csv_quotes(spark, folder):
    rows = _quoted(spark, folder)
    base = fresh_dir(spark, "quotes")
    sinks.write_csv(rows.repartition(7), f"{base}/names.csv")
    return scan.read_sources(spark, {"names": "names.csv"}, schemas={"names": rows.schema}, folder=base)["names"]


def _quoted(spark, folder):
    """Names with quotes, commas, line breaks, outer spaces, empty and NULL."""
    text, kind = F.col("text"), F.col("doc_id") % 5
    name = (
        F.when(kind == 0, F.concat(F.lit(" lead, "), text, F.lit(" ")))
        .when(kind == 1, F.concat(F.lit('say "hi", ok\r\n'), text))
        .when(kind == 2, "")
        .when(kind == 4, F.concat(text, F.lit('\n"')))
    )
    return _table(spark, folder, "documents").select(F.col("doc_id").alias("unitid"), name.alias("name"), F.col("n_chars").alias("enrollment"))


@query(
    "csv_split",
    f"SELECT doc_id AS institution_id, {NAMES} AS name, n_chars AS enrollment FROM documents",
)
def csv_split(spark, folder):
    """Texts with quotes and line breaks, written by as many tasks as read them;
    every file is read by all its splits."""
    rows = _quoted(spark, folder)
    path = sinks.write_csv(rows, f"{fresh_dir(spark, 'quotes')}/names.csv")
    return scan.with_key(split_csv.read_csv_split(spark, path, rows.schema))


@query(
    "scenario_files",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS scenario, count(*) AS colleges_count, {exact_mean_sql("tuition_change_dollars")} AS avg_tuition_change,
        coalesce({exact_sum_sql("students_affected")}, 0) AS total_students_affected,
        count(*) FILTER (equity_risk_class = 'High') AS high_risk_colleges FROM ({impact_sql(p)})"""
        for n, p in (("cut", CUT), ("mixed", MIXED))
    ),
)
def scenario_files(spark, folder):
    """Two exported scenarios, compared from their files."""
    base = fresh_dir(spark, "scenarios")
    paths = []
    for name, policy in (("cut", CUT), ("mixed", MIXED)):
        export = sinks.impact_export(impact_view(spark, folder, policy))
        paths.append(sinks.write_csv(export, f"{base}/predicted_impact_{name}.csv"))
    return groups.compare_scenarios(scan.read_scenarios(spark, paths, export.schema))


@query(
    "published_equity",
    f"SELECT equity_risk_class, {EQUITY_SELECT} FROM ({grid_sql()}) "
    "WHERE scenario = 'performance_based_funding' GROUP BY 1",
)
def published_equity(spark, folder):
    """A full scenario run, read back from the current snapshot."""
    schema = "equity_risk_class string, college_count bigint, " + ", ".join(f"{c} double" for c in EQUITY_DOUBLES)
    return scan.csv_reader(spark, schema).csv(f"{_snapshot(spark, folder)}/current_equity_analysis.csv")


def _snapshot(spark, folder):
    """The current folder after a run whose export has many part files."""
    base = fresh_dir(spark, "run")
    policies = tables.catalogue(spark).filter("scenario = 'performance_based_funding'").drop("scenario")
    people = tables.institutions(spark, folder).repartition(16, "institution_id")
    run_scenario(spark, "performance", policies, people, base)
    return sinks.current_folder(spark, base)


PUBLISHED = f"SELECT * FROM ({grid_sql()}) WHERE scenario = 'performance_based_funding'"


@query(
    "published_predictions",
    f"""SELECT institution_id, name, state, coalesce(enrollment, 0) AS enrollment, coalesce(tuition_change_dollars, 0) AS tuition_change_dollars,
      coalesce(students_affected, 0) AS students_affected, coalesce(equity_risk_class, 'Unknown') AS equity_risk_class FROM ({PUBLISHED})""",
    ("tuition_change_dollars", "students_affected"),
)
def published_predictions(spark, folder):
    """Every exported row, read back from the current snapshot."""
    rows = scan.csv_reader(spark).csv(f"{_snapshot(spark, folder)}/current_predictions.csv")
    return rows.select(
        F.col("institution_id").cast("long"), "name", "state", F.col("enrollment").cast("double"),
        F.col("tuition_change_dollars").cast("double"), F.col("students_affected").cast("double"), "equity_risk_class",
    )


@query(
    "published_summary",
    f"""SELECT 'performance' AS scenario_name, count(*) AS total_colleges_affected,
      CAST(trunc(coalesce({exact_sum_sql("students_affected")}, 0)) AS BIGINT) AS total_students_impacted,
      {exact_mean_sql("tuition_change_dollars")} AS average_tuition_change_dollars,
      count(*) FILTER (equity_risk_class = 'High') AS high_risk_colleges FROM ({PUBLISHED})""",
)
def published_summary(spark, folder):
    """The summary of the current snapshot, with its scenario stamped on."""
    rows = spark.read.json(f"{_snapshot(spark, folder)}/current_summary.json")
    return rows.select(
        "scenario_name", "total_colleges_affected", "total_students_impacted", "average_tuition_change_dollars", "high_risk_colleges"
    )


@query(
    "run_status",
    """SELECT * FROM (VALUES ('performance', 'success', false), ('broken', 'error', true)) v(scenario, status, has_error)
      WHERE (SELECT count(*) FROM customer) > 0""",
)
def run_status(spark, folder):
    """The newest status of each scenario after a good run, a failure, and one
    that failed before it went well."""
    base, people = fresh_dir(spark, "run"), tables.institutions(spark, folder)
    policies = tables.catalogue(spark).filter("scenario = 'performance_based_funding'").drop("scenario")

    def broken(df):
        raise ValueError("no predictions today")

    for name, predict in (("performance", broken), ("performance", rule_predictor), ("broken", broken)):
        try:
            run_scenario(spark, name, policies, people, base, predict=predict)
        except ValueError:
            continue
    runs = sinks.latest_runs(spark, base)
    return runs.select("scenario", "status", F.col("error").isNotNull().alias("has_error"))


@query(
    "output_contract",
    """SELECT * FROM (VALUES ('name', true), ('latitude', false), ('longitude', false), ('state', true), ('tuition_change_dollars', true),
      ('students_affected', true), ('equity_risk_class', true), ('institution_id', true)) v("column", present) WHERE (SELECT count(*) FROM customer) > 0""",
)
def output_contract(spark, folder):
    """Which required columns an export of all institutions has."""
    return sinks.missing_output_columns(impact_view(spark, folder, CUT))


@query(
    "type_mismatches",
    """SELECT 'name' AS "column", 'double' AS expected, 'string' AS actual WHERE (SELECT count(*) FROM customer) > 0
      UNION ALL SELECT 'net_price', 'int', 'double'""",
)
def type_mismatches(spark, folder):
    expected = {"name": "double", "state": "string", "net_price": "int", "institution_id": "int", "absent": "int"}
    return quality.type_mismatches(tables.institutions(spark, folder), expected)


REPORTED = ("net_price", "tuition_change_dollars", "students_affected", "enrollment_change_pct")
_STATISTICS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, avg({c}) AS mean_value, min({c}) AS min_value, max({c}) AS max_value FROM ({PUBLISHED})"""
    for c in REPORTED
)


@query("scenario_reports", _STATISTICS, ("mean_value", "min_value", "max_value"))
def scenario_reports(spark, folder):
    """A run with analysis: the statistics of its scenario, read back as JSON."""
    base = fresh_dir(spark, "run")
    policies = tables.catalogue(spark).filter("scenario = 'performance_based_funding'").drop("scenario")
    done = run_scenario(spark, "performance", policies, tables.institutions(spark, folder), base, analysis=True)
    rows = spark.read.json(done["statistics"]).filter(F.col("column").isin(*REPORTED))
    return rows.select(
        "column", F.col("count").cast("long").alias("n"), F.col("mean").alias("mean_value"), F.col("min").alias("min_value"), F.col("max").alias("max_value")
    )


MERGE_SQL = """
WITH a AS (SELECT CASE WHEN o_custkey = 7 THEN NULL ELSE o_custkey END AS k, o_orderkey, o_totalprice AS price FROM orders),
b AS (SELECT CASE WHEN p_partkey = 7 THEN NULL ELSE p_partkey END AS k, p_size, p_retailprice AS price FROM part),
c AS (SELECT s_suppkey AS k, s_acctbal AS price FROM supplier),
ab AS (SELECT coalesce(a.k, b.k) AS k, a.o_orderkey, a.price, b.p_size, b.price AS price_results
  FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k)
SELECT coalesce(ab.k, c.k) AS institution_id, o_orderkey, ab.price, p_size, price_results, c.price AS price_supply
FROM ab FULL JOIN c ON ab.k IS NOT DISTINCT FROM c.k
"""


def _no_seven(column):
    return F.when(F.col(column) != 7, F.col(column))


@query("outer_merge", MERGE_SQL)
def outer_merge(spark, folder):
    """Three tables with repeated, unmatched and NULL keys and a shared name."""
    orders = _table(spark, folder, "orders")
    part = _table(spark, folder, "part")
    supplier = _table(spark, folder, "supplier")
    return merging.outer_merge(
        {
            "affordability": orders.select(
                _no_seven("o_custkey").alias("institution_id"), "o_orderkey", F.col("o_totalprice").alias("price")
            ),
            "results": part.select(
                _no_seven("p_partkey").alias("institution_id"), "p_size", F.col("p_retailprice").alias("price")
            ),
            "supply": supplier.select(
                F.col("s_suppkey").alias("institution_id"), F.col("s_acctbal").alias("price")
            ),
        }
    )


@query(
    "clean_names",
    "SELECT c_custkey AS institution_id, c_acctbal AS net_price_2024, c_name AS display_name FROM customer",
)
def clean_names(spark, folder):
    rows = _table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Institution-ID"),
        F.col("c_acctbal").alias("Net Price-2024"),
        F.col("c_name").alias("Display Name"),
    )
    return cleaning.normalise_names(rows)


FILL_NUMBERS = ("net_price", "enrollment", "pct_low_income", "pct_minority", "grad_rate", "never")


def _gappy(spark, folder):
    rows = tables.institutions(spark, folder)
    return rows.select(
        F.nullif(F.col("institution_id"), F.lit(5)).alias("institution_id"),
        F.nullif(F.col("state"), F.lit("NATION_4")).alias("state"),
        F.when(F.col("net_price") > 0, F.col("net_price")).alias("net_price"),
        "enrollment", "pct_low_income", "pct_minority", "grad_rate",
        F.lit(None).cast("double").alias("never"),
    )


@query(
    "clean_fill",
    f"""WITH g AS (SELECT nullif(institution_id, 5) AS institution_id, nullif(state, 'NATION_4') AS state,
        CASE WHEN net_price > 0 THEN net_price END AS net_price, enrollment, pct_low_income, pct_minority, grad_rate,
        NULL::DOUBLE AS never FROM ({INSTITUTIONS}))
      SELECT institution_id, coalesce(state, 'Unknown') AS state,
        coalesce(net_price, (SELECT quantile_cont(net_price, 0.5) FROM g), 0) AS net_price,
        coalesce(enrollment, (SELECT quantile_cont(enrollment, 0.5) FROM g), 0) AS enrollment,
        coalesce(pct_low_income, 0) AS pct_low_income, coalesce(pct_minority, 0) AS pct_minority,
        coalesce(grad_rate, 0) AS grad_rate, 0e0 AS never FROM g""",
    FILL_NUMBERS,
)
def clean_fill(spark, folder):
    return cleaning.fill_strings(cleaning.fill_numeric(_gappy(spark, folder)))


@query(
    "percent_rescale",
    """SELECT l_orderkey, l_linenumber, l_quantity AS fill_rate, l_discount * 100 AS discount_rate,
      l_tax * 100 AS tax_pct, l_tax AS tax FROM lineitem""",
    ("discount_rate", "tax_pct"),
)
def percent_rescale(spark, folder):
    rows = _table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("fill_rate"), F.col("l_discount").alias("discount_rate"),
        F.col("l_tax").alias("tax_pct"), F.col("l_tax").alias("tax"),
    )
    return cleaning.rescale_percent(rows)


@query(
    "coerce_numeric",
    """SELECT o_orderkey AS institution_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS tuition_text,
      NULL::DOUBLE AS gap_note, o_orderstatus AS status FROM orders
      UNION ALL SELECT NULL, NULL, NULL, o_orderstatus FROM orders""",
)
def coerce_numeric(spark, folder):
    price = F.col("o_totalprice").cast("string")
    rows = _table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("institution_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit("12,3")).otherwise(F.concat(F.lit(" "), price)).alias("tuition_text"),
        F.lit("n/a").alias("gap_note"),
        F.col("o_orderstatus").alias("status"),
    )
    bad = rows.withColumn("institution_id", F.lit("Unknown")).withColumn("tuition_text", F.lit("1d"))
    return rows.unionByName(bad).transform(cleaning.coerce_ids).transform(cleaning.coerce_numeric)


@query("dedup_rows", "SELECT DISTINCT l_partkey, l_returnflag, l_linestatus, l_quantity FROM lineitem")
def dedup_rows(spark, folder):
    rows = _table(spark, folder, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    return cleaning.drop_duplicate_rows(rows.unionByName(rows))


# two overlapping id ranges, gaps, a 0..1 percentage and text numbers
MASTER_SQL = """
WITH a AS (SELECT DISTINCT c_custkey AS k, c_acctbal * 4 AS net_price, c_acctbal / 2 AS affordability_gap,
    'NATION_' || c_nationkey AS state FROM customer),
b AS (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_size * 100e0 END AS enrollment, p_size / 64e0 AS grad_rate,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS min_wage FROM part),
m AS (SELECT coalesce(a.k, b.k) AS institution_id, net_price, affordability_gap, state, enrollment, grad_rate, min_wage
  FROM a FULL JOIN b ON a.k = b.k),
f AS (SELECT institution_id, coalesce(net_price, (SELECT quantile_cont(net_price, 0.5) FROM m)) AS net_price,
    coalesce(affordability_gap, (SELECT quantile_cont(affordability_gap, 0.5) FROM m)) AS affordability_gap,
    coalesce(state, 'Unknown') AS state,
    coalesce(enrollment, (SELECT quantile_cont(enrollment, 0.5) FROM m)) AS enrollment,
    coalesce(grad_rate, 0) * 100 AS grad_rate, min_wage FROM m),
r AS (SELECT *, min_wage / (net_price + 1) AS ratio FROM f),
t AS (SELECT *, max(affordability_gap) OVER () AS mg, max(ratio) OVER () AS mr, max(enrollment) OVER () AS me FROM r),
s AS (SELECT *, greatest(least((affordability_gap / mg * 100 + coalesce((1 - ratio / mr) * 100, 0))
    / (1 + (ratio IS NOT NULL)::INT), 100e0), 0e0) AS affordability_stress_score FROM t)
SELECT institution_id, net_price, affordability_gap, state, enrollment, grad_rate, min_wage, affordability_stress_score,
  25 * ((grad_rate < 50)::INT + (affordability_stress_score > 70)::INT) AS equity_risk_score,
  enrollment / me * 100 AS resilience_score FROM s
"""


@query(
    "build_master",
    MASTER_SQL,
    ("net_price", "affordability_gap", "enrollment", "grad_rate", "min_wage", "affordability_stress_score", "resilience_score"),
)
def master(spark, folder):
    return _master(spark, folder, fresh_dir(spark, "master")).drop(*NOT_SHOWN)


@query(
    "master_file",
    MASTER_SQL,
    ("net_price", "affordability_gap", "enrollment", "grad_rate", "min_wage", "affordability_stress_score", "resilience_score"),
)
def master_file(spark, folder):
    """The master's CSV file, read back by all its splits."""
    out = fresh_dir(spark, "master")
    schema = _master(spark, folder, out).schema
    return split_csv.read_csv_split(spark, f"{out}/master.csv", schema).drop(*NOT_SHOWN)


NOT_SHOWN = ("high_low_income", "high_minority", "low_grad_rate", "high_stress", "equity_risk_class")


def _master(spark, folder, out):
    customer, part = _table(spark, folder, "customer"), _table(spark, folder, "part")
    afford = customer.select(
        F.col("c_custkey").alias("Institution ID"),
        (F.col("c_acctbal") * 4).alias("Net-Price"),
        (F.col("c_acctbal") / 2).alias("Affordability Gap"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("State"),
    )
    size = F.col("p_size")
    results = part.select(
        F.col("p_partkey").alias("UNITID"),
        F.when(size > 25, size * 100.0).alias("Enrollment"),
        (size / 64.0).alias("Grad-Rate"),
        F.when(size % 5 != 0, F.col("p_retailprice").cast("string")).alias("Min Wage"),
    )
    # every row twice: cleaning removes the copies
    named = {
        "affordability": scan.with_key(afford.unionByName(afford), "Institution ID"),
        "results": scan.with_key(results),
    }
    return build_master(named, out).table
