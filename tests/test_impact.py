import pytest
from pyspark.sql import functions as F

from impactspark.operators import dashboard, impact, outcomes
from impactspark.sources import sinks, tables


@pytest.fixture(scope="module")
def people(spark):
    kinds = ["Public Two-Year", "Public Four-Year", "Community College", "Private For-Profit", "public", "Odd", None]
    return spark.createDataFrame(
        [(i, f"n{i}", "X" if i % 2 else "Y", k, 20000.0, 1000.0, 40.0, 30.0, 60.0) for i, k in enumerate(kinds)],
        "institution_id long, name string, state string, institution_type string, net_price double, "
        "enrollment double, pct_low_income double, pct_minority double, grad_rate double",
    )


def ids(df):
    return sorted(r.institution_id for r in df.collect())


def test_type_filter(people):
    assert ids(impact.filter_affected(people, ["public"])) == [0, 1]
    assert ids(impact.filter_affected(people, ["public", "community"])) == [0, 1, 2]
    assert ids(impact.filter_affected(people, ["Odd"])) == [5]
    assert ids(impact.filter_affected(people, ["public"], case_insensitive=True)) == [0, 1, 4]
    assert ids(impact.filter_affected(people)) == list(range(7))
    assert ids(impact.filter_affected(people, ["public"], ["X"])) == [1]


@pytest.mark.parametrize("limit", [impact.POLICY_BROADCAST_ROWS, 0])
def test_policies_meet_the_types_they_name(spark, people, monkeypatch, limit):
    monkeypatch.setattr(impact, "POLICY_BROADCAST_ROWS", limit)
    policies = spark.createDataFrame(
        [("p", ["public", "community"], 1.0), ("all", [], 2.0), ("null", None, 3.0), ("odd", ["Odd"], 4.0)],
        "scenario string, affected_types array<string>, funding_change_pct double",
    )
    pairs = impact.attach_policies(people, policies)
    found = {}
    for r in pairs.collect():
        found.setdefault(r.scenario, []).append(r.institution_id)
    assert {k: sorted(v) for k, v in found.items()} == {
        "p": [0, 1, 2], "all": list(range(7)), "null": list(range(7)), "odd": [5],
    }
    assert "affected_types" not in pairs.columns


def one(spark, **policy):
    row = spark.createDataFrame(
        [(1, "public", 20000.0, 1000.0, 40.0, 30.0)],
        "institution_id long, institution_type string, net_price double, enrollment double, "
        "pct_low_income double, pct_minority double",
    )
    given = dict(funding_change_pct=0.0, min_wage_change=0.0, childcare_subsidy=0.0, tuition_cap_pct=0.0) | policy
    return impact.derived_metrics(outcomes.outcomes(row.withColumns(impact.policy_columns(**given)))).first()


def test_outcomes_by_hand(spark):
    r = one(spark, funding_change_pct=-10.0)
    assert r.tuition_change_pct == -6.0
    assert r.tuition_change_dollars == -1200.0
    assert r.enrollment_change_pct == pytest.approx(1.2 * 3.5)
    assert r.grad_rate_change == pytest.approx(-0.06 * 2)
    assert r.equity_risk_score == pytest.approx(16 + 9 + 18)
    assert r.equity_risk_class == "Medium"
    assert r.students_affected == pytest.approx(42.0)
    assert r.hours_to_cover_gap == pytest.approx(-80.0)
    r = one(spark, funding_change_pct=10.0, tuition_cap_pct=2.0, min_wage_change=-3.0, childcare_subsidy=2000.0)
    assert r.tuition_change_pct == 2.0
    assert r.enrollment_change_pct == pytest.approx(-0.4 * 3.5 + 0.6)
    assert r.hours_to_cover_gap == pytest.approx(400.0)  # a wage under 1 counts as 1


def test_defaults_for_missing_values(spark):
    df = spark.createDataFrame([(1, None, -5.0), (2, 7.0, None)], "institution_id long, enrollment double, net_price double")
    rows = {r.institution_id: r for r in outcomes.baselines(df).collect()}
    assert rows[1].baseline_tuition == 10000.0 and rows[2].baseline_tuition == 10000.0
    assert rows[1]["_enrollment"] == 5000.0 and rows[2]["_enrollment"] == 7.0
    assert impact.with_feature_columns(df).first().pct_minority == 25.0


def test_summary_truncates_and_counts(spark):
    df = spark.createDataFrame(
        [(i, f"n{i}", 100.0 if i < 12 else None, 0.4, "High" if i == 0 else "Low") for i in range(14)],
        "institution_id long, name string, tuition_change_dollars double, students_affected double, equity_risk_class string",
    )
    row = impact.plain_sentence(impact.impact_summary(df)).first()
    assert row.total_colleges_affected == 14 and row.total_students_impacted == 5
    assert row.equity_risk_breakdown == {"High": 1, "Low": 13}
    assert [e.institution_id for e in row.top_most_affected] == list(range(10))
    assert row.average_tuition_change_pct == 0.0
    assert row.plain_language_summary == "This bill affects 14 colleges and 5 students."
    empty = impact.impact_summary(df.limit(0)).first()
    assert empty.total_colleges_affected == 0 and empty.total_students_impacted == 0


def test_class_totals_add_up(spark):
    rows = impact.derived_metrics(
        outcomes.outcomes(
            tables.institutions(spark, "/root/testdata/sf0.001").withColumns(impact.policy_columns(-10.0)),
            detailed_types=True,
        )
    )
    table = impact.equity_table(rows).collect()
    summary = impact.impact_summary(rows).first()
    assert sum(r.college_count for r in table) == summary.total_colleges_affected
    assert int(sum(r.total_students_affected for r in table)) == summary.total_students_impacted
    for r in table:
        assert r.total_tuition_impact == pytest.approx(r.avg_tuition_change * r.college_count)


def test_sampling(spark, people):
    draws = outcomes.sample_scenarios(people, 500, seed=7)
    pdf = draws.toPandas()
    assert len(pdf) == 500 and pdf["draw_id"].is_unique
    assert pdf["funding_change_pct"].between(-20, 10).all()
    assert set(pdf["institution_type"].dropna()) == {r[0] for r in people.select("institution_type").collect() if r[0]}
    again = outcomes.sample_scenarios(people.repartition(2), 500, seed=7).toPandas()
    key = ["draw_id"]
    assert pdf.sort_values(key, ignore_index=True).equals(again.sort_values(key, ignore_index=True))


def test_row_numbers_have_no_gaps(spark):
    rows = outcomes.numbered(spark.range(1000).repartition(7))
    assert sorted(r[0] for r in rows.select("_row").collect()) == list(range(1000))


def test_fields(spark):
    df = spark.createDataFrame(
        [(1, 2500.0, 60.0, "High"), (2, -0.3, 40.0, "Odd"), (3, -1000.0, None, None), (4, 1000.0, 50.0, "Low")],
        "institution_id long, tuition_change_dollars double, pct_low_income double, equity_risk_class string",
    ).withColumns({"tuition_change_pct": F.lit(-6.0), "students_affected": F.lit(2.5)})
    rows = {r.institution_id: r for r in dashboard.dashboard_fields(df).collect()}
    assert [rows[i].impact_severity for i in (1, 2, 4)] == ["Severe", "Positive", "Moderate"]
    assert [rows[i].impact_severity_bin for i in (1, 2, 3, 4)] == [
        "Severe Positive", "Moderate Negative", "Severe Negative", "Positive",
    ]
    assert [rows[i].impact_category for i in (1, 4)] == ["Crisis", "High Impact"]
    assert [rows[i].risk_color for i in (1, 2)] == ["#FF0000", None]
    assert [rows[i].formatted_tuition_change for i in (1, 2, 3)] == ["$2,500", "$-0", "$-1,000"]
    assert rows[3].quadrant is None and rows[1].quadrant == "vulnerable_high_impact"


def test_export_order_and_fill(spark):
    df = spark.createDataFrame(
        [(5.0, None, None, 1)], "net_price double, state string, total_enrollment double, institution_id long"
    ).withColumn("institution_name", F.lit("N")).withColumn("latitude", F.lit(None).cast("double"))
    out = sinks.impact_export(df)
    assert out.columns == ["institution_id", "name", "state", "latitude", "net_price", "total_enrollment"]
    assert tuple(out.first()) == (1, "N", "Unknown", 0.0, 5.0, 0.0)
    contract = {r["column"]: r.present for r in sinks.missing_output_columns(out).collect()}
    assert contract["longitude"] is False and contract["name"] is True


def test_institutions_of_one_partition_meet_policies_in_many_tasks(spark, monkeypatch):
    people = spark.range(200).select(F.col("id").alias("institution_id"), F.lit("Community College").alias("institution_type")).coalesce(1)
    policies = spark.range(30).select(F.col("id").alias("policy_id"), F.array(F.lit("community")).alias("affected_types"))
    pairs = impact.attach_policies(people, policies)
    assert pairs.rdd.getNumPartitions() == impact.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert pairs.count() == pairs.distinct().count() == 200 * 30
    monkeypatch.setattr(impact, "TASK_PAIRS", 100)
    assert impact.attach_policies(people, policies).rdd.getNumPartitions() == 60


def test_the_best_of_a_group_are_found_without_sorting_it(spark):
    nan = float("nan")
    size = {
        "ties": lambda i: 0.0 if i % 2 else -0.0,
        "falling": lambda i: -float(i),
        "odd": lambda i: nan if i < 4 else None if i % 2 else float(i % 50),
        None: lambda i: float(i % 7),
    }
    rows = [(g, i if i % 97 else None, f"n{i}", f(i)) for g, f in size.items() for i in range(5000)]
    rows += [("few", i, f"n{i}", 1.0) for i in range(4)] + [("same", 1, "n", 2.0)] * 30
    df = spark.createDataFrame(rows, "g string, institution_id long, name string, tuition_change_dollars double").repartition(5)
    listed = lambda d: sorted(map(str, impact.top_per_group(d, ["g"]).drop("affected_rank").collect()))
    near = impact.near_top(df, ["g"])
    assert listed(near) == listed(df)
    assert near.count() < df.count() / 4
    text = df.withColumn("institution_id", F.col("institution_id").cast("string"))
    assert listed(impact.near_top(text, ["g"])) == listed(text)
    every = df.withColumns({"students_affected": F.lit(1.0), "equity_risk_class": F.lit("Low")})
    found = [sorted(map(str, impact.impact_summary(every, ["g"], few=few).collect())) for few in (False, True)]
    assert found[0] == found[1]


def test_no_policy_moves_no_institution(spark, people):
    none = spark.createDataFrame([], "policy_id long, affected_types array<string>")
    pairs = impact.attach_policies(people, none)
    assert pairs.count() == 0
    assert pairs.rdd.getNumPartitions() <= people.rdd.getNumPartitions()


@pytest.mark.parametrize("dropped", [(), ("name", "tuition_change_pct", "pct_minority")])
def test_one_pass_gives_equity_and_summary(spark, dropped):
    """The pairs of a batch are added once: both tables follow from the totals,
    with the bits that each has from rows of its own."""
    nan, inf = float("nan"), float("inf")
    classes = ["High", "Low", None, "Medium", "odd"]
    rows = [
        (f"p{i % 7}", None if i % 41 == 0 else i % 97, f"n{i % 5}", classes[i % 5], 0.1 * i, None if i % 7 == 3 else (inf if i == 77 else -7.3 / (i + 1)),
         1e17 if i == 55 else i / 3, nan if i == 12 else 1.0 * i, None if i % 2 else i / 7, 30.0 + i % 40, None if i % 11 == 0 else 25.0 + i % 60)
        for i in range(500)
    ]
    schema = "policy_id string, institution_id long, name string, equity_risk_class string, " + ", ".join(
        f"{c} double" for c in (*impact.MEASURES, "pct_minority", "pct_low_income")
    )
    df = spark.createDataFrame(rows, schema).repartition(5).drop(*dropped)
    for part in (df, df.limit(0)):
        totals = impact.class_totals(part, ["policy_id"])
        one, two = impact.equity_from_totals(totals, ["policy_id"]), impact.summary_from_totals(totals, part, ["policy_id"], few=True)
        old = impact.equity_table(part, ["policy_id"]), impact.impact_summary(part, ["policy_id"], few=True)
        for new, was in zip((one, two), old, strict=True):
            assert [(f.name, f.dataType) for f in new.schema] == [(f.name, f.dataType) for f in was.schema]
            assert sorted(map(str, new.collect())) == sorted(map(str, was.collect()))
    assert "equity_risk_class" in totals.columns and one.count() == 0
