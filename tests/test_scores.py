import pytest
from pyspark.sql import functions as F

from impactspark.operators import groups, metrics, scores, stats


def values(df, column, key="id"):
    return {r[key]: r[column] for r in df.collect()}


def test_stress_skips_missing_parts(spark):
    df = spark.createDataFrame(
        [(1, 10.0, 2.0, 3.0), (2, None, 4.0, 3.0), (3, None, None, None)],
        "id long, affordability_gap double, hours_to_cover double, min_wage double",
    )
    # no cost column: the wage part does not count
    assert values(scores.stress_score(df), "affordability_stress_score") == {1: 75.0, 2: 100.0, 3: None}


def test_stress_when_no_maximum_is_positive(spark):
    df = spark.createDataFrame(
        [(1, -5.0, 10.0, -3.0), (2, None, 10.0, -4.0)], "id long, gap double, wage double, cost double"
    )
    # gap part 0 and wage part 50 for every row
    assert values(scores.stress_score(df), "affordability_stress_score") == {1: 25.0, 2: 25.0}
    assert values(scores.stress_score(df.select("id")), "affordability_stress_score") == {1: 0.0, 2: 0.0}


def test_indicators(spark):
    df = spark.createDataFrame(
        [(1, 51.0, 51.0, 49.0), (2, 50.0, 51.0, None), (3, None, None, 50.0)],
        "id long, pell_pct double, pct_minority double, graduation_rate double",
    )
    out = scores.equity_indicators(df)
    assert values(out, "equity_risk_score") == {1: 75, 2: 25, 3: 0}
    assert values(out, "equity_risk_class") == {1: "High", 2: "Low", 3: "Low"}


@pytest.mark.parametrize(
    ("score", "name"),
    [(33.0, "Low"), (33.00001, "Medium"), (66.0, "Medium"), (66.00000000001, "High"), (66.1, "High"), (None, None)],
)
def test_class_cuts(spark, score, name):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(scores.risk_class(F.col("s"))).first()[0] == name


def test_resilience(spark):
    df = spark.createDataFrame(
        [(1, 100.0, "private", 0.5), (2, 50.0, "Private", 1.0), (3, None, None, None)],
        "id long, enrollment double, institution_type string, funding_dependency double",
    )
    out = values(scores.resilience_score(df), "resilience_score")
    assert out == {1: pytest.approx((100 + 80 + 50) / 3), 2: pytest.approx(100 / 3), 3: 50.0}


IMPACT = "institution_id long, name string, state string, tuition_change_dollars double, students_affected double"


def test_impact_score_counts_the_enrollment_part_as_zero(spark):
    df = spark.createDataFrame(
        [(1, -100.0, 5.0, -3.0), (2, 50.0, None, 2.0)],
        "id long, tuition_change_dollars double, hours_to_cover_gap double, enrollment_change_pct double",
    )
    assert values(scores.impact_score(df), "affordability_impact_score") == {
        1: pytest.approx(200 / 3), 2: pytest.approx(25.0),
    }
    signed = values(scores.impact_score(df, signed=True), "affordability_impact_score")
    assert signed[1] == pytest.approx(100.0)


def test_vulnerability_is_zero_when_nothing_rises(spark):
    df = spark.createDataFrame(
        [(1, "a", "X", -1.0, 2.0), (2, "b", "Y", -2.0, 3.0), (3, "c", None, 9.0, 9.0)], IMPACT
    )
    out = [(r.state, r.vulnerability_score, r["rank"]) for r in scores.state_vulnerability(df).orderBy("rank").collect()]
    assert out == [("X", 0.0, 1), ("Y", 0.0, 2)]


def test_resilience_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, f"n{i}", "X", 5.0, 0.0) for i in range(30, 0, -1)], IMPACT)
    out = scores.impact_resilience(df).orderBy("resilience_rank").collect()
    assert [r.institution_id for r in out] == list(range(1, 21))


def test_equity_gap_needs_both_sides(spark):
    df = spark.createDataFrame([(60.0, 10.0), (70.0, 20.0)], "pct_minority double, tuition_change_dollars double")
    assert groups.equity_gap(df).count() == 0
    both = df.union(spark.createDataFrame([(50.0, 5.0), (None, 99.0)], df.schema))
    assert [tuple(r) for r in groups.equity_gap(both).collect()] == [("minority_gap", 15.0, 5.0, 10.0)]


def test_group_stats_of_single_rows_and_null_keys(spark):
    df = spark.createDataFrame(
        [("A", 1.0, None), ("B", 2.0, None), ("B", 4.0, None), (None, 9.0, 1.0)], "state string, x double, y double"
    )
    out = {r.state: r for r in groups.group_stats(df, ["state", "absent"]).collect()}
    assert set(out) == {"A", "B"}
    assert out["A"].x_std is None and out["B"].x_median == 3.0 and out["B"].y_count == 0
    assert groups.group_stats(df, ["absent"]).columns == df.columns
    with pytest.raises(ValueError):
        groups.group_stats(df, ["state"], {"x": ["mode"]})


def test_rank_shares_places(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.3), ("c", 1.0)], "state string, v double")
    out = {r.state: r.impact_rank for r in groups.rank_groups(df, "state", "v").collect()}
    assert out == {"a": 2, "b": 2, "c": 1}


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "x double, k double")
    corr = {(r.column_a, r.column_b): r.correlation for r in stats.correlations(df).collect()}
    assert corr[("x", "x")] == pytest.approx(1.0)
    assert corr[("x", "k")] is None and corr[("k", "x")] is None
    bins = [(r["column"], r.bin, r.row_count) for r in stats.histogram(df, ["x", "k"], 4).collect()]
    assert sorted(bins) == [("k", 1, 3), ("x", 1, 1), ("x", 4, 1)]
    matrix = {r["column"]: r for r in stats.correlation_matrix(df).collect()}
    assert matrix["x"]["x"] == pytest.approx(1.0)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string")
    report = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert (report["a"].precision, report["a"].recall, report["a"].f1) == (0.5, 0.5, 0.5)
    assert (report["c"].precision, report["c"].recall, report["c"].f1) == (0.0, 0.0, 0.0)
    row = metrics.class_metrics(df).first()
    assert row.accuracy == 0.5
    assert row.f1_weighted == pytest.approx((0.5 * 2 + 2 / 3) / 4)
    numbers = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "label double, prediction double")
    found = metrics.regression_metrics(numbers).first()
    assert found.r2 == pytest.approx(0.5) and found.mae == pytest.approx(1 / 3)
