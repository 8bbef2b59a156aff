import pytest
from pyspark.sql import functions as F

from impactspark.operators import duplicates, quality


def table(df, key="column"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def frame(spark):
    data = [(i, float(i), 50.0, None, "t") for i in range(20)] + [(20, 1000.0, 120.0, None, "t")]
    return spark.createDataFrame(
        data, "institution_id long, net_price double, grad_rate double, never double, note string"
    )


def test_missing(frame):
    found = table(quality.missing_profile(frame))
    assert (found["never"].missing_count, found["never"].missing_percentage) == (21, 100.0)
    assert found["net_price"].non_missing_count == 21
    assert [r["column"] for r in quality.empty_columns(frame).collect()] == ["never"]


def test_missing_of_no_rows(frame):
    found = table(quality.missing_profile(frame.limit(0)))
    assert found["note"].missing_percentage == 0.0


def test_outliers_by_both_methods(frame):
    iqr = table(quality.outliers(frame))
    assert set(iqr) == {"net_price", "grad_rate"}
    assert iqr["net_price"].outlier_count == 1
    assert iqr["net_price"].lower_bound == pytest.approx(5 - 15)
    assert iqr["net_price"].upper_bound == pytest.approx(15 + 15)
    assert iqr["net_price"].outlier_percentage == 4.76
    z = table(quality.outliers(frame, "zscore"))
    assert z["net_price"].outlier_count == 1 and z["net_price"].lower_bound is None
    with pytest.raises(ValueError):
        quality.outliers(frame, "other")


def test_ranges_and_consistency(spark):
    df = spark.createDataFrame(
        [(-1.0, 101.0, 9.0, 5.0), (3.0, None, 1.0, 5.0)],
        "enrollment double, grad_rate double, tuition double, total_cost double",
    )
    ranges = table(quality.range_checks(df))
    assert ranges["enrollment"].negative_rows == 1
    assert ranges["grad_rate"].outside_percent_range == 1
    assert ranges["tuition"].status == "valid"
    found = {r["check"]: (r.rows_found, r.severity) for r in quality.consistency(df).collect()}
    assert found == {
        "enrollment_positive": (1, "high"),
        "grad_rate_range": (1, "medium"),
        "tuition_vs_total_cost": (1, "medium"),
    }


def test_score(spark):
    # one missing column (-2), one duplicate row (-1), one issue (-5)
    df = spark.createDataFrame([(-1.0, None), (-1.0, None), (2.0, 3.0)], "enrollment double, x double")
    row = quality.quality_score(df).first()
    assert (row.missing_columns, row.outlier_columns, row.duplicate_rows, row.consistency_issues) == (1, 0, 1, 1)
    assert row.overall_quality_score == 92
    assert row.checks_performed == 4


def test_types_are_compared_by_name(frame):
    found = quality.type_mismatches(frame, {"net_price": "double", "note": "int", "absent": "int"})
    assert [tuple(r) for r in found.collect()] == [("note", "int", "string")]


def test_duplicate_keys_count_null_as_a_value(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k long")
    row = quality.duplicate_keys(df, ["k", "absent"]).first()
    assert (row.duplicate_count, row.unique_count, row.duplicate_percentage) == (2, 2, 40.0)
    with pytest.raises(ValueError):
        quality.duplicate_keys(df, ["absent"])


def test_completeness_ratings(spark):
    for known, rating in ((20, "Excellent"), (18, "Good"), (14, "Fair"), (13, "Poor")):
        df = spark.range(20).select(F.when(F.col("id") < known, F.lit(1)).alias("v"))
        assert quality.completeness(df).first().quality_rating == rating


def test_repeated_ids(spark):
    df = spark.createDataFrame(
        [
            (1, "a", None, 1.0), (1, "a", None, 1.0),
            (2, "a", None, 1.0), (2, "b", 3.0, 1.0),
            (3, "c", 1.0, 1.0),
            (None, "x", 1.0, 1.0), (None, "y", 1.0, 1.0),
        ],
        "unit_id long, a string, b double, c double",
    )
    ids = {r.unit_id: (r.row_count, r.kind, r.different_columns) for r in duplicates.classify_ids(df, "unit_id").collect()}
    assert ids == {1: (2, "true_duplicate", []), 2: (2, "different_records", ["a", "b"])}
    summary = duplicates.classify_summary(df, "unit_id").first()
    assert (summary.duplicated_keys, summary.true_duplicates, summary.different_records) == (2, 1, 1)
    assert summary.recommendation == "review_source"
    assert [tuple(r) for r in duplicates.multiplicity(df, "unit_id").collect()] == [(2, 2)]
