import pandas as pd
import pytest
from pyspark.sql import functions as F

from impactspark.operators import cleaning, merging
from impactspark.sources import scan


def rows(df, *order):
    return sorted((tuple(r) for r in df.select(*(order or df.columns)).collect()), key=str)


def test_fill_uses_median_or_zero(spark):
    df = spark.createDataFrame(
        [(1, 10.0, None, None, "x"), (2, None, 0.5, None, None), (None, 30.0, 0.7, None, "y")],
        "institution_id long, net_price double, grad_rate double, never double, state string",
    )
    out = cleaning.fill_strings(cleaning.fill_numeric(df)).collect()
    assert [r.net_price for r in out] == [10.0, 20.0, 30.0]
    assert [r.grad_rate for r in out] == [0.0, 0.5, 0.7]
    assert [r.never for r in out] == [0.0, 0.0, 0.0]
    assert [r.state for r in out] == ["x", "Unknown", "y"]
    assert out[2].institution_id is None


def test_fill_without_gaps_or_rows_changes_nothing(spark):
    df = spark.createDataFrame([(1, 2.0)], "a long, b double")
    assert rows(cleaning.fill_numeric(df)) == [(1, 2.0)]
    assert cleaning.fill_numeric(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("values", "want"),
    [([0.0, 0.5, 1.0], [0.0, 50.0, 100.0]), ([0.5, 1.5], [0.5, 1.5]), ([-0.1, 0.5], [-0.1, 0.5]), ([None], [None])],
)
def test_percent_rescale_looks_at_the_whole_column(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "pct_low_income double")
    assert [r[0] for r in cleaning.rescale_percent(df).collect()] == want


def test_text_gap_ends_as_null_again(spark):
    df = spark.createDataFrame(
        [(" 7 ", "12", "a"), ("x", None, "b"), ("9.9", "12,3", "c"), ("9.9", "12,3", "c")],
        "`Institution-ID` string, `Tuition Cost` string, Note string",
    )
    out = cleaning.clean(df)
    assert out.columns == ["institution_id", "tuition_cost", "note"]
    assert rows(out) == [(7, 12.0, "a"), (9, None, "c"), (None, None, "b")]


def test_numbers_with_suffix_are_not_numbers(spark):
    df = spark.createDataFrame([("1d",), ("1e3",), (".5",), ("",), ("nan",)], "gap string")
    assert [r[0] for r in cleaning.coerce_numeric(df).collect()] == [None, 1000.0, 0.5, None, None]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    from impactspark.functions.columns import nan_to_null

    assert rows(nan_to_null(df)) == [(1.0,), (None,)]


@pytest.mark.parametrize(
    ("columns", "want"),
    [
        (["a", "institution_id"], "institution_id"),
        (["UnitID", "x"], "UnitID"),
        (["x", "opeid", "id"], "id"),
        (["Unique Identification Number of the Institution"], "Unique Identification Number of the Institution"),
        (["community", "name"], None),
    ],
)
def test_find_key(columns, want):
    assert scan.find_key(columns) == want


def test_configured_key_wins():
    assert scan.find_key(["id", "code"], "code") == "code"
    assert scan.find_key(["id"], "code") == "id"


LEFT = pd.DataFrame({"institution_id": [1, 1, 2, None, 5], "price": [1.0, 2.0, 3.0, 4.0, 5.0]})
RIGHT = pd.DataFrame({"institution_id": [1, 1, 3, None], "price": [9.0, 8.0, 7.0, 6.0], "size": [1, 2, 3, 4]})
THIRD = pd.DataFrame({"institution_id": [3.0, 8.0], "size": [30, 80]})


def test_outer_merge_like_pandas(spark):
    schema = "institution_id double, price double"
    frames = {
        "first": spark.createDataFrame(LEFT, schema),
        "second": spark.createDataFrame(RIGHT, schema + ", size long"),
        "third": spark.createDataFrame(THIRD, "institution_id double, size long"),
        "fourth": spark.createDataFrame([(8.0, "z")], "institution_id double, tag string"),
    }
    out = merging.outer_merge(frames)
    assert out.columns == ["institution_id", "price", "price_second", "size", "size_third", "tag"]
    want = LEFT.merge(RIGHT, on="institution_id", how="outer", suffixes=("", "_second"))
    want = want.merge(THIRD, on="institution_id", how="outer", suffixes=("", "_third"))
    want = want.merge(pd.DataFrame({"institution_id": [8.0], "tag": ["z"]}), on="institution_id", how="outer")

    def plain(pdf):
        return sorted([tuple("-" if pd.isna(v) else str(v) for v in r) for r in pdf.astype(object).values])

    assert plain(out.toPandas().astype({"size": float, "size_third": float})) == plain(want)


def test_merge_skips_a_table_without_key(spark):
    a = spark.createDataFrame([(1,)], "institution_id long")
    b = spark.createDataFrame([(1,)], "other long")
    assert merging.outer_merge({"a": a, "b": b}).columns == ["institution_id"]


def test_missing_file_is_skipped_and_none_is_an_error(spark, tmp_path):
    spark.range(3).withColumn("net_price", F.lit(1.5)).write.option("header", True).csv(f"{tmp_path}/a.csv")
    found = scan.read_sources(spark, {"a": "a.csv", "b": "b.csv"}, folder=str(tmp_path))
    assert list(found) == ["a"]
    assert found["a"].columns == ["institution_id", "net_price"]
    with pytest.raises(ValueError, match="none of the data sets"):
        scan.read_sources(spark, {"b": "b.csv"}, folder=str(tmp_path))


def test_null_keys_apart(spark):
    from impactspark.operators import merging

    left = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "institution_id long, x string")
    right = spark.createDataFrame([(1, "d"), (None, "e"), (None, "f")], "institution_id long, y string")
    assert merging.outer_merge({"l": left, "r": right}).count() == 5
    rows = {(r.institution_id, r.x, r.y) for r in merging.outer_merge({"l": left, "r": right}, null_keys="apart").collect()}
    assert rows == {(1, "a", "d"), (None, "b", None), (None, "c", None), (None, None, "e"), (None, None, "f")}


def test_duplicates_by_hash_tell_nulls_apart(spark):
    from impactspark.operators import quality

    rows = [(None, "a"), ("a", None), ("a", None), (None, None), (None, None), ("", None)]
    assert quality.duplicate_rows(spark.createDataFrame(rows, "x string, y string")).first().duplicate_rows == 2
