import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from impactspark.functions import quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["a", "b", None], n, p=[0.6, 0.3, 0.1]),
            "wide": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
            "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)),
            "few": rng.integers(-3, 3, n).astype(float),
            "near": 1.0 + rng.integers(0, 50, n) * 2.0**-52,
        }
    )
    pdf.loc[::9, "wide"] = None
    pdf.loc[1, "wide"] = 2.0**50
    pdf.loc[2, "wide"] = np.nextafter(2.0**50, 0)
    pdf.loc[3, "wide"] = 5e-324
    return pdf


COLUMNS = ["wide", "hot", "few", "near"]


@pytest.mark.parametrize("sorted_rows", [quantiles.SORTED_ROWS, 1])
def test_columns_match_linear_interpolation(spark, frame, monkeypatch, sorted_rows):
    monkeypatch.setattr(quantiles, "SORTED_ROWS", sorted_rows)
    df = spark.createDataFrame(frame)
    found = quantiles.column_quantiles(df, COLUMNS, PROBS)
    for c in COLUMNS:
        np.testing.assert_allclose(found[c], frame[c].quantile(PROBS), rtol=1e-12)


@pytest.mark.parametrize("small", [True, False])
def test_groups_leave_out_null_keys(spark, frame, small):
    df = spark.createDataFrame(frame)
    table = quantiles.exact_quantiles(df, COLUMNS, [0.5, 0.3], ["g"], small).toPandas()
    assert set(table["g"]) == {"a", "b"}
    for _, row in table.iterrows():
        want = frame[frame["g"] == row["g"]][row["column"]].quantile([0.5, 0.3])
        np.testing.assert_allclose(row["q"], want, rtol=1e-12)


def test_nothing_and_one_value(spark):
    df = spark.createDataFrame([(None, 4.0), (None, None)], "a double, b double")
    assert quantiles.column_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [4.0]}
    assert quantiles.column_quantiles(df.limit(0), ["a"], [0.1, 0.9]) == {"a": [None, None]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=30))
def test_median_of_any_floats(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    (low, high) = quantiles.column_quantiles(df, ["v"], [0.0, 1.0])["v"]
    assert (low, high) == (min(values), max(values))


def test_few_groups(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    assert quantiles.few_groups(df, ["k"], 50)
    assert not quantiles.few_groups(df, ["k"], 49)


def test_rank_like_pandas(spark, frame):
    pdf = frame.assign(id=range(len(frame)))
    df = spark.createDataFrame(pdf[["id", *COLUMNS]])
    from pyspark.sql import functions as F

    for c in COLUMNS:
        ranked = quantiles.with_rank(df.withColumn("v", F.nanvl(c, F.lit(None))), F.col("v"), "r")
        found = ranked.select("id", "r").toPandas().sort_values("id")["r"].tolist()
        want = pdf[c].rank(method="min", ascending=False, na_option="bottom").astype(int).tolist()
        assert found == want
