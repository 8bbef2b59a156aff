"""Feature, metric and model queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from impactspark import fixed
from impactspark.functions.exact import exact_mean
from impactspark.operators import attribution, features, impact, learning, metrics, outcomes
from impactspark.plans.scenario import model_predictor
from impactspark.registry.base import INSTITUTIONS, MIXED, impact_sql, impact_view, query
from impactspark.sources import tables
from impactspark.sources.folders import cut_lineage
from impactspark.sources.scan import read_table

IMPACT = impact_sql(MIXED)
PRODUCTS = tuple(f"{a}_x_{b}" for a, b in fixed.INTERACTIONS)
FLAG_SQL = """coalesce(pct_low_income > 50 AND baseline_grad_rate < 50, false)::INT AS high_risk_institution,
  coalesce(pct_minority > 50, false)::INT AS minority_serving, coalesce(enrollment < 2000, false)::INT AS small_enrollment"""
PRODUCT_SQL = ", ".join(f"{a} * {b} AS {a}_x_{b}" for a, b in fixed.INTERACTIONS)


def mixed(spark, folder):
    return impact_view(spark, folder, MIXED)


@query("interactions", f"SELECT institution_id, {PRODUCT_SQL} FROM ({IMPACT})", PRODUCTS, 4)
def interactions(spark, folder):
    return features.interactions(mixed(spark, folder)).select("institution_id", *PRODUCTS)


@query("binary_flags", f"SELECT institution_id, {FLAG_SQL} FROM ({IMPACT})")
def binary_flags(spark, folder):
    return features.binary_flags(mixed(spark, folder)).select("institution_id", *features.FLAGS)


CODES = (
    "dense_rank() OVER (ORDER BY state) - 1e0 AS state_encoded, "
    "dense_rank() OVER (ORDER BY institution_type) - 1e0 AS institution_type_encoded"
)


@query("label_encode", f"SELECT institution_id, {CODES} FROM ({IMPACT})")
def label_encode(spark, folder):
    encoded, _ = features.label_encode(mixed(spark, folder))
    return encoded.select("institution_id", "state_encoded", "institution_type_encoded")


@query(
    "dictionary_codes",
    """SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY k) - 1e0 AS name_encoded, dense_rank() OVER (ORDER BY l_returnflag) - 1e0 AS l_returnflag_encoded
      FROM (SELECT *, CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE CAST(l_orderkey AS VARCHAR) END AS k FROM lineitem)""",
)
def dictionary_codes(spark, folder):
    """Codes of a column of nearly as many labels as rows, and of one with three."""
    rows = read_table(spark, folder, "lineitem")
    key = F.when(F.col("l_orderkey") % 3 == 0, "hot").otherwise(F.col("l_orderkey").cast("string"))
    rows = rows.withColumn("name", F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), key))
    encoded, _ = features.label_encode(rows, ["name", "l_returnflag"])
    return encoded.select("l_orderkey", "l_linenumber", "name_encoded", "l_returnflag_encoded")


SCALED = ("net_price", "affordability_gap", "min_wage", "funding_change_pct")


@query(
    "zscale",
    "SELECT institution_id, "
    + ", ".join(
        f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END AS {c}_scaled"
        for c in SCALED
    )
    + f" FROM ({IMPACT})",
    [f"{c}_scaled" for c in SCALED],
)
def zscale(spark, folder):
    return features.zscale(mixed(spark, folder), SCALED).select(
        "institution_id", *[f"{c}_scaled" for c in SCALED]
    )


ALL_FEATURES = (
    *fixed.NUMERIC_FEATURES, *PRODUCTS, "high_risk_institution", "minority_serving", "small_enrollment",
    "state_encoded", "institution_type_encoded",
)


@query(
    "feature_matrix",
    f"SELECT institution_id, "
    + ", ".join(
        f"(coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / CASE WHEN stddev_pop(coalesce({c}, 0)) OVER () > 1e-9 "
        f"THEN stddev_pop(coalesce({c}, 0)) OVER () ELSE 1 END AS {c}"
        for c in ALL_FEATURES
    )
    + f" FROM (SELECT *, {PRODUCT_SQL}, {FLAG_SQL}, {CODES} FROM ({IMPACT}))",
    ALL_FEATURES,
)
def feature_matrix(spark, folder):
    """The 18 scaled model inputs, one column each."""
    ready, fitted = features.prepare_features(mixed(spark, folder))
    values = vector_to_array("features")
    return ready.select(
        "institution_id", *[values[i].alias(c.removeprefix("f_")) for i, c in enumerate(fitted.columns)]
    )


LABELLED = "SELECT quality AS label, toxic AS prediction FROM labels"


def _labelled(spark, folder):
    rows = spark.read.parquet(f"{folder}/labels.parquet")
    return rows.select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@query("confusion", f"SELECT label, prediction, count(*) AS row_count FROM ({LABELLED}) GROUP BY ALL")
def confusion(spark, folder):
    return metrics.confusion(_labelled(spark, folder))


REPORT = f"""SELECT class, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
  CASE WHEN predicted + support > 0 THEN 2e0 * hits / (predicted + support) ELSE 0 END AS f1, support, hits
FROM (SELECT class, (SELECT count(*) FROM ({LABELLED}) WHERE label = class AND prediction = class)::DOUBLE AS hits,
    (SELECT count(*) FROM ({LABELLED}) WHERE label = class) AS support,
    (SELECT count(*) FROM ({LABELLED}) WHERE prediction = class) AS predicted
  FROM (SELECT label AS class FROM ({LABELLED}) UNION SELECT prediction FROM ({LABELLED})))"""


@query(
    "class_report",
    f"SELECT class, precision, recall, f1, support FROM ({REPORT})",
    ("precision", "recall", "f1"),
)
def class_report(spark, folder):
    return metrics.class_report(_labelled(spark, folder)).drop("hits")


@query(
    "class_metrics",
    f"SELECT sum(hits) / sum(support) AS accuracy, sum(f1 * support) / sum(support) AS f1_weighted FROM ({REPORT})",
    ("accuracy", "f1_weighted"),
)
def class_metrics(spark, folder):
    return metrics.class_metrics(_labelled(spark, folder))


@query(
    "regression_metrics",
    """SELECT 1 - sum((l_extendedprice - l_quantity * 2100) ** 2) / (var_pop(l_extendedprice) * count(*)) AS r2,
      avg(abs(l_extendedprice - l_quantity * 2100)) AS mae,
      sqrt(avg((l_extendedprice - l_quantity * 2100) ** 2)) AS rmse FROM lineitem""",
    ("r2", "mae", "rmse"),
)
def regression_metrics(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    return metrics.regression_metrics(
        rows.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2100).alias("prediction"))
    )


def training_rows(spark, folder):
    """As many draws as there are institutions."""
    rows = tables.institutions(spark, folder)
    return outcomes.sample_scenarios(rows, spark.read.parquet(f"{folder}/customer.parquet").count())


def _drawn(name: str, key: str = "draw_id") -> str:
    return f"(('0x' || substr(md5('{fixed.SEED}|{name}|' || {key}), 1, 13))::BIGINT / {float(1 << 52)!r}e0)"


def _normal(name: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_drawn(name + '_radius')})) * cos(2 * pi() * {_drawn(name + '_angle')}))"


_DRAWS = ", ".join(
    [f"{_drawn(c)} * {high - low!r}e0 + {low!r}e0 AS {c}" for c, (low, high) in fixed.DRAW_RANGES.items()]
    + [f"{_normal(c)} * {sigma!r}e0 AS noise_{c}" for c, sigma in fixed.NOISE_SIGMA.items()]
)
SAMPLE = f"""SELECT draw_id, funding_change_pct, min_wage_change, childcare_subsidy, tuition_cap_pct, state, institution_type,
  CASE WHEN enrollment > 0 THEN enrollment ELSE {fixed.FEATURE_DEFAULTS["enrollment"]!r}e0 END AS enrollment,
  li AS pct_low_income, mi AS pct_minority, baseline_tuition, baseline_grad_rate, tuition_change_pct,
  -(dollars / 1000) * elasticity * 100 + greatest(min_wage_change, 0) * {fixed.WAGE_ENROLLMENT!r}e0
    + greatest(childcare_subsidy / 1000, 0) * {fixed.CHILDCARE_ENROLLMENT!r}e0 + noise_enrollment AS enrollment_change_pct,
  -(abs(dollars) / baseline_tuition) * stress_slope + greatest(min_wage_change, 0) * {fixed.WAGE_GRADUATION!r}e0
    + greatest(childcare_subsidy / 1000, 0) * {fixed.CHILDCARE_GRADUATION!r}e0 + noise_graduation AS grad_rate_change,
  score AS equity_risk_score, CASE WHEN score <= 33 THEN 'Low' WHEN score <= 66 THEN 'Medium' ELSE 'High' END AS equity_risk_class
FROM (SELECT *, least(greatest(li / 100 * 40 + mi / 100 * 30 + least(abs(dollars) / 2000, 1e0) * 30, 0e0), 100e0) AS score
  FROM (SELECT *, baseline_tuition * tuition_change_pct / 100 AS dollars
    FROM (SELECT *, CASE WHEN tuition_cap_pct <> 0 AND funding_change_pct * 0.2e0 > tuition_cap_pct THEN tuition_cap_pct
          ELSE funding_change_pct * 0.2e0 END + noise_tuition AS tuition_change_pct,
        CASE WHEN net_price > 0 THEN net_price ELSE 10000e0 END AS baseline_tuition, coalesce(grad_rate, 60e0) AS baseline_grad_rate,
        coalesce(pct_low_income, 30e0) AS li, coalesce(pct_minority, 25e0) AS mi
      FROM (SELECT draw_id, CAST(floor({_drawn("institution")} * (SELECT count(*) FROM customer)) AS BIGINT) AS place, {_DRAWS}
        FROM range((SELECT count(*) FROM customer)) r(draw_id))
      JOIN (SELECT *, row_number() OVER (ORDER BY institution_id) - 1 AS place FROM ({INSTITUTIONS})) USING (place))))"""
SAMPLE_DOUBLES = (
    "funding_change_pct", "min_wage_change", "childcare_subsidy", "tuition_cap_pct", "tuition_change_pct",
    "enrollment_change_pct", "grad_rate_change", "equity_risk_score", "baseline_tuition", "baseline_grad_rate",
    "pct_low_income", "pct_minority",
)


@query("sample_scenarios", SAMPLE, SAMPLE_DOUBLES)
def sample_scenarios(spark, folder):
    return training_rows(spark, folder)


@query(
    "target_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS target, avg({c}) AS mean, stddev_samp({c}) AS std FROM ({SAMPLE})"
        for c in ("tuition_change_pct", "enrollment_change_pct", "grad_rate_change")
    ),
    ("mean", "std"),
)
def target_summary(spark, folder):
    return outcomes.target_summary(training_rows(spark, folder))["targets"]


@query("label_distribution", f"SELECT equity_risk_class, count(*) AS row_count FROM ({SAMPLE}) GROUP BY 1")
def label_distribution(spark, folder):
    return outcomes.target_summary(training_rows(spark, folder))["labels"]


@query(
    "split_rows",
    f"""SELECT institution_id, (place <= floor(0.2e0 * (n - 1)) + 1)::INT AS test FROM (SELECT institution_id,
        row_number() OVER (PARTITION BY equity_risk_class ORDER BY u) AS place, count(*) OVER (PARTITION BY equity_risk_class) AS n
      FROM (SELECT *, ('0x' || substr(md5(institution_id || '|{fixed.SEED}'), 1, 13))::BIGINT AS u FROM ({IMPACT})))""",
)
def split_rows(spark, folder):
    """Which rows are test rows, by id."""
    rows = mixed(spark, folder).select("institution_id", "equity_risk_class")
    train, test = features.split(rows, by="equity_risk_class", identity=["institution_id"])
    both = train.withColumn("test", F.lit(0)).unionByName(test.withColumn("test", F.lit(1)))
    return both.select("institution_id", "test")


@query(
    "split_counts",
    f"""SELECT equity_risk_class, n AS row_count, CAST(floor(0.2e0 * (n - 1)) AS BIGINT) + 1 AS test_count
      FROM (SELECT equity_risk_class, count(*) AS n FROM ({IMPACT}) GROUP BY 1)""",
)
def split_counts(spark, folder):
    """A stratified split: the share of test rows inside every class."""
    rows = mixed(spark, folder).select("institution_id", "equity_risk_class")
    train, test = features.split(rows, by="equity_risk_class", identity=["institution_id"])
    both = train.withColumn("test", F.lit(0)).unionByName(test.withColumn("test", F.lit(1)))
    return both.groupBy("equity_risk_class").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("test").alias("test_count")
    )


_trained: dict[tuple[str, str], learning.Training] = {}


def trained(spark, folder):
    """The four models at full size, without folds; one training per
    application and folder serves all queries below."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _trained:
        _trained[key] = learning.train_models(training_rows(spark, folder), cv=False)
    return _trained[key]


@query("model_metrics")
def model_metrics(spark, folder):
    return trained(spark, folder).metrics


@query("model_importances")
def model_importances(spark, folder):
    return trained(spark, folder).importances


@query("model_impact")
def model_impact(spark, folder):
    """Trained on draws, then applied to every institution under one policy."""
    rows = tables.institutions(spark, folder).withColumns(impact.policy_columns(**MIXED))
    scored = impact.derived_metrics(model_predictor(trained(spark, folder).models)(rows))
    return impact.equity_table(scored)


@query("model_attributions")
def model_attributions(spark, folder):
    """How much each feature moves each prediction over all training rows."""
    models = trained(spark, folder).models
    ready, _ = features.prepare_features(training_rows(spark, folder), models.fitted)
    ready = cut_lineage(ready.select("features"))  # read once per model
    names = [c.removeprefix("f_") for c in models.fitted.columns]
    out = None
    for name, model in models.models.items():
        parts = model.models if isinstance(model, learning.ClassEnsemble) else {None: model}
        for label, part in parts.items():
            rows = attribution.mean_shares(ready, part, names).select(F.lit(name).alias("model"), F.lit(label).cast("string").alias("class"), "feature", "mean_abs_share")
            out = rows if out is None else out.unionByName(rows)
    return out


@query("model_folds")
def model_folds(spark, folder):
    """The forest's five folds at full size: rows and score of each, from the
    out-of-fold predictions. (Those of the boosted models take some minutes.)"""
    config = fixed.MODELS["grad_rate"]
    ready, _ = features.prepare_features(training_rows(spark, folder))
    rows = ready.select("features", F.xxhash64(*[F.col(c) for c in ready.columns if c != "features"]).alias("_row_hash"), F.col(config["target"]).alias("label"))
    table = learning.out_of_fold(learning.stored(rows.dropna()), config)
    middle = F.sum((F.col("label") - F.col("mean")) ** 2)
    means = table.groupBy("fold").agg(exact_mean("label").alias("mean"))
    return table.join(means, "fold").groupBy("fold").agg(
        F.count(F.lit(1)).alias("predicted"), (1 - F.try_divide(F.sum((F.col("label") - F.col("prediction")) ** 2), middle)).alias("r2")
    )
