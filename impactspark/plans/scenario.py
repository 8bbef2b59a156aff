"""From policies (or bill texts) to predicted impact and its reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.functions.columns import first_present, numeric_columns
from impactspark.operators import groups, impact, scores, stats
from impactspark.operators.bills import process_bills
from impactspark.operators.learning import ModelSet, score
from impactspark.operators.outcomes import outcomes
from impactspark.sources import sinks
from impactspark.sources.folders import cut_lineage

Predictor = Callable[[DataFrame], DataFrame]


def rule_predictor(df: DataFrame) -> DataFrame:
    """Predictions of the deterministic outcome model."""
    return outcomes(df, detailed_types=True)


def model_predictor(models: ModelSet) -> Predictor:
    """Predictions of the trained models, on the feature columns they know."""

    def predict(df: DataFrame) -> DataFrame:
        added = [c for c in impact.fixed.FEATURE_SYNONYMS if c not in df.columns]
        scored = score(impact.with_feature_columns(df), models)
        return scored.drop(*[c for c in added if c not in ("baseline_tuition",)])

    return predict


def scenario_impact(
    institutions: DataFrame,
    policies: DataFrame,
    predict: Predictor = rule_predictor,
    states: Sequence[str] | None = None,
) -> DataFrame:
    """Predicted impact of every policy on every institution it names."""
    chosen = impact.filter_affected(institutions, states=states)
    return impact.derived_metrics(predict(impact.attach_policies(chosen, policies)))


def predict_impact(
    bills: DataFrame,
    master: DataFrame,
    predict: Predictor = rule_predictor,
    states: Sequence[str] | None = None,
) -> DataFrame:
    """The same for a table of bill texts, for all bills at once. A bill
    without text names nobody and has no rows.

    The parameters (a few numbers per bill) are checkpointed, so the texts are
    read once however often the pairs are.
    """
    keep = ["bill_id", *impact.fixed.POLICY_NUMBERS, "affected_types"]
    params = cut_lineage(process_bills(bills).select(*keep))
    known = params.filter(F.col("affected_types").isNotNull())
    return scenario_impact(master, known, predict, states)


POLICY_KEY = ["policy_id", *impact.fixed.POLICY_NUMBERS, "affected_types"]


def with_policy_id(params: DataFrame) -> DataFrame:
    """Name each bill's policy by its content: the four numbers and the types in
    order. Bills that ask for the same thing share a policy."""
    types = F.array_sort(F.array_distinct("affected_types"))
    params = params.withColumn("affected_types", types)
    content = F.to_json(F.struct(*impact.fixed.POLICY_NUMBERS, "affected_types"), {"ignoreNullFields": "false"})
    return params.withColumn("policy_id", F.sha2(content, 256))


def distinct_policies(params: DataFrame) -> DataFrame:
    """One row per policy of bills that name somebody."""
    return params.filter(F.col("affected_types").isNotNull()).select(*POLICY_KEY).dropDuplicates(["policy_id"])


def summarize_bills(
    bills: DataFrame,
    master: DataFrame,
    predict: Predictor = rule_predictor,
    states: Sequence[str] | None = None,
) -> DataFrame:
    """One summary per bill, computed once per distinct policy.

    A corpus holds few policies however many bills it has: institutions meet
    policies, not bills, and the summaries are joined back to the bills.
    """
    params = cut_lineage(with_policy_id(process_bills(bills)).select("bill_id", *POLICY_KEY))
    # stored: the pairs are counted, made once for the sums and again for the top lists
    stored = cut_lineage(master), cut_lineage(distinct_policies(params))
    pairs = scenario_impact(*stored, predict, states)
    summary = impact.plain_sentence(impact.impact_summary(pairs, ["policy_id"]))
    return params.select("bill_id", "policy_id").join(summary, "policy_id")


def analyze_scenario(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Statistics, correlations, distributions and group means of a scenario."""
    columns = list(columns or numeric_columns(df))
    out = {
        "statistics": stats.describe(df, columns),
        "correlations": stats.correlation_matrix(df, columns),
        "histograms": stats.histogram(df, columns),
        "boxplots": stats.boxplot_stats(df, columns),
    }
    for key in ("state", "institution_type"):
        if key in df.columns:
            out[f"by_{key}"] = groups.group_means(df, [key])
    return out


def custom_metrics(df: DataFrame) -> dict[str, DataFrame]:
    """Impact score, equity gaps, state ranking, most resilient institutions."""
    out = {
        "affordability_impact": stats.score_summary(scores.impact_score(df)),
        "equity_gaps": groups.equity_gap(df),
        "most_resilient_institutions": scores.impact_resilience(df),
    }
    if "state" in df.columns:
        out["state_vulnerability"] = scores.state_vulnerability(df)
    return out


def write_reports(tables: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Correlations as CSV, everything else as JSON."""
    done = {}
    for name, df in tables.items():
        write = sinks.write_csv if name == "correlations" else sinks.write_json
        done[name] = write(df, f"{base}/{name}")
    return done


def run_scenario(
    spark: SparkSession,
    scenario: str,
    policies: DataFrame,
    master: DataFrame,
    out: str,
    predict: Predictor = rule_predictor,
    states: Sequence[str] | None = None,
    analysis: bool = False,
) -> dict[str, str]:
    """Predict, publish and (on request) analyse one scenario.

    Predictions are written once as a table; exports, summary and analyses all
    read that table. The run is recorded whether it succeeds or not.
    """
    try:
        table = f"{out}/impact/scenario={scenario}"
        scenario_impact(master, policies, predict, states).write.mode("overwrite").parquet(table)
        rows = spark.read.parquet(table)
        done = sinks.publish(
            rows,
            impact.equity_table(rows),
            impact.plain_sentence(impact.impact_summary(rows)),
            scenario,
            out,
        )
        if analysis:
            name = first_present(rows.columns, ["institution_id"])
            measures = [c for c in numeric_columns(rows) if c != name]
            reports = analyze_scenario(rows, measures) | custom_metrics(rows)
            done |= write_reports(reports, f"{out}/analysis/{scenario}")
    except Exception as e:
        sinks.record_run(spark, out, scenario, scenario, "error", str(e))
        raise
    sinks.record_run(spark, out, scenario, scenario, "success")
    return done
