"""Writing exports, summaries, reports and run records."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impactspark import fixed
from impactspark.functions.columns import first_present, numeric_columns, string_columns
from impactspark.sources.folders import cut_lineage
from impactspark.sources.scan import DIALECT

RUN_SCHEMA = T.StructType(
    [
        T.StructField("scenario", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**DIALECT, nullValue="", emptyValue='""').csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def export_columns(columns: list[str]) -> list[str]:
    enrollment = first_present(columns, fixed.ENROLLMENT_SYNONYMS)
    wanted = [
        *fixed.EXPORT_KEYS, *fixed.EXPORT_PLACES, *fixed.EXPORT_PEOPLE,
        *([enrollment] if enrollment else []),
    ]
    return [c for c in dict.fromkeys(wanted) if c in columns]


def impact_export(df: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """The dashboard projection: known columns in a fixed order, no NULLs.
    Columns named in `first` are put before them."""
    if "institution_name" in df.columns and "name" not in df.columns:
        df = df.withColumn("name", F.col("institution_name"))
    out = df.select(*first, *export_columns(df.columns))
    numbers, texts = numeric_columns(out), string_columns(out)
    if numbers:
        out = out.fillna(0, subset=numbers)
    return out.fillna("Unknown", subset=texts) if texts else out


def stamp_summary(summary: DataFrame, scenario: str) -> DataFrame:
    return summary.withColumn("scenario_name", F.lit(scenario)).withColumn(
        "export_timestamp", now_iso()
    )


def missing_output_columns(df: DataFrame) -> DataFrame:
    """The output contract as a table: each required column and its presence."""
    rows = [(c, c in df.columns) for c in fixed.REQUIRED_OUTPUT]
    return df.sparkSession.createDataFrame(rows, "column string, present boolean")


POINTER_SCHEMA = "scenario string, folder string, timestamp string"


def publish(
    predictions: DataFrame, equity: DataFrame, summary: DataFrame, scenario: str, base: str
) -> dict[str, str]:
    """Write the three outputs under the scenario's name and once more as
    `current`, from the same stored rows.

    A current copy lies in a folder of its own and is named by one row appended
    to the pointer table when all of it is there, so a reader never meets half
    of it. `predictions` should be a stored table; the small tables are cut.
    """
    spark = predictions.sparkSession
    export = impact_export(predictions)
    equity, summary = cut_lineage(equity), cut_lineage(stamp_summary(summary, scenario))
    folder = f"{base}/current/{uuid.uuid4().hex}"
    done = {
        "predicted_impact": write_csv(export, f"{base}/predictions/{fixed.EXPORT_PREFIX}{scenario}.csv"),
        "equity_analysis": write_csv(equity, f"{base}/equity_analysis/equity_analysis_{scenario}.csv"),
        "summary": write_json(summary, f"{base}/summaries/summary_{scenario}.json"),
        "current_predicted_impact": write_csv(export, f"{folder}/current_predictions.csv"),
        "current_equity_analysis": write_csv(equity, f"{folder}/current_equity_analysis.csv"),
        "current_summary": write_json(summary, f"{folder}/current_summary.json"),
    }
    point_to(spark, base, scenario, folder)
    return done


def point_to(spark: SparkSession, base: str, scenario: str, folder: str) -> None:
    row = spark.createDataFrame([(scenario, folder)], "scenario string, folder string")
    row.withColumn("timestamp", now_iso()).coalesce(1).write.mode("append").json(f"{base}/pointer")


def current_folder(spark: SparkSession, base: str) -> str:
    """The folder of the newest complete publication."""
    pointers = spark.read.schema(POINTER_SCHEMA).json(f"{base}/pointer")
    return pointers.agg(F.max_by("folder", "timestamp")).first()[0]


def record_run(
    spark: SparkSession, base: str, scenario: str, source_name: str, status: str, error: str | None = None
) -> None:
    """Append one row to the table of runs."""
    row = spark.createDataFrame([(scenario, source_name, status, None, error)], RUN_SCHEMA)
    row.withColumn("timestamp", now_iso()).coalesce(1).write.mode("append").json(f"{base}/runs")


def latest_runs(spark: SparkSession, base: str) -> DataFrame:
    """The newest status of every scenario."""
    runs = spark.read.schema(RUN_SCHEMA).json(f"{base}/runs")
    rest = [c for c in runs.columns if c not in ("scenario", "timestamp")]
    newest = F.max_by(F.struct(*rest), "timestamp").alias("r")
    return runs.groupBy("scenario").agg(F.max("timestamp").alias("timestamp"), newest).select(
        "scenario", "timestamp", "r.*"
    )


def write_jdbc(df: DataFrame, url: str, table: str = "predictions", **properties: str) -> None:
    """Replace a database table with the predictions."""
    df.write.mode("overwrite").jdbc(url, table, properties=properties)
