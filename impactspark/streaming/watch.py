"""Arriving bill files: each is processed once and published."""

from __future__ import annotations

from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from impactspark.operators import impact
from impactspark.operators.bills import process_bills
from impactspark.plans.scenario import Predictor, distinct_policies, rule_predictor, scenario_impact, with_policy_id
from impactspark.sources.folders import cut_lineage
from impactspark.sources.sinks import impact_export, now_iso

STEM = r"([^/]+?)(?:\.[^./]*)?$"


def file_bills(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """A stream with one row per new text file; the whole file is its text.
    Spark passes over files of zero bytes, which hold no bill."""
    files = spark.readStream.option("pathGlobFilter", glob).text(folder, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), STEM, 1)
    return files.select(
        stem.alias("bill_id"),
        F.col("_metadata.file_name").alias("source_name"),
        F.col("value").alias("text"),
    )


def table_bills(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    key: str,
    text: Column | str,
    glob: str,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of the rows of arriving parquet files, one bill per row."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(folder)
    body = F.col(text) if isinstance(text, str) else text
    return rows.select(
        F.col(key).cast("string").alias("bill_id"),
        F.col("_metadata.file_name").alias("source_name"),
        body.alias("text"),
    )


def publish_batch(
    batch: DataFrame,
    batch_id: int,
    master: DataFrame,
    out: str,
    predict: Predictor = rule_predictor,
) -> None:
    """Parameters, impact, equity and summary of one batch of bills.

    Institutions meet the policies that no earlier batch has scored: `impact`
    has one row per new policy and institution, `policy_equity` and
    `policy_summary` what follows from them, `params` leads from a bill to its
    policy, and `equity` and `summary` are per bill, from its own or an earlier
    batch. So `out` belongs to one `master`, which should be a stored table, and
    one `predict`. Every output lies under its batch
    number and is overwritten whole, so a batch that is repeated leaves the
    same files; the batch becomes the current one by a single row appended at
    the end. The scenario is the bill with the batch number.

    A bill without text is recorded as an error and the others are published.
    Any other failure is recorded and raised: the batch is not committed and
    comes again.
    """
    spark = batch.sparkSession

    def store(df: DataFrame, kind: str, **options: str) -> DataFrame:
        path = f"{out}/{kind}/batch_id={batch_id}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return spark.read.parquet(path)

    def record(status: Column, error: Column) -> None:
        runs = named.select("scenario", "source_name", status.alias("status"), now_iso().alias("timestamp"), error.alias("error"))
        store(runs, "runs")

    named = batch.withColumn("scenario", F.concat(F.col("bill_id"), F.lit(f"_{batch_id}")))
    try:
        params = store(with_policy_id(process_bills(spread(named))), "params")
        fresh = store(unscored(spark, distinct_policies(params), out, batch_id), "policies")
        pairs = scenario_impact(master, fresh, predict)
        # looking up measures of pairs in dictionaries takes half of the writing
        plain = {f"parquet.enable.dictionary#{c}": "false" for c, kind in pairs.dtypes if kind == "double"}
        rows = store(pairs, "impact", **plain)
        few = fresh.count() <= impact.POLICY_BROADCAST_ROWS
        bills = params.select("scenario", "policy_id")
        totals = cut_lineage(impact.class_totals(rows, ["policy_id"]))  # once for both tables
        equity = impact.equity_from_totals(totals, ["policy_id"])
        summary = impact.plain_sentence(impact.summary_from_totals(totals, rows, ["policy_id"], few=few))
        for df, kind in ((equity, "equity"), (summary, "summary")):
            store(df, f"policy_{kind}")
            scored = published(spark, out, f"policy_{kind}").filter(F.col("batch_id") <= batch_id).drop("batch_id")
            store(bills.join(scored, "policy_id"), kind)
        blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
        record(
            F.when(blank, "error").otherwise("success"),
            F.when(blank, "the bill has no text"),
        )
    except Exception as e:
        record(F.lit("error"), F.lit(str(e)))
        raise
    pointer = spark.createDataFrame([(batch_id,)], "batch_id long").withColumn("timestamp", now_iso())
    pointer.coalesce(1).write.mode("append").json(f"{out}/pointer")


def spread(bills: DataFrame) -> DataFrame:
    """Bills dealt over all cores. A file comes in as many parts as it has row
    groups, often one, and reading parameters out of texts is the work."""
    return bills.repartition(impact.TASKS_PER_CORE * bills.sparkSession.sparkContext.defaultParallelism)


def unscored(spark: SparkSession, policies: DataFrame, out: str, batch_id: int) -> DataFrame:
    """The policies that no batch before this one has scored."""
    if batch_id == 0:
        return policies
    try:
        earlier = published(spark, out, "policies").filter(F.col("batch_id") < batch_id).select("policy_id")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return policies
    return policies.join(earlier, "policy_id", "left_anti")


def current(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """A table of the newest batch that was published in whole."""
    pointers = spark.read.schema("batch_id long, timestamp string").json(f"{out}/pointer")
    newest = pointers.agg(F.max("batch_id")).first()[0]
    return spark.read.parquet(f"{out}/{kind}/batch_id={newest}")


def published(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """A table over all batches."""
    return spark.read.parquet(f"{out}/{kind}")


def predictions(spark: SparkSession, out: str) -> DataFrame:
    """The dashboard projection per policy, from the stored impact rows."""
    return impact_export(published(spark, out, "impact"), ["policy_id"])


def watch(
    bills: DataFrame,
    master: DataFrame,
    out: str,
    checkpoint: str,
    predict: Predictor = rule_predictor,
    once: bool = True,
) -> StreamingQuery:
    """Start publishing a stream of bills; the checkpoint remembers which
    files are done. With `once`, stop after everything present is processed."""
    each = partial(publish_batch, master=master, out=out, predict=predict)
    writer = bills.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
