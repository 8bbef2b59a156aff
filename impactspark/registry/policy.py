"""Policy-text queries over the whole document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactspark import fixed
from impactspark.functions import text as tx
from impactspark.functions.exact import exact_mean_sql
from impactspark.operators import bills, impact
from impactspark.plans.scenario import summarize_bills
from impactspark.registry.base import INSTITUTIONS, SCENARIOS, outcome_sql, query
from impactspark.registry.people import flat_summary, summary_sql
from impactspark.sources import tables
from impactspark.sources.folders import cut_lineage, fresh_dir
from impactspark.streaming import watch

_CASES = " ".join(
    f"WHEN {i} THEN replace('{s}', '{{}}', CAST(doc_id % 19 + 1 AS VARCHAR))" for i, s in enumerate(tables.SENTENCES)
)
BILLS = f"SELECT doc_id AS bill_id, text || ' ' || CASE doc_id % {len(tables.SENTENCES)} {_CASES} END AS text FROM documents"
CLEAN = f"""SELECT bill_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '{fixed.PAGE_FOOTER}', '', 'g'),
  '{fixed.BILL_HEADER}', '', 'g'), '{fixed.SPACE}+', ' ', 'g'), ' ') AS text FROM ({BILLS})"""
MONEY, PERCENT = f"(?i){fixed.MONEY}", f"(?i){fixed.PERCENT}"


def _amounts(text: str) -> str:
    return f"""list_filter(list_transform(regexp_extract_all({text}, '{MONEY}'), lambda m:
      try_cast(regexp_replace(m, '[^0-9.]', '', 'g') AS DOUBLE)
      * CASE WHEN contains(lower(m), 'million') OR contains(m, 'M') THEN 1e6
             WHEN contains(lower(m), 'billion') OR contains(m, 'B') THEN 1e9 ELSE 1e0 END), lambda a: a IS NOT NULL)"""


def _percents(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{PERCENT}', 1), lambda p: CAST(p AS DOUBLE))"


def _first(values: str) -> str:
    return f"list_filter({values}, lambda a: a IS NOT NULL)[1]"


def _context(pattern: str, inner) -> str:
    found = f"regexp_extract_all(text, '(?i){pattern}')"
    return _first(f"list_transform({found}, lambda c: {inner})")


FUNDING = _context(
    fixed.FUNDING_CONTEXT, f"({_percents('c')})[1] * CASE WHEN regexp_matches(lower(c), '{fixed.FUNDING_DOWN}') THEN -1 ELSE 1 END"
)
WAGE = _context(fixed.WAGE_CONTEXT, f"({_amounts('c')})[1]")
CHILDCARE = _context(fixed.CHILDCARE_CONTEXT, f"({_amounts('c')})[1]")
CAP = f"CASE WHEN regexp_matches(text, '(?i){fixed.CAP_PHRASE}') THEN ({_percents('text')})[1] END"


def _named(words):
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


PUBLIC, PRIVATE, COMMUNITY = (_named(fixed.TYPE_WORDS[t]) for t in ("public", "private", "community"))
TYPES = f"""CASE WHEN {PUBLIC} OR {PRIVATE} OR {COMMUNITY} THEN list_filter([CASE WHEN {PUBLIC} THEN 'public' END,
  CASE WHEN {PRIVATE} THEN 'private' END, CASE WHEN {COMMUNITY} THEN 'community' END], lambda t: t IS NOT NULL)
  ELSE ['public', 'private', 'community'] END"""
PARAMS = f"""SELECT *, 20e0 + CASE WHEN funding_change_pct IS NOT NULL THEN 30 ELSE 0 END
    + CASE WHEN min_wage_change IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN childcare_subsidy IS NOT NULL THEN 20 ELSE 0 END
    + CASE WHEN tuition_cap_pct IS NOT NULL THEN 10 ELSE 0 END AS confidence_score,
    substring(text, 1, 500) AS bill_text_sample, 'rule_based' AS extraction_method
  FROM (SELECT bill_id, text, {FUNDING} AS funding_change_pct, {WAGE} AS min_wage_change,
    {CHILDCARE} AS childcare_subsidy, {CAP} AS tuition_cap_pct, {TYPES} AS affected_types FROM ({CLEAN}))"""
PARAM_LIST = (
    "bill_id, funding_change_pct, min_wage_change, childcare_subsidy, tuition_cap_pct, "
    "array_to_string(affected_types, ',') AS affected_types, confidence_score, bill_text_sample, extraction_method"
)


def _joined_types(df):
    return df.withColumn("affected_types", F.array_join("affected_types", ","))


def _once(bills, found, name):
    """A column that a later filter does not evaluate a second time."""
    return bills.select("bill_id", F.inline(F.array(F.struct(found.alias(name)))))


@query("bill_clean", CLEAN)
def bill_clean(spark, folder):
    return bills.clean_bills(tables.bills(spark, folder))


@query(
    "bill_money",
    f"""SELECT bill_id, len(a) AS amount_count, list_sum(a) AS amount_sum, a[1] AS first_amount
      FROM (SELECT bill_id, {_amounts('text')} AS a FROM ({BILLS})) WHERE len(a) > 0""",
    ("amount_sum", "first_amount"),
)
def bill_money(spark, folder):
    found = _once(tables.bills(spark, folder), tx.money_amounts(F.col("text")), "a")
    return found.filter(F.size("a") > 0).select(
        "bill_id",
        F.size("a").cast("long").alias("amount_count"),
        F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("amount_sum"),
        F.col("a")[0].alias("first_amount"),
    )


@query(
    "bill_percent",
    f"""SELECT bill_id, len(p) AS percent_count, list_sum(p) AS percent_sum
      FROM (SELECT bill_id, {_percents('text')} AS p FROM ({BILLS})) WHERE len(p) > 0""",
    ("percent_sum",),
)
def bill_percent(spark, folder):
    found = _once(tables.bills(spark, folder), tx.percentages(F.col("text")), "p")
    return found.filter(F.size("p") > 0).select(
        "bill_id",
        F.size("p").cast("long").alias("percent_count"),
        F.aggregate("p", F.lit(0.0), lambda s, x: s + x).alias("percent_sum"),
    )


@query("bill_params", f"SELECT {PARAM_LIST} FROM ({PARAMS})")
def bill_params(spark, folder):
    return _joined_types(bills.process_bills(tables.bills(spark, folder)))


@query("bill_review", f"SELECT bill_id, confidence_score FROM ({PARAMS}) WHERE confidence_score < 60")
def bill_review(spark, folder):
    params = bills.process_bills(tables.bills(spark, folder))
    return bills.needs_review(params).select("bill_id", "confidence_score")


# labels act as an outside opinion about some of the bills
OVERRIDES = """SELECT doc_id AS bill_id, CASE WHEN quality = 1 THEN -3e0 END AS funding_change_pct,
  NULL::DOUBLE AS min_wage_change, 250e0 AS childcare_subsidy,
  CASE WHEN toxic = 1 THEN ['private'] ELSE []::VARCHAR[] END AS affected_types FROM labels"""


@query(
    "bill_overrides",
    f"""SELECT p.bill_id, coalesce(o.funding_change_pct, p.funding_change_pct) AS funding_change_pct,
      coalesce(o.min_wage_change, p.min_wage_change) AS min_wage_change,
      coalesce(o.childcare_subsidy, p.childcare_subsidy) AS childcare_subsidy, p.tuition_cap_pct,
      array_to_string(CASE WHEN len(o.affected_types) > 0 THEN o.affected_types ELSE p.affected_types END, ',') AS affected_types,
      CASE WHEN o.bill_id IS NOT NULL THEN 85e0 ELSE p.confidence_score END AS confidence_score,
      CASE WHEN o.bill_id IS NOT NULL THEN 'override' ELSE 'rule_based' END AS extraction_method
    FROM ({PARAMS}) p LEFT JOIN ({OVERRIDES}) o ON o.bill_id = p.bill_id AND p.confidence_score < 60""",
)
def bill_overrides(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    outside = labels.select(
        F.col("doc_id").alias("bill_id"),
        F.when(F.col("quality") == 1, -3.0).alias("funding_change_pct"),
        F.lit(None).cast("double").alias("min_wage_change"),
        F.lit(250.0).alias("childcare_subsidy"),
        F.when(F.col("toxic") == 1, F.array(F.lit("private")))
        .otherwise(F.array().cast("array<string>"))
        .alias("affected_types"),
    )
    return _joined_types(bills.process_bills(tables.bills(spark, folder), outside)).drop("bill_text_sample")


# suppliers as a second set of institutions, with types of their own
SUPPLIERS = """SELECT s_suppkey AS institution_id, s_name AS name, n_name AS state,
  CASE s_suppkey % 4 WHEN 0 THEN 'Public Four-Year' WHEN 1 THEN 'Community College'
    WHEN 2 THEN 'Private For-Profit' ELSE 'Public Two-Year' END AS institution_type,
  s_acctbal * 2 AS net_price, s_acctbal / 4 AS affordability_gap, s_suppkey * 10e0 AS enrollment,
  s_suppkey % 101 * 1e0 AS pct_low_income, s_suppkey % 67 * 1e0 AS pct_minority, s_suppkey % 83 * 1e0 AS grad_rate
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def suppliers(spark, folder):
    key = F.col("s_suppkey")
    kind = (
        F.when(key % 4 == 0, "Public Four-Year")
        .when(key % 4 == 1, "Community College")
        .when(key % 4 == 2, "Private For-Profit")
        .otherwise("Public Two-Year")
    )
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    rows = spark.read.parquet(f"{folder}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        key.alias("institution_id"), F.col("s_name").alias("name"), F.col("n_name").alias("state"),
        kind.alias("institution_type"), (F.col("s_acctbal") * 2).alias("net_price"),
        (F.col("s_acctbal") / 4).alias("affordability_gap"), (key * 10.0).alias("enrollment"),
        (key % 101 * 1.0).alias("pct_low_income"), (key % 67 * 1.0).alias("pct_minority"),
        (key % 83 * 1.0).alias("grad_rate"),
    )


_LABELS = " ".join(
    f"WHEN '{kind}' THEN {list(labels)!r}" for kind, labels in fixed.TYPE_EXPANSION.items()
)
BILL_IMPACT = outcome_sql(
    f"""SELECT s.* EXCLUDE (min_wage), p.bill_id, coalesce(p.funding_change_pct, 0) AS funding_change_pct,
      coalesce(p.min_wage_change, 0) AS min_wage_change, coalesce(p.childcare_subsidy, 0) AS childcare_subsidy,
      coalesce(p.tuition_cap_pct, 0) AS tuition_cap_pct FROM ({INSTITUTIONS}) s JOIN (SELECT *,
        flatten(list_transform(affected_types, lambda t: CASE t {_LABELS} END)) AS labels FROM ({PARAMS})) p
      ON list_contains(p.labels, s.institution_type)"""
)


@query("bill_impact", summary_sql(BILL_IMPACT, "bill_id"))
def bill_impact(spark, folder):
    """Every bill of the corpus against every institution it names, by policies."""
    found = summarize_bills(tables.bills(spark, folder), tables.institutions(spark, folder).drop("min_wage"))
    return flat_summary(found).drop("policy_id")


@query(
    "stream_publish",
    f"""SELECT CAST(bill_id AS VARCHAR) AS bill_id, equity_risk_class, count(institution_id) AS college_count,
      {exact_mean_sql("tuition_change_dollars")} AS avg_tuition_change FROM ({BILL_IMPACT}) GROUP BY bill_id, equity_risk_class""",
)
def stream_publish(spark, folder):
    """The documents arrive as several files in a watched folder, one batch
    each; their bills are published and all batches are read back."""
    out = stream_documents(spark, folder)
    equity = watch.published(spark, out, "equity")
    return equity.select(
        F.regexp_replace("scenario", "_[0-9]+$", "").alias("bill_id"), "equity_risk_class", "college_count", "avg_tuition_change"
    )


def stream_documents(spark, folder):
    """Publish the documents from three files."""
    base = fresh_dir(spark, "stream")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", tables.bill_text().alias("text"))
    docs.repartition(3, "doc_id").write.parquet(f"{base}/inbox")
    arriving = watch.table_bills(spark, f"{base}/inbox", docs.schema, "doc_id", "text", "*.parquet", files_per_batch=1)
    people = cut_lineage(tables.institutions(spark, folder).drop("min_wage"))
    watch.watch(arriving, people, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return f"{base}/out"


@query(
    "stream_runs",
    """SELECT CAST(doc_id AS VARCHAR) AS bill_id, 'success' AS status, 0 AS has_error,
      (SELECT count(*) FROM documents) AS bills FROM documents""",
)
def stream_runs(spark, folder):
    """The table of runs after several batches: one row per bill, none lost."""
    runs = watch.published(spark, stream_documents(spark, folder), "runs")
    return runs.select(
        F.regexp_replace("scenario", "_[0-9]+$", "").alias("bill_id"), "status",
        F.col("error").isNotNull().cast("int").alias("has_error"), F.lit(runs.count()).alias("bills"),
    )


@query(
    "catalogue_types",
    f"""SELECT scenario, institution_type, count(*) AS colleges FROM ({SUPPLIERS}) i JOIN ({SCENARIOS}) s
      ON s.labels IS NULL OR list_contains(s.labels, i.institution_type) GROUP BY ALL""",
)
def catalogue_types(spark, folder):
    pairs = impact.attach_policies(suppliers(spark, folder), tables.catalogue(spark))
    return pairs.groupBy("scenario", "institution_type").agg(F.count(F.lit(1)).alias("colleges"))
