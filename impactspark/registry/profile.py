"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactspark import fixed
from impactspark.operators import duplicates, quality
from impactspark.registry.base import INSTITUTIONS, query
from impactspark.sources import tables

COLUMNS = (
    "institution_id", "name", "state", "institution_type", "net_price", "affordability_gap", "min_wage",
    "enrollment", "pct_low_income", "pct_minority", "grad_rate",
)
NUMBERS = ("institution_id", *COLUMNS[4:])


def _missing_sql(columns=COLUMNS):
    return f"WITH inst AS ({INSTITUTIONS}) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) * 100e0 / count(*), 2) AS missing_percentage, count({c}) AS non_missing_count FROM inst"""
        for c in columns
    )


@query("missing_profile", _missing_sql(), ("missing_percentage",), 2)
def missing_profile(spark, folder):
    return quality.missing_profile(tables.institutions(spark, folder))


@query(
    "most_missing",
    f"SELECT * FROM ({_missing_sql()}) WHERE missing_count > 0 ORDER BY missing_count DESC, \"column\" LIMIT 20",
    ("missing_percentage",),
    2,
)
def most_missing(spark, folder):
    return quality.most_missing(tables.institutions(spark, folder))


# one column without any value, one known for conversations' documents only
SPARSE = """SELECT doc_id, n_chars, CAST(NULL AS DOUBLE) AS never, quality, CASE WHEN lang = 'de' THEN n_chars END AS de_chars
  FROM documents LEFT JOIN labels USING (doc_id)"""


def _sparse(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        "n_chars",
        F.lit(None).cast("double").alias("never"),
        "quality",
        F.when(F.col("lang") == "de", F.col("n_chars")).alias("de_chars"),
    )


def _sparse_parts(columns):
    return f"WITH s AS ({SPARSE}) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) * 100e0 / count(*), 2) AS missing_percentage, count({c}) AS non_missing_count FROM s"""
        for c in columns
    )


@query(
    "sparse_numeric",
    f"SELECT * FROM ({_sparse_parts(('doc_id', 'n_chars', 'never', 'quality', 'de_chars'))}) "
    'WHERE missing_count > non_missing_count ORDER BY missing_count DESC, "column" LIMIT 10',
    ("missing_percentage",),
    2,
)
def sparse_numeric(spark, folder):
    return quality.sparse_numeric(_sparse(spark, folder))


@query(
    "empty_columns",
    f'SELECT "column" FROM ({_sparse_parts(("doc_id", "n_chars", "never", "quality", "de_chars"))}) WHERE non_missing_count = 0',
)
def empty_columns(spark, folder):
    return quality.empty_columns(_sparse(spark, folder))


def _outlier_sql(columns, method, source):
    parts = []
    for c in columns:
        if method == "iqr":
            low, high = "q1 - 1.5e0 * (q3 - q1)", "q3 + 1.5e0 * (q3 - q1)"
            odd = f"({c} < {low} OR {c} > {high})"
        else:
            low = high = "NULL::DOUBLE"
            odd = f"abs(({c} - m) / s) > 3"
        parts.append(
            f"""SELECT '{c}' AS "column", count(*) FILTER ({odd}) AS outlier_count,
            round(count(*) FILTER ({odd}) * 100e0 / count(*), 2) AS outlier_percentage,
            any_value({low}) AS lower_bound, any_value({high}) AS upper_bound, min({c})::DOUBLE AS min_value,
            max({c})::DOUBLE AS max_value, avg({c}) AS mean, any_value(q2) AS median
            FROM src, (SELECT quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.5)::DOUBLE AS q2,
              quantile_cont({c}, 0.75)::DOUBLE AS q3, avg({c}) AS m, stddev_samp({c}) AS s FROM src) b"""
        )
    return f"WITH src AS ({source}) SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE outlier_count > 0"


OUTLIER_DOUBLES = (
    "outlier_percentage", "lower_bound", "upper_bound", "min_value", "max_value", "mean", "median",
)


@query("iqr_outliers", _outlier_sql(NUMBERS, "iqr", INSTITUTIONS), OUTLIER_DOUBLES)
def iqr_outliers(spark, folder):
    return quality.outliers(tables.institutions(spark, folder))


@query("zscore_outliers", _outlier_sql(NUMBERS, "zscore", INSTITUTIONS), OUTLIER_DOUBLES)
def zscore_outliers(spark, folder):
    return quality.outliers(tables.institutions(spark, folder), "zscore")


@query(
    "event_outliers",
    _outlier_sql(("value",), "iqr", "SELECT value FROM events"),
    OUTLIER_DOUBLES,
)
def event_outliers(spark, folder):
    return quality.outliers(spark.read.parquet(f"{folder}/events.parquet").select("value"))


CHECKED = f"""SELECT enrollment - 3000 AS enrollment, grad_rate * 1.2e0 - 5 AS grad_rate, net_price AS tuition,
  net_price * 0.5e0 + 5000 AS total_cost, pct_minority, 'x' AS note FROM ({INSTITUTIONS})"""


def _checked(spark, folder):
    return tables.institutions(spark, folder).select(
        (F.col("enrollment") - 3000).alias("enrollment"),
        (F.col("grad_rate") * 1.2 - 5).alias("grad_rate"),
        F.col("net_price").alias("tuition"),
        (F.col("net_price") * 0.5 + 5000).alias("total_cost"),
        "pct_minority",
        F.lit("x").alias("note"),
    )


def _range_sql():
    parts = []
    for c in ("enrollment", "grad_rate", "tuition", "total_cost", "pct_minority"):
        outside = (
            f"count(*) FILTER ({c} < 0 OR {c} > 100)" if c in ("grad_rate", "pct_minority") else "0::BIGINT"
        )
        negative = (
            f"count(*) FILTER ({c} < 0)" if c in ("enrollment", "tuition", "total_cost") else "0::BIGINT"
        )
        parts.append(
            f"""SELECT '{c}' AS "column", {outside} AS outside_percent_range, {negative} AS negative_rows,
            min({c}) AS min_value, max({c}) AS max_value FROM src"""
        )
    return f"""WITH src AS ({CHECKED}) SELECT *, CASE WHEN outside_percent_range > 0 OR negative_rows > 0
      THEN 'issues_found' ELSE 'valid' END AS status FROM ({' UNION ALL '.join(parts)})"""


@query("range_checks", _range_sql(), ("min_value", "max_value"))
def range_checks(spark, folder):
    return quality.range_checks(_checked(spark, folder))


CONSISTENCY = f"""WITH src AS ({CHECKED}) SELECT * FROM (
  SELECT 'enrollment_positive' AS "check", count(*) FILTER (enrollment < 0) AS rows_found, 'high' AS severity FROM src
  UNION ALL SELECT 'grad_rate_range', count(*) FILTER (grad_rate < 0 OR grad_rate > 100), 'medium' FROM src
  UNION ALL SELECT 'tuition_vs_total_cost', count(*) FILTER (tuition > total_cost), 'medium' FROM src)
  WHERE rows_found > 0"""


@query("consistency", CONSISTENCY)
def consistency(spark, folder):
    return quality.consistency(_checked(spark, folder))


@query(
    "quality_score",
    f"""SELECT missing_columns, outlier_columns, duplicate_rows, consistency_issues,
      consistency_issues + 3 AS checks_performed, greatest(100 - least(missing_columns * 2, 30)
        - least(outlier_columns * 2, 20) - least(duplicate_rows, 20) - least(consistency_issues * 5, 30), 0)
        AS overall_quality_score FROM (SELECT
      (SELECT count(*) FROM ({" UNION ALL ".join(
        f"SELECT count(*) - count({c}) AS gone FROM ({CHECKED})"
        for c in ("enrollment", "grad_rate", "tuition", "total_cost", "pct_minority", "note"))}) WHERE gone > 0) AS missing_columns,
      (SELECT count(*) FROM ({_outlier_sql(
        ("enrollment", "grad_rate", "tuition", "total_cost", "pct_minority"), "iqr", CHECKED)})) AS outlier_columns,
      (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM ({CHECKED})
        GROUP BY enrollment, grad_rate, tuition, total_cost, pct_minority, note)) AS duplicate_rows,
      (SELECT count(*) FROM ({CONSISTENCY})) AS consistency_issues)""",
)
def quality_score(spark, folder):
    return quality.quality_score(_checked(spark, folder))


@query(
    "duplicate_rows",
    """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round(sum(n - 1) * 100e0 / sum(n), 2) AS duplicate_percentage
      FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)""",
    ("duplicate_percentage",),
    2,
)
def duplicate_rows(spark, folder):
    return quality.duplicate_rows(spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang"))


@query(
    "duplicate_keys",
    " UNION ALL ".join(
        f"""SELECT '{k}' AS "column", CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count,
        round(coalesce(sum(n - 1), 0) * 100e0 / sum(n), 2) AS duplicate_percentage, count(k) AS unique_count
        FROM (SELECT {k} AS k, count(*) AS n FROM lineitem GROUP BY 1)"""
        for k in ("l_orderkey", "l_partkey", "l_linenumber")
    ),
    ("duplicate_percentage",),
    2,
)
def duplicate_keys(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    return quality.duplicate_keys(rows, ["l_orderkey", "l_partkey", "l_linenumber"])


@query(
    "completeness",
    f"""SELECT total_cells, missing_cells, completeness, CASE WHEN completeness >= 95 THEN 'Excellent'
      WHEN completeness >= 85 THEN 'Good' WHEN completeness >= 70 THEN 'Fair' ELSE 'Poor' END AS quality_rating
    FROM (SELECT total_cells, total_cells - filled AS missing_cells, filled * 100e0 / total_cells AS completeness
      FROM (SELECT count(*) * 5 AS total_cells,
        count(doc_id) + count(n_chars) + count(never) + count(quality) + count(de_chars) AS filled FROM ({SPARSE})))""",
    ("completeness",),
)
def completeness(spark, folder):
    return quality.completeness(_sparse(spark, folder))


@query(
    "overview",
    """SELECT count(*) AS row_count, 6 AS column_count, type, n AS columns_of_type FROM orders,
      (VALUES ('bigint', 2), ('string', 2), ('double', 1), ('timestamp_ntz', 1)) v(type, n) GROUP BY type, n""",
)
def overview(spark, folder):
    return quality.overview(spark.read.parquet(f"{folder}/orders.parquet"))


@query(
    "numeric_like_strings",
    """SELECT 'price_text' AS "column", count(*) AS numeric_values, count(*) AS total_rows FROM orders""",
)
def numeric_like_strings(spark, folder):
    rows = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_totalprice").cast("string").alias("price_text"),
        "o_orderstatus",
        F.concat(F.col("o_orderkey").cast("string"), F.lit("d")).alias("suffix_text"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_custkey").cast("string")).alias("rare_number"),
    )
    return quality.numeric_like_strings(rows)


@query(
    "key_nulls",
    f"""WITH inst AS ({INSTITUTIONS}) SELECT 'institution_id' AS "column", count(*) - count(nullif(institution_id, 3)) AS missing_count FROM inst
      UNION ALL SELECT 'state', count(*) - count(nullif(state, 'NATION_4')) FROM inst""",
)
def key_nulls(spark, folder):
    rows = tables.institutions(spark, folder)
    return quality.key_nulls(
        rows.withColumns(
            {
                "institution_id": F.nullif(F.col("institution_id"), F.lit(3)),
                "state": F.nullif(F.col("state"), F.lit("NATION_4")),
            }
        ),
        fixed.KEY_CHECK_COLUMNS,
    )


DUPLICATE_COLUMNS = ("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")


def _lines(spark, folder):
    return spark.read.parquet(f"{folder}/lineitem.parquet").select(*DUPLICATE_COLUMNS)


_DIFFERS = " || ',' || ".join(
    f"CASE WHEN count(DISTINCT {c}) > 1 THEN '{c}' ELSE '' END" for c in DUPLICATE_COLUMNS[1:]
)


@query(
    "dup_classify",
    f"""SELECT l_orderkey, row_count, CASE WHEN different_count = 0 THEN 'true_duplicate' ELSE 'different_records' END AS kind,
      different_count, flags AS different_columns FROM (SELECT l_orderkey, count(*) AS row_count,
        (count(DISTINCT l_returnflag) > 1)::INT + (count(DISTINCT l_linestatus) > 1)::INT
          + (count(DISTINCT l_linenumber) > 1)::INT AS different_count,
        array_to_string(list_filter(string_split({_DIFFERS}, ','), lambda x: x <> ''), ',') AS flags
      FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""",
)
def dup_classify(spark, folder):
    rows = duplicates.classify_ids(_lines(spark, folder), "l_orderkey")
    return rows.withColumn("different_columns", F.array_join("different_columns", ","))


@query(
    "dup_summary",
    """SELECT *, CASE WHEN true_duplicates > different_records THEN 'remove_duplicates'
        WHEN different_records > true_duplicates THEN 'add_distinguishing_column' ELSE 'review_source' END AS recommendation
      FROM (SELECT CAST(sum(n) AS BIGINT) AS rows_with_key, count(*) AS unique_keys,
        count(*) FILTER (n > 1) AS duplicated_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicated_rows,
        count(*) FILTER (n > 1 AND kinds = 1) AS true_duplicates, count(*) FILTER (n > 1 AND kinds > 1) AS different_records
        FROM (SELECT l_partkey, count(*) AS n, count(DISTINCT (l_returnflag, l_linestatus)) AS kinds
          FROM lineitem GROUP BY l_partkey))""",
)
def dup_summary(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    return duplicates.classify_summary(rows.select("l_partkey", "l_returnflag", "l_linestatus"), "l_partkey")


@query(
    "dup_distribution",
    """SELECT n AS rows_per_key, count(*) AS key_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)
      WHERE n > 1 GROUP BY n""",
)
def dup_distribution(spark, folder):
    return duplicates.multiplicity(_lines(spark, folder), "l_orderkey")
