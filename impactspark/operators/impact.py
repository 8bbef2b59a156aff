"""Who a policy touches, what it does to them, and the summary of it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impactspark import fixed
from impactspark.functions.columns import first_present
from impactspark.functions.exact import LIMBS, exact_mean, exact_sum, from_limbs, merged_sum, partial_sums

POLICY_BROADCAST_ROWS = 10_000
POLICY_SALTS = 32  # fewest places a longer policy list is spread over
TASKS_PER_CORE = 4  # fewest tasks a core gets of the institutions that meet policies
TASK_PAIRS = 2_000_000  # about the most pairs one task makes and sorts
TOP_PLACES = 128  # places a group's rows are dealt to when the best of it are looked for
ALL_TYPES = "*"


def _expanded_types(types: Column, lower: bool = False) -> Column:
    """Simple type names to the detailed labels they stand for; other names
    stay as they are."""
    expanded = F.lit(None).cast("array<string>")
    for name, labels in fixed.TYPE_EXPANSION.items():
        known = F.array(*[F.lit(x) for x in labels])
        expanded = F.when(F.lower(types) == name, known).otherwise(expanded)
    expanded = F.coalesce(expanded, F.array(types))
    return F.transform(expanded, F.lower) if lower else expanded


def type_labels(types: Sequence[str]) -> list[str]:
    out: dict[str, None] = {}
    for t in types:
        out.update(dict.fromkeys(fixed.TYPE_EXPANSION.get(t.lower(), (t,))))
    return list(out)


def filter_affected(
    df: DataFrame,
    types: Sequence[str] = (),
    states: Sequence[str] | None = None,
    case_insensitive: bool = False,
) -> DataFrame:
    """Institutions of the named types and states; no names means no filter.

    Both filters are literal lists and reach the scan as pushed-down filters.
    """
    if types and "institution_type" in df.columns:
        labels = type_labels(types)
        if case_insensitive:
            wanted = [x.lower() for x in [*labels, *types]]
            df = df.filter(F.lower("institution_type").isin(wanted))
        else:
            df = df.filter(F.col("institution_type").isin(labels))
    if states and "state" in df.columns:
        df = df.filter(F.col("state").isin(list(states)))
    return df


def dealt(df: DataFrame, policies: int) -> DataFrame:
    """Rows dealt over all cores, and over more tasks the more pairs they make.

    Every institution becomes as many rows as policies name it. Where it comes
    from one file or a join of few partitions, one task would make them all.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(TASKS_PER_CORE * cores, math.ceil(df.count() * policies / TASK_PAIRS)))


def attach_policies(df: DataFrame, policies: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Every institution with every policy that names its type.

    `policies` has an `affected_types` list; an empty list means all types.
    The pairing is an equi-join on the institution type. A policy list within a
    checked size is broadcast; a longer one is spread over salts, so that a
    type shared by a third of the institutions still fills many tasks.
    """
    lists = F.coalesce(F.col("affected_types"), F.array().cast("array<string>"))
    labels = F.array_distinct(
        F.flatten(F.transform(lists, lambda t: _expanded_types(t, case_insensitive)))
    )
    labels = F.when(F.size(lists) > 0, labels).otherwise(F.array(F.lit(ALL_TYPES)))
    wanted = policies.withColumn("_label", F.explode(labels)).drop("affected_types")
    kind = F.lower("institution_type") if case_insensitive else F.col("institution_type")
    probe = policies.select("affected_types").limit(POLICY_BROADCAST_ROWS + 1)
    seen = probe.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(lists) == 0).alias("open")).first()
    small = seen["n"] <= POLICY_BROADCAST_ROWS
    if small and seen["n"]:  # read once for their number; a stored table makes that cheap
        df = dealt(df, seen["n"])
    if small and not seen["open"]:
        offers = df.withColumn("_label", kind)
    else:  # an institution also answers to the label for all types
        both = F.array_compact(F.array(kind, F.lit(ALL_TYPES)))
        offers = df.withColumn("_label", F.explode(both))
    if small:
        return offers.join(F.broadcast(wanted), "_label").drop("_label")
    # about as many policies meet in one place as would be broadcast
    salts = max(POLICY_SALTS, policies.count() // max(POLICY_BROADCAST_ROWS, 1))
    salt = F.pmod(F.xxhash64(*[c for c in wanted.columns if c != "_label"]), F.lit(salts))
    return (
        offers.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        .join(wanted.withColumn("_salt", salt), ["_label", "_salt"])
        .drop("_label", "_salt")
    )


def policy_columns(
    funding_change_pct: float | None = None,
    min_wage_change: float | None = None,
    childcare_subsidy: float | None = None,
    tuition_cap_pct: float | None = None,
) -> dict[str, Column]:
    """One policy as literal columns, for `df.withColumns`."""
    values = (funding_change_pct, min_wage_change, childcare_subsidy, tuition_cap_pct)
    return {
        name: F.lit(float(value or 0.0))
        for name, value in zip(fixed.POLICY_NUMBERS, values, strict=True)
    }


def with_feature_columns(df: DataFrame) -> DataFrame:
    """The five model inputs under their own names.

    A default stands in only where no column of that meaning exists; a NULL
    value stays NULL here.
    """
    for target, names in fixed.FEATURE_SYNONYMS.items():
        if target not in df.columns:
            source = first_present(df.columns, names)
            default = F.lit(fixed.FEATURE_DEFAULTS[target])
            df = df.withColumn(target, F.col(source) if source else default)
    return df


def derived_metrics(df: DataFrame) -> DataFrame:
    """Dollars, students and hours. The policy's wage change serves as the
    hourly wage; 15 stands in when it is absent or 0."""
    zero = F.lit(0.0)
    base = first_present(df.columns, ["baseline_tuition", "net_price"])
    known = df.columns
    priced = base is not None and "tuition_change_pct" in known
    df = df.withColumn(
        "tuition_change_dollars",
        F.col(base) * F.col("tuition_change_pct") / 100 if priced else zero,
    )
    enrollment = first_present(known, fixed.ENROLLMENT_SYNONYMS)
    counted = enrollment is not None and "enrollment_change_pct" in known
    df = df.withColumn(
        "students_affected",
        F.col(enrollment) * F.abs("enrollment_change_pct") / 100 if counted else zero,
    )
    named = F.col("min_wage_change") if "min_wage_change" in known else F.lit(0.0)
    wage = F.coalesce(F.nullif(named.cast("double"), F.lit(0.0)), F.lit(fixed.DEFAULT_WAGE))
    need = F.col("tuition_change_dollars")
    if "affordability_gap" in known:
        need = F.col("affordability_gap") + need
    return df.withColumn("hours_to_cover_gap", need / F.greatest(wage, F.lit(1.0)))


def equity_table(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Impact per risk class (and per `by`); rows without a class are left out."""
    return (
        df.filter(F.col("equity_risk_class").isNotNull())
        .groupBy(*by, "equity_risk_class")
        .agg(
            F.count("institution_id").alias("college_count"),
            exact_mean("tuition_change_dollars").alias("avg_tuition_change"),
            F.coalesce(exact_sum("tuition_change_dollars"), F.lit(0.0)).alias("total_tuition_impact"),
            F.coalesce(exact_sum("students_affected"), F.lit(0.0)).alias("total_students_affected"),
            exact_mean("enrollment_change_pct").alias("avg_enrollment_change"),
            exact_mean("grad_rate_change").alias("avg_grad_rate_change"),
        )
    )


MEASURES = (
    "tuition_change_pct", "tuition_change_dollars", "students_affected", "enrollment_change_pct", "grad_rate_change",
)
SHARES = (
    ("pct_minority", fixed.MINORITY_CUT, "minority_serving_institutions_affected"),
    ("pct_low_income", fixed.LOW_INCOME_CUT, "low_income_serving_institutions_affected"),
)


def class_totals(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """What equity table and summary of the same rows have in common, in one
    pass: counts and sums per group and risk class (NULL too), as limbs that
    merge to the same bits. A few rows a group; measures that are not there are
    left out."""
    measures = [m for m in MEASURES if m in df.columns]
    return df.groupBy(*by, "equity_risk_class").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("institution_id").alias("college_count"),
        *[F.count_if(F.col(c) > cut).alias(alias) for c, cut, alias in SHARES if c in df.columns],
        *[F.count(m).alias(f"{m}_n") for m in measures],
        *[part for m in measures for part in partial_sums(m, m)],
    )


def equity_from_totals(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """`equity_table` of the rows that `class_totals` has added."""

    def total(m: str) -> Column:
        return from_limbs([F.col(f"{m}_{limb}") for limb in LIMBS])

    def mean(m: str) -> Column:
        return F.try_divide(total(m), F.col(f"{m}_n"))

    return totals.filter(F.col("equity_risk_class").isNotNull()).select(
        *by,
        "equity_risk_class",
        "college_count",
        mean("tuition_change_dollars").alias("avg_tuition_change"),
        F.coalesce(total("tuition_change_dollars"), F.lit(0.0)).alias("total_tuition_impact"),
        F.coalesce(total("students_affected"), F.lit(0.0)).alias("total_students_affected"),
        mean("enrollment_change_pct").alias("avg_enrollment_change"),
        mean("grad_rate_change").alias("avg_grad_rate_change"),
    )


def top_affected(df: DataFrame, k: int = 10, by: str = "signed") -> DataFrame:
    """The `k` largest dollar changes; ties go to the smaller id. Rows without
    a change never qualify. `by="abs"` ranks by size, so cuts count too."""
    size = F.abs("tuition_change_dollars") if by == "abs" else F.col("tuition_change_dollars")
    name = "name" if "name" in df.columns else df.columns[0]
    return (
        df.filter(F.col("tuition_change_dollars").isNotNull())
        .orderBy(size.desc(), F.asc("institution_id"), F.asc(name))
        .limit(k)
    )


def top_per_group(df: DataFrame, by: Sequence[str], k: int = 10) -> DataFrame:
    """The same per group. Spark keeps the best `k` per task before the
    shuffle, so a hot group shrinks to `k` rows per task."""
    order = Window.partitionBy(*by).orderBy(
        F.desc("tuition_change_dollars"), F.asc("institution_id"), F.asc("name")
    )
    return (
        df.filter(F.col("tuition_change_dollars").isNotNull())
        .withColumn("affected_rank", F.row_number().over(order))
        .filter(F.col("affected_rank") <= k)
    )


def near_top(df: DataFrame, by: Sequence[str], k: int = 10) -> DataFrame:
    """All rows that can be among the best `k` of their group, and few others,
    so that a sort meets those alone. For few groups: a row of each is broadcast.

    A group's rows are dealt to places by a digest, and hash aggregation finds
    one best row of each place. The k-th best of these is a row of the group, so
    nothing behind it is wanted. A group in fewer than `k` places stays whole.
    """
    if not isinstance(df.schema["institution_id"].dataType, T.NumericType):
        return df  # only numbers are aggregated without a sort
    size, key = F.col("tuition_change_dollars"), F.col("institution_id")
    place = F.pmod(F.xxhash64(key), F.lit(TOP_PLACES))
    best = df.filter(size.isNotNull()).groupBy(*by, place.alias("_place"))
    order = Window.partitionBy(*by).orderBy(F.desc("_size"), F.asc("_key"))
    bounds = (
        best.agg(F.max(size).alias("_size"), F.max_by(key, size).alias("_key"))
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == k)
        .select(*[F.col(c).alias(f"_by_{c}") for c in by], "_size", "_key", "_rank")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    level = (size == F.col("_size")) & (key.isNull() | (key <= F.col("_key")))  # no id comes first
    near = F.col("_rank").isNull() | (size > F.col("_size")) | level
    return df.join(F.broadcast(bounds), same, "left").filter(near).select(*df.columns)


TOP_ENTRY = ("affected_rank", "institution_id", "name", "tuition_change_dollars")


def _breakdown(per_class: dict[str, Column]) -> Column:
    """Classes and their counts as a map, without those of none."""
    return F.map_filter(
        F.create_map(*[x for c, n in per_class.items() for x in (F.lit(c), n)]), lambda _, n: n > 0
    )


def _with_top(summary: DataFrame, df: DataFrame, by: Sequence[str], k: int, few: bool) -> DataFrame:
    """A summary per group with the `k` most affected of each."""
    best = top_per_group(near_top(df, by, k) if few else df, by, k).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(*TOP_ENTRY))).alias("top_most_affected")  # at most k entries
    )
    return summary.join(best, list(by), "left")


def summary_from_totals(totals: DataFrame, df: DataFrame, by: Sequence[str], k: int = 10, few: bool = False) -> DataFrame:
    """`impact_summary` per `by` of the rows that `class_totals` has added; they
    themselves are read for the most affected only."""

    def mean(m: str) -> Column:
        known = f"{m}_n" in totals.columns
        return F.coalesce(F.try_divide(merged_sum(m), F.sum(f"{m}_n")), F.lit(0.0)) if known else F.lit(0.0)

    rows = F.col("rows")
    per_class = {
        c: F.coalesce(F.sum(F.when(F.col("equity_risk_class") == c, rows)), F.lit(0).cast("long")) for c in fixed.CLASS_NAMES
    }
    summary = totals.groupBy(*by).agg(
        F.sum(rows).alias("total_colleges_affected"),
        F.coalesce(merged_sum("students_affected"), F.lit(0.0)).cast("long").alias("total_students_impacted"),
        mean("tuition_change_pct").alias("average_tuition_change_pct"),
        mean("tuition_change_dollars").alias("average_tuition_change_dollars"),
        mean("enrollment_change_pct").alias("average_enrollment_change_pct"),
        mean("grad_rate_change").alias("average_grad_rate_change"),
        per_class["High"].alias("high_risk_colleges"),
        *[F.sum(alias).alias(alias) for _, _, alias in SHARES if alias in totals.columns],
        _breakdown(per_class).alias("equity_risk_breakdown"),
    )
    return _with_top(summary, df, by, k, few) if "name" in df.columns else summary


def impact_summary(df: DataFrame, by: Sequence[str] = (), k: int = 10, few: bool = False) -> DataFrame:
    """One summary row (per `by`). Counts rows, as ids may repeat, and gives
    no cut is made for that. `few` tells that the groups can be broadcast."""
    names = df.columns

    def mean(c: str) -> Column:
        return F.coalesce(exact_mean(c), F.lit(0.0)) if c in names else F.lit(0.0)

    total = exact_sum("students_affected") if "students_affected" in names else F.lit(0.0)
    aggs = {
        "total_colleges_affected": F.count(F.lit(1)),
        "total_students_impacted": F.coalesce(total, F.lit(0.0)).cast("long"),
        "average_tuition_change_pct": mean("tuition_change_pct"),
        "average_tuition_change_dollars": mean("tuition_change_dollars"),
        "average_enrollment_change_pct": mean("enrollment_change_pct"),
        "average_grad_rate_change": mean("grad_rate_change"),
    }
    classed = "equity_risk_class" in names
    per_class = {
        c: F.count_if(F.col("equity_risk_class") == c) if classed else F.lit(0).cast("long")
        for c in fixed.CLASS_NAMES
    }
    aggs["high_risk_colleges"] = per_class["High"]
    for column, cut, alias in SHARES:
        if column in names:
            aggs[alias] = F.count_if(F.col(column) > cut)
    grouped = df.groupBy(*by)
    summary = grouped.agg(
        *[e.alias(a) for a, e in aggs.items()], _breakdown(per_class).alias("equity_risk_breakdown")
    )
    if "tuition_change_dollars" not in names or "name" not in names:
        return summary
    if by:
        return _with_top(summary, df, by, k, few)
    entry = F.struct(*TOP_ENTRY)
    order = Window.orderBy(F.desc("tuition_change_dollars"), F.asc("institution_id"), F.asc("name"))
    best = top_affected(df, k).withColumn("affected_rank", F.row_number().over(order))
    listed = best.agg(F.array_sort(F.collect_list(entry))).scalar()
    return summary.withColumn("top_most_affected", listed)


def plain_sentence(summary: DataFrame) -> DataFrame:
    """The summary in one sentence for readers."""
    return summary.withColumn(
        "plain_language_summary",
        F.concat(
            F.lit("This bill affects "),
            F.col("total_colleges_affected").cast("string"),
            F.lit(" colleges and "),
            F.format_number("total_students_impacted", 0),
            F.lit(" students."),
        ),
    )
